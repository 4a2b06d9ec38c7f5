"""The tool-calling agent: searches, citations in court texts and the citation graph, each judged for relevance.

All open queries take a step together, as in `agent.run`: one batch of model outputs, one plan for each
tool's calls, one batch of judgements. A step's candidates are a table (query_id, citation, text), whatever
tool they come from; what the judge accepts is the result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions.text import filled
from ..session import stable
from . import agent, fusion, graph

REPLY = "text string, calls array<struct<name:string,arguments:map<string,string>>>"
# What a final answer's citations look like, and how much of a court's text is searched.
ANSWER_KINDS = (C.COURT_TEXT_ARTICLE, r"BGE\s+\d+\s+[IVX]+\s+\d+", r"\d[A-Z]_\d+/\d{4}")
COURT_TEXT_LIMIT = 2000


@dataclass(frozen=True)
class Tool:
    """argument: the name of its input; answer: calls (call, query_id, query) -> (observations (call, observation), candidates (query_id, citation, text))."""

    argument: str
    answer: Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def _one_query_a_call(calls: DataFrame) -> DataFrame:
    return calls.select(F.col("call").alias("query_id"), "query")


def search_tool(find, docs: DataFrame, corpus: str = "laws", in_texts: bool = False, **limits) -> Tool:
    """A search with threshold and second try; docs: (doc_id, citation, text). With `in_texts`, articles named in the texts found are candidates too."""

    def answer(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
        asked = stable(_one_query_a_call(calls))
        hits = stable(fusion.tool_search(asked, find, **limits))
        shown = fusion.formatted(asked, hits, docs, corpus).select(F.col("query_id").alias("call"), F.col("output").alias("observation"))
        owner = calls.select(F.col("call"), "query_id")
        found = hits.select(F.col("query_id").alias("call"), "doc_id").join(owner, "call").join(docs, "doc_id")
        own = found.select("query_id", "citation", filled("text").alias("text"))
        if in_texts:
            own = own.unionByName(found.select("query_id", F.explode(C.court_text_articles("text", COURT_TEXT_LIMIT)).alias("citation"), filled("text").alias("text")))
        return shown, own

    return Tool("query", answer)


def explore_tool(edges: DataFrame, nodes: DataFrame, k: int = 5) -> Tool:
    """What cites an id and what it cites."""

    def answer(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
        seeds = calls.select("call", "query_id", F.col("query").alias("seed"))
        found = stable(graph.explore(seeds, edges, nodes, k))
        shown = seeds.join(graph.explored_text(seeds, found, k), "seed").select("call", F.col("output").alias("observation"))
        return shown, seeds.join(found, "seed").select("query_id", F.col("id").alias("citation"), "text")

    return Tool("citation_id", answer)


def judged(queries: DataFrame, candidates: DataFrame, judge, prompt: Column) -> DataFrame:
    """(query_id, citation) of candidates that the judge accepts, each citation once, by the first text in order; a judge that fails accepts."""
    first = candidates.where(filled("citation") != "").groupBy("query_id", "citation").agg(F.min("text").alias("text"))
    asked = first.join(queries.select("query_id", "query"), "query_id").withColumn("rank", F.lit(1)).withColumn("prompt", prompt)
    return agent.relevant(asked, judge).select("query_id", "citation")


def run(queries: DataFrame, model, tools: dict[str, Tool], judge, max_iterations: int = 5) -> tuple[DataFrame, DataFrame]:
    """((query_id, citation) accepted, log (query_id, iteration, action, input, observation)).

    The model answers a conversation with JSON {text, calls: [{name, arguments}]}; a reply without calls
    is final, and its citations are candidates. A model that fails ends its queries with nothing more.
    """
    prompt = F.concat_ws("\n", F.lit("Frage:"), "query", F.lit("Bestimmung:"), "citation", "text")
    live = queries.select("query_id", "query", filled("query").alias("conversation"))
    kept, logs = [], []
    for n in range(1, max_iterations + 1):
        said = agent.call_model(live, model, "conversation", "reply", fallback="")
        step = stable(said.withColumn("r", F.from_json("reply", REPLY)))
        calls = stable(step.select("query_id", F.posexplode("r.calls").alias("place", "c")).select(F.concat_ws("#", F.col("query_id").cast("string"), "place").alias("call"), "query_id", "place", F.col("c.name").alias("name"), "c.arguments"))
        final = step.where("size(coalesce(r.calls, array())) = 0").select("query_id", F.col("r.text").alias("text"))
        cited = F.array_distinct(F.concat(*[C.find_all("text", p, C.CASED) for p in ANSWER_KINDS]))
        candidates = final.select("query_id", F.explode(cited).alias("citation"), filled("text").alias("text"))
        seen = None
        for name, tool in tools.items():
            named = calls.where(F.col("name") == name)
            if named.isEmpty():
                continue  # else the tool would read its tables for nobody
            shown, found = tool.answer(named.select("call", "query_id", F.col("arguments")[tool.argument].alias("query")))
            candidates = candidates.unionByName(found)
            seen = shown if seen is None else seen.unionByName(shown)
        kept.append(stable(judged(queries, candidates, judge, prompt)))
        done = calls if seen is None else calls.join(seen, "call", "left")
        done = stable(done if seen is not None else done.withColumn("observation", F.lit(None).cast("string")))
        answers = final.select("query_id", F.lit(n).alias("iteration"), F.lit("final").alias("action"), F.col("text").alias("input"), F.lit(None).cast("string").alias("observation"))
        logs.append(answers.unionByName(done.select("query_id", F.lit(n).alias("iteration"), F.col("name").alias("action"), F.to_json("arguments").alias("input"), "observation")))
        lines = F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("observation", F.lit("unknown tool")).alias("o")))), lambda x: agent.short_observation(x["o"]))
        heard = done.groupBy("query_id").agg(F.array_join(lines, "\n").alias("heard"))
        live = step.join(heard, "query_id").select("query_id", "query", F.concat_ws("\n", "conversation", "reply", F.lit("Observation:"), "heard").alias("conversation"))
        if live.isEmpty():
            break
    every, log = kept[0], logs[0]
    for more in kept[1:]:
        every = every.unionByName(more)
    for more in logs[1:]:
        log = log.unionByName(more)
    return every.distinct(), log
