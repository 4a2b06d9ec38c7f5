"""The agent loop, turned inside out: all queries that are still open take each step together.

The model, an injected function from prompts to outputs, runs in Arrow batches; parsing and bookkeeping
are columns. A step's results are written before the next one reads them, so that a model is called once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions.text import filled, strip
from ..session import stable

ACTION, INPUT, FINAL = r"(?iU)Action:\s*(\w+)", r"(?iU)Action Input:\s*(.+?)(?:\n|$)", r"(?isU)Final Answer:\s*(.+)"


def action(c: Column | str) -> Column:
    """Struct (action, input) of the first action with an input, else null."""
    name, text = F.regexp_extract(filled(c), ACTION, 1), F.regexp_extract(filled(c), INPUT, 1)
    return F.when((name != "") & (text != ""), F.struct(strip(name).alias("action"), strip(text).alias("input")))


def all_actions(c: Column | str) -> Column:
    """Array of (action, input) in order; an input reaches to the next action; actions without one are left out."""
    parts = F.filter(F.split(filled(c), r"(?i)(?=Action:)"), lambda x: F.rlike(x, F.lit(ACTION)))
    text = lambda x: strip(F.regexp_extract(x, r"(?is)Action Input:\s*(.+?)\s*$", 1))
    return F.filter(F.transform(parts, lambda x: F.struct(F.regexp_extract(x, ACTION, 1).alias("action"), text(x).alias("input"))), lambda x: x["input"] != "")


def final_answer(c: Column | str) -> Column:
    """What follows `Final Answer:` to the end, else null."""
    found = F.regexp_extract(filled(c), FINAL, 1)
    return F.when(found != "", strip(found))


def tool_arguments(c: Column | str) -> Column:
    """JSON arguments of a tool call as a map; broken JSON as an empty one."""
    return F.coalesce(F.from_json(filled(c), "map<string,string>"), F.create_map().cast("map<string,string>"))


def short_observation(c: Column | str, limit: int = 1200) -> Column:
    c = filled(c)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("\n... (truncated, "), (F.length(c) - limit).cast("string"), F.lit(" chars remaining)"))).otherwise(c)


def short_conversation(c: Column | str, limit: int, marker: str = "[/INST]") -> Column:
    """The part up to the marker and the newest rest within `limit`; the end alone if there is no marker or no room."""
    c = filled(c)
    tail = lambda x, n: F.substring(x, F.greatest(F.length(x) - n + 1, F.lit(1)).cast("int"), F.length(x))
    at = F.instr(c, marker)
    head = F.substring(c, F.lit(1), at + len(marker) - 1)
    room = F.lit(limit) - F.length(head) - 100
    rest = F.substring(c, at + len(marker), F.length(c))
    kept = F.when(F.length(rest) > room, F.concat(F.lit("\n...[earlier conversation truncated]...\n"), tail(rest, room))).otherwise(rest)
    long = F.when(at == 0, F.concat(F.lit("..."), tail(c, F.lit(limit)))).when(room <= 0, tail(c, F.lit(limit))).otherwise(F.concat(head, kept))
    return F.when(F.length(c) <= limit, c).otherwise(long)


def exceeds(c: Column | str, context: int, chars_per_token: float = 4.0) -> Column:
    """Whether a conversation is longer than a context window, by characters."""
    return F.length(filled(c)) / chars_per_token > context


def prompt(template: str, **columns: Column | str) -> Column:
    """A template's {names} filled with columns."""
    out: Column = F.lit(template)
    for name, c in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), filled(c))
    return out


def call_model(df: DataFrame, model: Callable[[list[str]], list[str]], prompt_col: str, out_col: str, fallback: str | None = None) -> DataFrame:
    """The model's outputs; with `fallback`, that is the output where the model fails, else the failure ends the job."""
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            try:
                yield pd.Series(list(model(prompts.tolist())), dtype=object)
            except Exception:
                if fallback is None:
                    raise
                yield pd.Series([fallback] * len(prompts), dtype=object)

    return df.withColumn(out_col, run(F.col(prompt_col)))


def relevant(found: DataFrame, model, prompt_col: str = "prompt", yes: str = "JA", on_error: str = "keep", key: tuple[str, ...] = ("query_id", "citation"), order: str = "rank") -> DataFrame:
    """Rows, the first of each citation, that the model says yes to; where it fails rows are kept, or dropped."""
    columns = found.columns
    first = found.groupBy(*key).agg(F.min_by(F.struct(*columns), order).alias("x")).select("x.*")
    said = call_model(first, model, prompt_col, "_said", yes if on_error == "keep" else "")
    return said.where(F.contains(F.upper(filled("_said")), F.lit(yes))).drop("_said")


def run(queries: DataFrame, model, tools: dict[str, Callable[[DataFrame], DataFrame]], template: str, max_iterations: int = 5, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, log): answers (query_id, answer, iterations, citations), log (query_id, iteration, output, action, input, observation).

    tools: name -> function of (query_id, query) calls to (query_id, output). A query ends with a final
    answer, with output that holds no action, or after max_iterations; citations are those of all
    observations and of the answer, distinct. Steps are written under `folder`, else checkpointed.
    """

    def kept(df: DataFrame, name: str) -> DataFrame:
        if folder is None:
            return stable(df)
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return df.sparkSession.read.parquet(f"{folder}/{name}")

    live = queries.select("query_id", F.col("query"), prompt(template, query="query").alias("conversation"))
    logs = []
    for n in range(1, max_iterations + 1):
        step = call_model(live, model, "conversation", "output").withColumn("answer", final_answer("output")).withColumn("call", F.when(F.col("answer").isNull(), action("output")))
        step = kept(step, f"step-{n}")
        seen = None
        for name, tool in tools.items():
            calls = step.where(F.lower(F.col("call.action")) == name.lower()).select("query_id", F.col("call.input").alias("query"))
            if calls.isEmpty():
                continue
            got = tool(calls).select("query_id", F.col("output").alias("observation"))
            seen = got if seen is None else seen.unionByName(got)
        step = step.join(seen, "query_id", "left") if seen is not None else step.withColumn("observation", F.lit(None).cast("string"))
        unknown = F.when(F.col("call").isNotNull(), F.format_string("Error: Unknown tool '%s'", "call.action"))
        step = kept(step.withColumn("observation", F.coalesce("observation", unknown)), f"done-{n}")
        logs.append(step.select("query_id", F.lit(n).alias("iteration"), "output", F.col("call.action").alias("action"), F.col("call.input").alias("input"), "observation", "answer"))
        live = step.where("call is not null").select("query_id", "query", F.concat("conversation", "output", F.lit("\nObservation: "), short_observation("observation"), F.lit("\nThought:")).alias("conversation"))
        if live.isEmpty():
            break
    log = logs[0]
    for more in logs[1:]:
        log = log.unionByName(more)
    cited = log.select("query_id", "iteration", F.posexplode(F.concat(C.free_text_citations("observation"), C.free_text_citations("answer"))).alias("pos", "c"))
    first = cited.groupBy("query_id", "c").agg(F.min(F.struct("iteration", "pos")).alias("at"))
    lists = first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "c"))), lambda x: x["c"]).alias("citations"))
    ends = log.groupBy("query_id").agg(F.max("answer").alias("answer"), F.max("iteration").alias("iterations"))
    answers = ends.join(lists, "query_id", "left").select("query_id", "answer", "iterations", F.coalesce("citations", F.array().cast("array<string>")).alias("citations"))
    return answers, log.drop("answer")
