"""Rank fusion, reranking, and the search tools with thresholds and a loosened second try."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import as_column, filled, is_blank, strip
from ..session import stable

RRF_K = 60
# Fixed values of the tools.
CANDIDATES, THRESHOLD, RESULTS = 50, 0.3, 10
TAIL = r"^(.+\S)\s+([A-Z][A-Za-z0-9äöüÄÖÜ]*)$"
EMPTY_QUERY = "Error: Empty query. Please provide search terms."
NOTHING = {"laws": "No relevant federal laws found for: '%s'", "courts": "No relevant court decisions found for: '%s'"}


class SearchIndex(Protocol):
    """What the tools search: (query_id, rank, doc_id, score) of the k best documents of every query."""

    def search(self, queries: DataFrame, k: int) -> DataFrame: ...


def rrf(lists: list[DataFrame], k: int = 10, key: str = "doc_id", constant: int = RRF_K) -> DataFrame:
    """(query_id, rank, key, score, first_list, first_rank) of ranked lists (query_id, rank, key).

    An item's score adds 1 / (constant + rank) over all its places, in one list too; blank keys are
    left out but keep their ranks. Ties go to the item seen first (list, then rank).
    """
    every = None
    for n, each in enumerate(lists):
        part = each.select("query_id", F.col("rank").cast("int").alias("place"), F.col(key).alias("key"), F.lit(n).alias("list"))
        every = part if every is None else every.unionByName(part)
    every = every.where(~is_blank(F.col("key").cast("string")))
    summed = every.groupBy("query_id", "key").agg(F.sum(F.lit(1.0) / (F.lit(float(constant)) + F.col("place"))).alias("score"), F.min(F.struct("list", "place")).alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first")
    ranked = summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("key").alias(key), "score", F.col("first.list").alias("first_list"), F.col("first.place").alias("first_rank"))


def candidates_for(k: int) -> int:
    """How many hits of each list are fused for k results."""
    return max(k, 10) * 2


def sigmoid(c: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-as_column(c)))


def rerank(hits: DataFrame, score: Column, k: int | None = None, with_sigmoid: bool = False) -> DataFrame:
    """Hits ordered anew by a column of scores, which may come from an injected model: adds rerank_score, replaces rank."""
    scored = hits.withColumn("rerank_score", sigmoid(score) if with_sigmoid else score)
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    ranked = scored.withColumn("_new", F.row_number().over(order))
    ranked = ranked.where(F.col("_new") <= k) if k is not None else ranked
    return ranked.drop("rank").withColumnRenamed("_new", "rank")


def model_scores(pairs: DataFrame, model, query_col: str = "query", text_col: str = "text", out_col: str = "model_score") -> DataFrame:
    """Scores of an injected cross-encoder: (queries, texts) -> list of numbers, in Arrow batches."""
    @F.pandas_udf("double")
    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([float(x) for x in model(queries.tolist(), texts.tolist())])

    return pairs.withColumn(out_col, run(query_col, text_col))


def loosen(c: Column | str) -> Column:
    """A query without its last word, if that is a capitalised abbreviation; else null."""
    shorter = strip(F.regexp_extract(strip(filled(c)), TAIL, 1))
    return F.when(shorter != "", shorter)


def above(hits: DataFrame, threshold: float = THRESHOLD, limit: int = RESULTS) -> DataFrame:
    """Of each query's candidates those with at least the threshold, then at most `limit`."""
    kept = hits.where(F.col("score") >= threshold)
    order = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def tool_search(queries: DataFrame, find, threshold: float = THRESHOLD, candidates: int = CANDIDATES, limit: int = RESULTS) -> DataFrame:
    """(query_id, rank, doc_id, score, loosened) of find(queries, k); queries without results are tried once more, loosened.

    The first hits, at most `limit` a query, are written, so that no search runs twice.
    """
    first = stable(above(find(queries, candidates), threshold, limit).withColumn("loosened", F.lit(False)))
    again = queries.join(first.select("query_id").distinct(), "query_id", "left_anti").withColumn("query", loosen("query")).where("query is not null")
    second = above(find(again, candidates), threshold, limit).withColumn("loosened", F.lit(True))
    return first.unionByName(second)


def formatted(queries: DataFrame, results: DataFrame, docs: DataFrame, corpus: str = "laws") -> DataFrame:
    """(query_id, output): `[score] citation`, newline, text, joined by blank lines; messages for blank queries and no results."""
    known = docs.select("doc_id", F.coalesce("citation", F.lit("Unknown")).alias("citation"), F.coalesce("text", F.lit("")).alias("text"))
    rows = results.join(known, "doc_id").select("query_id", F.struct("rank", F.format_string("[%.3f] %s\n%s", "score", "citation", "text").alias("line")).alias("x"))
    joined = rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n\n").alias("lines"))
    out = F.when(is_blank("query"), F.lit(EMPTY_QUERY)).when(F.col("lines").isNull(), F.format_string(NOTHING[corpus], "query")).otherwise(F.col("lines"))
    return queries.join(joined, "query_id", "left").select("query_id", out.alias("output"))


def combined(laws: DataFrame, courts: DataFrame) -> DataFrame:
    """Both tools' outputs under headings."""
    both = laws.withColumnRenamed("output", "laws").join(courts.withColumnRenamed("output", "courts"), "query_id", "full")
    return both.select("query_id", F.concat_ws("\n", F.lit("=== Federal Laws (SR) ==="), "laws", F.lit(""), F.lit("=== Court Decisions ==="), "courts").alias("output"))


def tool_descriptions(tools: dict[str, str]) -> str:
    return "\n\n".join(f"{name}: {text.strip()}" for name, text in tools.items())
