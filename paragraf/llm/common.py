"""Shared plumbing of the training-data operators: table access, checkpoints, worker imports."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ready, shared_folder, stable

__all__ = ["bounds_below", "checkpoint", "collapsed", "constant", "fresh", "partitions", "place", "python_strings", "ready", "shared_folder", "table", "vocabulary"]

#: Keys of repeated rows are broadcast up to so many.
BROADCAST_KEYS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; every query reads through Spark so that remote stores work."""
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with files in the shared folder."""
    return stable(df)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; PARAGRAF_TOKENIZERS overrides its folder."""
    folder = os.environ.get("PARAGRAF_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def constant(values: list[int]) -> Column:
    """An array of numbers that is short in the plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def bounds_below(bounds: Column, count: Column, key: Column, or_equal: bool = False) -> Column:
    """How many of the sorted bounds are below a key (or equal to it), by binary search."""
    middle = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    before = (lambda x: x <= key) if or_equal else (lambda x: x < key)
    span = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    return F.aggregate(
        F.sequence(F.lit(1), F.ceil(F.log2(count + 1)).cast("int") + 1),
        span(F.lit(0), count),
        lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(F.when(before(F.get(bounds, middle(s))), span(middle(s) + 1, s["hi"])).otherwise(span(s["lo"], middle(s)))),
        lambda s: s["lo"],
    )


def place(bounds: Column, count: Column, key: Column, text: Column) -> Column:
    """Number of the range of keys, 0 to count, that a row falls to, in order of (key, md5 of the text).

    A key that is itself a bound, once or several times, as one that many rows share is, has its rows
    spread over the ranges that meet there, by their texts.
    """
    low, high = bounds_below(bounds, count, key), bounds_below(bounds, count, key, or_equal=True)
    part = F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return F.when(low == high, low).otherwise(low + F.floor(part * (high - low + 1)).cast("int")).cast("int")


def collapsed(rows: DataFrame, text: str = "text") -> DataFrame:
    """The rows with equal ones as one, and `times`, their number.

    Only rows that do occur several times are shuffled with their texts, and each task sends one of a kind;
    which these are is found by the md5 of the text.
    """
    keys = [c for c in rows.columns if c != text]
    marked = rows.withColumn("_mark", F.md5(F.col(text).cast("binary")))
    found = checkpoint(marked.groupBy(*keys, "_mark").agg(F.count("*").alias("times")).where("times > 1"))
    several = found.count()
    if not several:
        return rows.withColumn("times", F.lit(1).cast("long"))
    known = found.select(*(F.col(c).alias(f"_k{n}") for n, c in enumerate([*keys, "_mark"])), "times")
    alike = [F.col(c).eqNullSafe(F.col(f"_k{n}")) for n, c in enumerate([*keys, "_mark"])]
    joined = marked.join(F.broadcast(known) if several <= BROADCAST_KEYS else known, alike, "left").select(*rows.columns, "_mark", "times")
    once = joined.where("times is null").select(*rows.columns, F.lit(1).cast("long").alias("times"))
    more = joined.where("times is not null").groupBy(*keys, "_mark").agg(F.min(text).alias(text), F.max("times").alias("times"))
    return once.unionByName(more.select(*rows.columns, "times"))


def python_strings(column) -> list[str]:
    """Texts of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]
