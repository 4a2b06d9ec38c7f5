"""Readers and writers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import split_csv

LAWS = "citation string, text string, title string"
COURTS = "citation string, text string"
QUERIES = "query_id string, query string, gold_citations string"
SUBMISSION = "query_id string, predicted_citations string"
EDGES = "source string, target string, weight double, tf long"


class MissingColumns(ValueError):
    """A table lacks required columns."""


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise MissingColumns(f"missing required columns: {missing}")
    return df


def ordinal(df: DataFrame, name: str = "ord") -> DataFrame:
    """Row numbers in file order, not dense, increasing with files by their path and place in them."""
    return df.withColumn(name, F.monotonically_increasing_id())


#: Quotes of fields, and within them.
QUOTING = {"quote": '"', "escape": '"', "multiLine": "true"}


def headed(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """A headed CSV file as strings and `ord`, increasing in file order. All cores read it, also where quoted fields hold line breaks (`split_csv`).

    Without `multiline`, a record is a line, which Spark's own reader splits.
    """
    raw = spark.read.options(header="true", encoding="utf-8", **QUOTING | {"multiLine": str(multiline).lower()}).csv(path)
    found = split_csv.records(spark, path) if multiline else None
    if found is None:
        return ordinal(raw)
    shape = ", ".join(f"c{k} string" for k in range(len(raw.columns))) or "c0 string"
    parsed = found.select("at", F.from_csv("record", shape, QUOTING).alias("r"))
    return parsed.select(*(F.col(f"r.c{k}").alias(name) for k, name in enumerate(raw.columns)), F.col("at").alias("ord"))


def read_csv(spark: SparkSession, path: str, schema: str, multiline: bool = True) -> DataFrame:
    """A headed CSV file, by header names whatever their order; columns of the schema that the file lacks are null."""
    wanted = T._parse_datatype_string(schema)
    raw = headed(spark, path, multiline)
    known = raw.columns[:-1]
    return raw.select(*[(F.col(f"`{f.name}`") if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted.fields], "ord")


def convert(spark: SparkSession, csv_path: str, path: str, schema: str = LAWS) -> DataFrame:
    """A CSV corpus as Parquet, in file order."""
    read_csv(spark, csv_path, schema).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_corpus_csv(spark: SparkSession, path: str, max_rows: int | None = None, multiline: bool = True) -> DataFrame:
    """A corpus with empty texts for null ones; max_rows None or 0 is all."""
    rows = read_csv(spark, path, LAWS, multiline)
    rows = rows.select("ord", *[F.coalesce(c, F.lit("")).alias(c) for c in ("citation", "text", "title")])
    return rows.orderBy("ord").limit(max_rows) if max_rows else rows


def read_jsonl(spark: SparkSession, path: str, schema: str = LAWS) -> DataFrame:
    """One JSON object a line; blank lines are left out."""
    return ordinal(spark.read.schema(schema).json(path))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("quote", '"').option("escape", '"').csv(path, header=True)


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    return _filled(require_columns(headed(spark, path).drop("ord"), "query_id", "predicted_citations"), "predicted_citations")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return _filled(require_columns(headed(spark, path).drop("ord"), "query_id", "gold_citations"), "gold_citations")


def _filled(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.coalesce(name, F.lit("")))


def write_submission(predictions: DataFrame, path: str) -> None:
    """(query_id, citations array) with `;` between citations, a blank for none."""
    joined = F.array_join("citations", ";")
    write_csv(predictions.select("query_id", F.when(joined == "", F.lit(" ")).otherwise(joined).alias("predicted_citations")), path)


def read_abbreviations(spark: SparkSession, path: str) -> DataFrame:
    """(ord, id, de, fr, it) of a JSON list of objects with id and abbrev {de, fr, it}."""
    rows = spark.read.schema("id string, abbrev struct<de:string,fr:string,it:string>").option("multiLine", True).json(path)
    return ordinal(rows.select("id", "abbrev.*"))


def write_log(log: DataFrame, path: str) -> None:
    """A run's log as CSV, arrays and structs as JSON."""
    flat = [F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in log.dtypes]
    write_csv(log.select(*flat), path)


def first_path(spark: SparkSession, *paths: str) -> str | None:
    """The first path that exists, by Spark's own file systems."""
    jvm = spark._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return path
    return None


def spread(df: DataFrame, split_bytes: int = 4 << 20) -> DataFrame:
    """Rows dealt to all cores where an input is too small, or its files hold too few row groups, to give every core a split.

    Inputs of more than `split_bytes` a core are left as they are: their scans have splits enough, and
    their rows stay where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * split_bytes else df
