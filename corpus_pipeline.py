"""Corpus pipeline: toxic documents go, one document of near copies stays, repeated passages go, the rest is packed.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last give
the columns of documents (doc_id, text, lang, source, n_chars); other columns are not carried, so that
their names can't clash.

Rows with null ids pass through near dedup, since ids choose who stays; the other stages treat them as any.
Null texts count as empty: they are not toxic, so the first stage keeps them; of all null, empty and blank
texts near dedup keeps one, that of the smallest id; a null text that stays is null until it is packed,
as its end token alone; its n_chars are those of the input, and 0 after substring dedup, which counts anew. Very long texts are taken whole by every stage. Of equal texts, and of equal rows,
that of the smallest id stays, and one of those with the same id; equal rows with null ids all stay, and
lose repeated passages. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paragraf.llm import common, near_copies, packing, substring, toxicity
from paragraf.session import delete_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows of an Arrow batch at most: whole texts and sets of shingles are long, and a batch is held by Spark and by Python.
ARROW_ROWS, ARROW_SETTING = 1024, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Shuffle files go when the step that wrote them ends, not when the driver's memory happens to be collected.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _ready(spark: SparkSession) -> None:
    """The session as stages need it; a smaller bound on batches that it has stays."""
    common.ready(spark)
    if not 0 < int(spark.conf.get(ARROW_SETTING, "10000")) <= ARROW_ROWS:
        spark.conf.set(ARROW_SETTING, str(ARROW_ROWS))
    spark.conf.set(CLEANUP_SETTING, "true")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject; it is learned from labelled documents of the input."""
    _ready(spark)
    docs = docs.select(*COLUMNS)
    grammar = toxicity.grammar_for(spark, sf_dir, docs)
    return toxicity.score(docs, grammar).where("_score < 0.5").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of copies and near copies."""
    _ready(spark)
    return near_copies.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 20 words or more that an earlier one has; untouched texts stay as they were."""
    _ready(spark)
    found = substring.remove(docs, untouched=True, carry=("lang", "source"))
    return found.select(F.col("id").alias("doc_id"), F.col("kept_text").alias("text"), F.col("carried_0").alias("lang"), F.col("carried_1").alias("source"), F.coalesce(F.length("kept_text"), F.lit(0)).cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: one row a piece of a document."""
    _ready(spark)
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", toxic), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", pack)]

#: SQL can express neither the learned grammar nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet in the shared folder and read again."""
    import uuid

    docs = common.table(spark, sf_dir, "documents")
    folder, before = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for n, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if n == len(STAGES) - 1:
            return made  # reads the last folder, which stays
        made.write.parquet(f"{folder}/{n}-{name}")
        docs = spark.read.parquet(f"{folder}/{n}-{name}")
        if before:
            delete_folder(spark, before)
        before = f"{folder}/{n}-{name}"
    return docs
