"""Sparse retrieval: a postings table and Okapi scores for many queries in one plan.

Scores sum idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)) over a query's tokens, repeats
included; idf is ln(N - df + 0.5) - ln(df + 0.5), and terms below zero get epsilon times the mean of
idf over all terms. Hits have scores above zero. Scores are ranked by their first nine decimals, as
sums in another order differ in the last bits; equal ones go to the larger document id.

Postings lie by document: terms are counted within the row that a text is read in, so a partition holds
all terms of its documents and no text is shuffled. `segments` keeps an index that grows, and prunes it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import bind, filled, is_blank, tokenize
from ..session import stable
from ..sources import spread

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Query terms are broadcast only if counting shows at most this many rows.
BROADCAST_ROWS = 1_000_000
#: Scores that a task adds up.
TASK_SCORES = 500_000


@dataclass
class SparseIndex:
    """postings: (doc_id, dl, term, tf), so that scoring needs no join for lengths; terms: (term, df, raw_idf); three numbers.

    Postings of an index that was built are kept by executors, who work lost ones out again; `release` gives them back.
    """

    postings: DataFrame
    terms: DataFrame
    count: int
    average_length: float
    mean_idf: float
    k1: float = K1
    b: float = B
    epsilon: float = EPSILON

    def idf(self) -> DataFrame:
        return self.terms.select("term", F.when(F.col("raw_idf") < 0, F.lit(self.epsilon * self.mean_idf)).otherwise(F.col("raw_idf")).alias("idf"))

    def release(self) -> None:
        self.postings.unpersist()

    def save(self, path: str) -> None:
        """Postings are written in order of terms, so that row groups without a query's terms are skipped."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        numbers = [(self.count, self.average_length, self.mean_idf, self.k1, self.b, self.epsilon)]
        self.postings.sparkSession.createDataFrame(numbers, "count long, average_length double, mean_idf double, k1 double, b double, epsilon double").write.mode("overwrite").parquet(f"{path}/numbers")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SparseIndex:
        numbers = spark.read.parquet(f"{path}/numbers").first()
        return cls(*(spark.read.parquet(f"{path}/{n}") for n in ("postings", "terms")), **numbers.asDict())


def counted(tokens: Column) -> Column:
    """(term, tf) of an array of tokens, counted within the row."""

    def runs(in_order: Column) -> Column:
        n = F.size(in_order)
        starts = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(in_order, i) != F.get(in_order, i - 1)))).otherwise(F.array().cast("array<int>"))
        return bind(starts, lambda s: F.transform(s, lambda at, j: F.struct(F.get(in_order, at).alias("term"), (F.coalesce(F.get(s, j + 1), n) - at).cast("long").alias("tf"))))

    return bind(F.array_sort(tokens), runs)


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, k1: float = K1, b: float = B, epsilon: float = EPSILON) -> SparseIndex:
    """Index of a corpus; null texts have no tokens, but count. `tokens` replaces the tokenizer by a column.

    Texts are tokenized once: postings are kept for the statistics and the searches that follow. Every row is
    a document; small inputs are dealt to all cores first.
    """
    words = tokenize(text_col) if tokens is None else tokens
    split = spread(docs).select(F.col(id_col).alias("doc_id"), words.alias("tokens"))
    postings = split.select("doc_id", F.size("tokens").alias("dl"), F.explode(counted(F.col("tokens"))).alias("t")).select("doc_id", "dl", "t.term", "t.tf").cache()
    count = docs.count()
    raw = F.ln(F.lit(float(count)) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    terms = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n")).withColumn("raw_idf", raw)
    sums = terms.agg(F.sum("n").alias("n"), F.avg("raw_idf").alias("mean")).first()
    return SparseIndex(postings, terms.drop("n"), count, (sums.n or 0) / count if count else 0.0, float(sums.mean or 0.0), k1, b, epsilon)


#: What says that there is no index, or one that can't be read; all else, as a refused permission, is an error.
ABSENT = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "CANNOT_READ_FILE_FOOTER", "FAILED_READ_FILE", "UNRESOLVED_COLUMN")


def get_or_build(spark: SparkSession, path: str, docs: DataFrame, force: bool = False, **options) -> SparseIndex:
    """The saved index, or, if there is none that can be read or `force`, one that is built and saved."""
    if not force:
        try:
            return SparseIndex.load(spark, path)
        except (AnalysisException, PySparkException) as error:
            if not str(error.getCondition() or "").startswith(ABSENT):
                raise
    build(docs, **options).save(path)
    return SparseIndex.load(spark, path)


def scores(queries: DataFrame, index: SparseIndex, id_col: str = "query_id", text_col: str = "query", tokens: Column | None = None) -> DataFrame:
    """(query_id, doc_id, score) of all documents that share a term with a query."""
    words = tokenize(text_col) if tokens is None else tokens
    asked = queries.select(F.col(id_col).alias("query_id"), F.explode(words).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    asked = asked.join(index.idf(), "term")
    asked = stable(asked)
    asked_rows = asked.count()
    size = asked.select("query_id").distinct().count() * index.count
    postings = index.postings
    if (parts := -(-size // TASK_SCORES)) > int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        # a task holds all postings of its documents that are asked for, and adds up no other document's scores
        terms = asked.select("term").distinct()
        postings = postings.join(F.broadcast(terms) if asked_rows <= BROADCAST_ROWS else terms, "term", "left_semi").repartition(parts, "doc_id")
    met = postings.join(F.broadcast(asked) if asked_rows <= BROADCAST_ROWS else asked, "term")
    part = F.col("idf") * F.col("tf") * (index.k1 + 1) / (F.col("tf") + F.lit(index.k1) * (F.lit(1 - index.b) + F.lit(index.b) * F.col("dl") / F.lit(index.average_length)))
    return met.groupBy("query_id", "doc_id").agg(F.sum(F.col("times") * part).alias("score"))


def search(queries: DataFrame, index: SparseIndex, k: int = 10, **columns) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best hits; k <= 0 gives none."""
    ranked = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.desc("doc_id"))
    found = scores(queries, index, **columns).where("score > 0").withColumn("rank", F.row_number().over(ranked))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def blank_queries(queries: DataFrame, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    return queries.where(is_blank(filled(text_col))).select(F.col(id_col).alias("query_id"))
