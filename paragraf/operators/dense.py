"""Dense retrieval: normalised vectors, exact inner products, top k.

Queries are a stated set: they are packed into blocks of rows, and every partition of the corpus
multiplies its vectors by each block and hands on k hits a query only, so no pair of a query and a
document is ever a row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import as_column

#: Queries held by a task at a time; a larger set is gone through block by block.
QUERIES_PER_BLOCK = 16_384
#: Queries and documents that are multiplied at once, which bounds a task's memory whatever the numbers of both.
TILE_QUERIES, TILE_DOCS = 512, 2048
NONE = np.iinfo(np.int64).max


def norm(vec: Column | str) -> Column:
    return F.sqrt(F.aggregate(as_column(vec), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(vec: Column | str) -> Column:
    """Length one; zero vectors stay."""
    vec = as_column(vec)
    n = norm(vec)
    return F.when(n > 0, F.transform(vec, lambda x: x.cast("double") / n)).otherwise(F.transform(vec, lambda x: x.cast("double")))


def mean_vectors(df: DataFrame, key_col: str, vec_col: str) -> DataFrame:
    """(key, vec): element-wise mean of a key's vectors."""
    each = df.select(F.col(key_col), F.posexplode(vec_col).alias("i", "x")).groupBy(key_col, "i").agg(F.avg("x").alias("x"))
    parts = F.array_sort(F.collect_list(F.struct("i", "x")))
    return each.groupBy(key_col).agg(F.transform(parts, lambda p: p["x"]).alias("vec"))


def dimension(df: DataFrame, vec_col: str = "vec") -> int:
    """The one length that all vectors have."""
    sizes = [r[0] for r in df.where(F.col(vec_col).isNotNull()).select(F.size(vec_col)).distinct().limit(2).collect()]
    if len(sizes) != 1:
        raise ValueError(f"vectors of lengths {sorted(sizes)}")
    return sizes[0]


def merge_best(top_s: np.ndarray, top_d: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
    """Put the documents of a tile among the best of each query, in place: largest score first, ties to the smaller id; free places hold no number and NONE."""
    k = top_s.shape[1]
    least = top_s[:, -1]
    if k <= scores.shape[1] and np.isnan(least).any():
        least = np.fmax(least, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k])
    row, at = np.nonzero(~(scores < least[:, None]))  # what has no number stays, and comes last
    if not len(row):
        return
    rows = np.concatenate((np.repeat(np.arange(len(top_s)), k), row))
    every_s, every_d = np.concatenate((top_s.ravel(), scores[row, at])), np.concatenate((top_d.ravel(), ids[at]))
    order = np.lexsort((every_d, -every_s, rows))
    starts = np.searchsorted(rows[order], np.arange(len(top_s)))
    best = order[starts[:, None] + np.arange(k)]
    top_s[:], top_d[:] = every_s[best], every_d[best]


def search(queries: DataFrame, corpus: DataFrame, k: int = 10, query_id: str = "query_id", query_vec: str = "vec", doc_id: str = "doc_id", doc_vec: str = "vec", block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """(query_id, rank, doc_id, score): the k largest inner products, negative ones too; ties to the smaller id."""
    import pyarrow as pa

    asked = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(query_vec).cast("array<double>").alias("vec")).where("vec is not null")
    count = asked.count()
    blocks = max(1, -(-count // block))
    docs = corpus.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_vec).cast("array<double>").alias("vec")).where("vec is not null")
    found = []
    for n in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n) if blocks > 1 else asked
        rows = part.collect()  # at most about `block` queries
        if not rows:
            continue
        ids, matrix = np.array([r.query_id for r in rows]), np.array([r.vec for r in rows])

        def best(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, matrix: np.ndarray = matrix) -> Iterator[pa.RecordBatch]:
            top_s, top_d = np.full((len(ids), k), np.nan), np.full((len(ids), k), NONE)
            for batch in batches:
                for at in range(0, batch.num_rows, TILE_DOCS):
                    part = batch.slice(at, TILE_DOCS)
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    d = part.column(0).to_numpy()
                    for q in range(0, len(ids), TILE_QUERIES):
                        merge_best(top_s[q : q + TILE_QUERIES], top_d[q : q + TILE_QUERIES], matrix[q : q + TILE_QUERIES] @ x.T, d)
            row, place = np.nonzero(top_d != NONE)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(top_d[row, place]), pa.array(top_s[row, place])], ["query_id", "doc_id", "score"])

        found.append(docs.mapInArrow(best, "query_id long, doc_id long, score double"))
    if not found:
        return asked.sparkSession.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return every.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def embed(df: DataFrame, embedder, text_col: str = "text", out_col: str = "vec", batch: int = 100, attempts: int = 5, wait: float = 2.0) -> DataFrame:
    """The frame with vectors of an injected embedder (list of texts -> list of vectors), made once a worker, with retries that wait twice as long each time; blank texts are sent as one blank."""
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import time

        model = embedder() if isinstance(embedder, type) else embedder
        for texts in batches:
            out: list = []
            for at in range(0, len(texts), batch):
                part = [t if t and t.strip() else " " for t in texts[at : at + batch]]
                for n in range(attempts):
                    try:
                        out += [list(map(float, v)) for v in model(part)]
                        break
                    except Exception:
                        if n == attempts - 1:
                            raise
                        time.sleep(wait * 2**n)
            yield pd.Series(out)

    return df.withColumn(out_col, run(F.col(text_col)))


def build(docs: DataFrame, embedder, chunker: Column | None = None, preprocess: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunk rows with vectors: the columns of docs but the text, chunk_index, n_chunks, chunk, vec (normalised). preprocess and chunker are columns over the text column."""
    text = F.coalesce(F.col(text_col), F.lit("")) if preprocess is None else preprocess
    ready = docs.withColumn(text_col, text)
    parts = F.array(F.col(text_col)) if chunker is None else chunker
    rows = ready.withColumn("_parts", parts).select(*[c for c in docs.columns if c != text_col], F.size("_parts").alias("n_chunks"), F.posexplode("_parts").alias("chunk_index", "chunk"))
    return embed(rows, embedder, "chunk", "vec").withColumn("vec", normalize("vec"))


def save(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
