"""SimHash near-dedup (operator 1): meet-in-the-middle ball hashing.

A document's fingerprint is the majority of its shingles' 64-bit hashes, bit by bit. Two fingerprints
within `radius` bits have a common variant within radius/2 bits of both: every distinct fingerprint
emits all its variants within half the radius, a shuffle brings equal variants together, and each
colliding pair that is kept is verified by its own distance. All fingerprints beside one variant v lie
within radius of each other, so linking each to the next one in v's bucket loses no connection, and a
bucket can hold no more than the number of variants: no group, however many copies it has, grows beyond
that, since equal fingerprints were made one before.

Null texts count as empty, and texts without words get fingerprint zero and are linked like any other.
Rows with a null id take part, and are left out of the smallest id; a group with null ids only has a
null component. Texts of any length are taken whole, SLICE shingles at a time. Repeated rows come back as often as they came; empty tables give empty results; columns
other than id and text are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS, RADIUS, SEED, BITS = 3, 2, 42, 64
#: Shingles whose bits are counted at once.
SLICE = 16_384


def fingerprint(text: str, words: int = WORDS) -> bytes:
    """Eight bytes, the highest bit first."""
    import xxhash

    from functools import partial

    tokens = text.encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not tokens:
        return bytes(BITS // 8)
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = list(map(b" ".join, zip(*(tokens[k:] for k in range(words)), strict=False)))
    digest, counts = partial(xxhash.xxh64_digest, seed=SEED), np.zeros(BITS, np.int64)
    for k in range(0, len(shingles), SLICE):
        raw = np.frombuffer(b"".join(map(digest, shingles[k : k + SLICE])), np.uint8)
        counts += np.unpackbits(raw.reshape(-1, BITS // 8), axis=1).sum(0, dtype=np.uint32)
    return np.packbits(2 * counts > len(shingles)).tobytes()


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit number."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                raw = b"".join(fingerprint(x, words) for x in common.python_strings(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.frombuffer(raw, ">i8").astype("i8"))], ["id", "fp"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def ball(radius: int, bits: int = BITS) -> list[int]:
    """Masks of all changes of up to `radius` bits, as signed numbers."""
    masks = [sum(1 << b for b in some) for n in range(radius + 1) for some in combinations(range(bits), n)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) verified links between distinct fingerprints (fp) that connect all pairs within `radius` bits (even)."""
    if radius % 2:
        raise ValueError("the radius is even, half of it on either side")
    masks = F.array(*[F.lit(m) for m in ball(radius // 2)])
    variants = distinct.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    from pyspark.sql import Window

    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    pairs = variants.select("fp", before.alias("other")).where("other is not null")
    return pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius).select(F.col("other").alias("a"), F.col("fp").alias("b")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id) per row; component_id is the smallest id that links lead to."""
    prints = common.checkpoint(fingerprints(df, id_col, text_col, words))
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # written, so that the join below shuffles both sides and Spark can split a large component
    rooted = common.checkpoint(rooted)
    smallest = common.checkpoint(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    classes = rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash": op1_simhash}
SQL: dict[str, str] = {}
