"""Token counts (operator 4): overlap resynchronisation for huge documents.

Documents up to `chunk` characters go to the library in batches. A longer one is encoded in chunks
that overlap, with offsets. Two neighbours are spliced at a boundary in their overlap that is proven
stable: a white-space character, which this vocabulary's normaliser and pre-tokeniser never join with
what stands beside it, at which both encodings have a token boundary and around which they agree on
the tokens up to the white space on either side. If an overlap has none (one huge word, say), it is
widened twofold and both are encoded again, in the end up to the whole text: counts are always exact.

Nulls count as empty texts. Rows are handled one by one: repeated rows and null ids come back as they
went in, an empty table gives an empty result, other columns are neither read nor returned.
"""

from __future__ import annotations

import os
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORD_VOCABULARY = "word_bpe_49k.json"
#: Characters of a chunk, of an overlap, and of a batch of short documents.
CHUNK, OVERLAP, BATCH = 65_536, 1_024, 262_144
LIMIT = 2048


@lru_cache(maxsize=4)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return own


def stable_boundary(text: str, low: int, high: int, left: list[tuple[int, int, int]], right: list[tuple[int, int, int]]) -> int | None:
    """The proven boundary in text[low:high] that is nearest to its middle; left and right: (start, end, id) of tokens."""
    spaces = [k for k in range(low, high) if text[k].isspace() and not "\x1c" <= text[k] <= "\x1f"]  # what the vocabulary takes for white space
    if len(spaces) < 3:
        return None
    starts = [[x[0] for x in side] for side in (left, right)]

    def between(side: int, a: int, b: int) -> list[tuple[int, int, int]]:
        tokens = (left, right)[side]
        return tokens[bisect_left(starts[side], a) : bisect_left(starts[side], b)]

    def clean(side: int, at: int) -> bool:
        k = bisect_left(starts[side], at)
        return k == 0 or (left, right)[side][k - 1][1] <= at

    middle = (low + high) // 2
    for k in sorted(range(1, len(spaces) - 1), key=lambda k: abs(spaces[k] - middle)):
        at = spaces[k]
        if clean(0, at) and clean(1, at) and between(0, spaces[k - 1], spaces[k + 1]) == between(1, spaces[k - 1], spaces[k + 1]):
            return at
    return None


def count_long(text: str, own, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text of any length."""

    def encoded(a: int, b: int) -> list[tuple[int, int, int]]:
        found = own.encode(text[a:b], add_special_tokens=False)
        return [(a + x, a + y, k) for (x, y), k in zip(found.offsets, found.ids, strict=True)]

    size, total = len(text), 0
    start, end = 0, min(chunk, len(text))  # of the chunk in hand; its tokens before `start` are counted already
    tokens = encoded(start, end)
    while end < size:
        wide = overlap
        while True:
            low = max(start, end - wide)
            after = min(size, low + max(chunk, 2 * wide))
            following = encoded(low, after)
            at = stable_boundary(text, low, end, tokens, following)
            if at is not None:
                break
            if low == start:  # the overlap is all that is left of this chunk: take both as one
                low = start
                following = encoded(low, after)
                at = start
                break
            wide *= 2
        total += sum(1 for x in tokens if x[0] < at)
        tokens = [x for x in following if x[0] >= at]
        start, end = at, after
        if at == low and at < end < size and after - low <= chunk:  # no progress by this chunk size: grow it
            chunk *= 2
    return total + len(tokens)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each text."""
    import pyarrow as pa

    path = vocabulary or common.vocabulary(WORD_VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = library(path)
        for batch in batches:
            n_bytes, counts = [], []
            held: list[str] = []
            at: list[int] = []
            size = 0

            def flush() -> None:
                nonlocal size
                for k, found in zip(at, own.encode_batch(held, add_special_tokens=False), strict=True):
                    counts[k] = len(found)
                held.clear()
                at.clear()
                size = 0

            for k in range(0, batch.num_rows, 256):
                for text in common.python_strings(batch.column(1).slice(k, 256)):
                    n_bytes.append(len(text.encode()))
                    if len(text) > chunk:
                        counts.append(count_long(text, own, chunk, overlap))
                        continue
                    at.append(len(counts))
                    counts.append(0)
                    held.append(text)
                    size += len(text)
                    if size >= BATCH:
                        flush()
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op4_token_counts": op4_token_counts}
SQL: dict[str, str] = {}
