"""Best-fit packing (operator 5): bounded-space online best-fit.

Pieces arrive in a stream; a fixed number of bins stands open. Free spaces that some open bin has are
bits of one integer, so the best fit (the least space that suffices) is a shift and a lowest set bit.
When one bin more than allowed would stand open, the fullest is closed. The pieces of a partition come
in blocks of about as many pieces as bins may be open, longest first within a block.

Pieces are dealt to tasks by a hash of id, piece, length and content and, among equal ones, of a running
number within their input partition, so that neither null ids nor equal rows meet in one task.

Nulls count as empty texts, which still have their end token and are packed. Repeated rows are packed
each; null ids stay null; an empty table gives an empty result; other columns are neither read nor
returned. A text of any length is cut into full pieces, its first one may be shorter. Texts with
long runs without a break (RUN characters of one kind, as white space or one long word) are encoded by the
tokenizers library, since the faster one runs out of stack or time on them.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import BYTE_VOCABULARY, PLAIN_BELOW

LENGTH, END_TOKEN, OPEN_BINS = 1024, 2, 4096
#: Documents that share one packing task; its memory is that of the open bins.
DOCUMENTS_PER_TASK = 50_000
SPECIAL = "<|endoftext|>"
#: Characters without a change between white space and others that the fast library is not given.
RUN = 20_000


class BestFit:
    """Online packer. place(n) gives (sequence number, offset)."""

    def __init__(self, length: int = LENGTH, open_bins: int = OPEN_BINS):
        self.length, self.open_bins = length, open_bins
        self.bits, self.standing, self.made = 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def place(self, n: int) -> tuple[int, int]:
        if not 0 <= n <= self.length:
            raise ValueError("a piece is longer than a sequence")
        fits = self.bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.standing >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, bin_ = self.length, self.made
            self.made += 1
        left = free - n
        if left:
            self.bins[left].append(bin_)
            self.bits |= 1 << left
            self.standing += 1
        return bin_, self.length - free

    def _take(self, free: int) -> int:
        stack = self.bins[free]
        bin_ = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.standing -= 1
        return bin_


def pieces_of(n: int, length: int = LENGTH) -> Iterable[tuple[int, int, int]]:
    """(piece, start, length) of a document of n ids: only the first piece may be short of a full one."""
    first = n % length or min(n, length)
    yield 0, 0, first
    for k, start in enumerate(range(first, n, length), 1):
        yield k, start, length


@lru_cache(maxsize=2)
def fast_encoder(path: str, plain_special: bool = False):
    """The vocabulary in two libraries: one is fast, the other is the yardstick, and used where their character tables may differ.

    plain_special: strings of special tokens in a text are plain text.
    """
    import re

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    from .bpe import byte_alphabet

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = plain_special
    alphabet, special = byte_alphabet(), {}
    ranks = {}
    for token, k in slow.get_vocab(with_added_tokens=True).items():
        if token == SPECIAL:
            special[token] = k
        else:
            ranks[bytes(alphabet[c] for c in token)] = k
    fast = tiktoken.Encoding("paragraf", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    wide = re.compile(f"[^\\x00-{chr(PLAIN_BELOW - 1)}]")
    run = re.compile(rf"\s{{{RUN}}}|\S{{{RUN}}}")

    def encode(text: str) -> list[int]:
        if wide.search(text) or len(text) >= RUN and run.search(text):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text) if plain_special else fast.encode(text, allowed_special="all")

    return encode


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, length: int = LENGTH, end_token: int = END_TOKEN, open_bins: int = OPEN_BINS) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) per piece."""
    import pyarrow as pa

    path = vocabulary or common.vocabulary(BYTE_VOCABULARY)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = fast_encoder(path)
        met: dict[tuple, int] = {}  # documents of this partition; equal ones alone are numbered, so the order of rows is of no matter
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows: list[tuple] = []
                for id_, text in zip(part.column(0).to_pylist(), common.python_strings(part.column(1)), strict=True):
                    ids = np.array([*encode(text), end_token], "<u4").tobytes()
                    alike = (id_, len(ids), zlib.crc32(ids))
                    copy = met[alike] = met.get(alike, -1) + 1
                    rows += [(id_, p, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]), copy) for p, s, n in pieces_of(len(ids) // 4, length)]
                names = ["id", "piece", "start", "length", "ids_crc32", "copy"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = BestFit(length, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [packer.place(n) for n in batch.column("length").to_pylist()]
            more = [pa.array([base + x for x, _ in placed], pa.int64()), pa.array([y for _, y in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")), *more], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    tasks = max(1, -(-df.count() // DOCUMENTS_PER_TASK))
    cut_up = rows.mapInArrow(cut, "id long, piece int, start long, length long, ids_crc32 long, copy long")
    # A total order, so that a task that runs again packs alike; about open_bins pieces have one block number.
    blocks = max(1, DOCUMENTS_PER_TASK * 2 // open_bins)
    mixed = F.xxhash64("id", "piece", "length", "ids_crc32", "copy", F.lit(5))
    dealt = cut_up.withColumn("block", F.pmod(F.shiftright(mixed, 20), F.lit(blocks))).repartition(tasks, mixed)
    ordered = dealt.drop("copy").sortWithinPartitions("block", F.desc("length"), "id", "piece", "start", "ids_crc32")
    return ordered.mapInArrow(place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op5_packing": op5_packing}
SQL: dict[str, str] = {}
