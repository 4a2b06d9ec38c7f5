"""Substring dedup (operator 9): Rabin-Karp hashes of every window of `width` words, counted in Spark.

Documents are dealt to chunks of some megabytes, which are ranges of ids, so that chunks have the order
of documents. A chunk computes the rolling hash of every window at once, keeps the first of equal windows
(the combining before the shuffle, so that a window in a third of all documents costs one entry a chunk)
and sends, for each bucket of the hash range, one row: its number and `key_bytes` bytes a window, no ids.
A bucket counts each hash over all chunks and answers every chunk with one bit an entry: whether the
window starts earlier elsewhere. The chunk, whose shuffled texts Spark uses again, then marks repeated
windows, merges them into maximal intervals of words and removes these. Only bits travel back.

A chunk sends at most `most_buckets` rows. If the input needs more buckets of BUCKET_WINDOWS windows,
buckets are wider and are split by a second deal: BLOCK_CHUNKS chunks in a row are a block, a task takes
the keys of a block in one wide bucket, keeps the first of equal ones and deals them to narrow buckets
by other bits of the hash; answers come back the same two steps.

Windows are compared by their bucket and `key_bytes` bytes of hash: 64 bits of one polynomial and the
rest from another one, whose upper half, not sent, chooses the bucket. As buckets hold about a million
windows, a false match among n windows has odds of about n * 2**20 / 2**73 with the default of 9 bytes:
1e-7 at a billion windows.

"Earlier" is by id, then by start; rows with a null id come first; rows with the same id are ordered by
the md5 of their text, by which chunks split an id that many rows share. Equal rows go through the chunks
once, with their number, so that a flood of them isn't one chunk: all but the first lose every window, that
is all words if there are `width` or more, and come back by that rule.
Null texts have no words. Texts are never cut short. Repeated rows come back each; empty tables give empty results; columns other than id, text and those in `carry`
are neither read nor returned, and results have names of their own, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WIDTH, KEY_BYTES = 20, 9
#: Bytes of text in a chunk, and windows in a bucket, both on average.
CHUNK_BYTES, BUCKET_WINDOWS = 6 << 20, 1 << 20
#: Rows that a chunk sends at most, chunks of a block, and bounds of ranges of ids that are a constant of the plan.
MOST_BUCKETS, BLOCK_CHUNKS, MOST_BOUNDS = 1 << 14, 64, 1 << 16
#: Second bounds are broadcast only if there are at most so many.
BROADCAST_NUMBERS, ROW_BYTES = 4_000_000, 32
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
LOWEST = -(1 << 63)
INTERVALS = "array<struct<start:long,stop:long>>"


class _WordHashes(dict):
    """Hash of each word met in a chunk."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def rolling(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of every window of `width` numbers, by doubling."""
    whole, done, part, size, power = None, 0, words, 1, base
    with np.errstate(over="ignore"):
        while True:
            # windows grow to the left by those of a power of two that the width holds
            if width & size:
                more = part[width - done - size :] if done + size < width else part
                more = more[: len(words) - width + 1]
                if whole is None:
                    whole, shift = more.copy(), power
                else:
                    whole += more * np.uint64(shift)
                    shift = shift * power & (2**64 - 1)
                done += size
            if 2 * size > width:
                return whole
            part = part[:-size] * np.uint64(power) + part[size:]
            power = power * power & (2**64 - 1)
            size *= 2


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def in_order(ids: list, texts: list) -> list[int]:
    """Places of rows by id, null first, then by the md5 of their text."""
    keys = [LOWEST if x is None else x for x in ids]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    if all(keys[a] != keys[b] for a, b in zip(order, order[1:], strict=False)):
        return order
    return sorted(order, key=lambda k: (keys[k], hashlib.md5((texts[k] or "").encode()).digest()))


def firsts_of(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Whether each key is the first of its like."""
    order = np.argsort(high, kind="stable")
    h, c = high[order], low[order]
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    if (same[1:] & (c[1:] != c[:-1])).any():  # a tie of the first hash alone
        order = np.lexsort((low, high))
        h, c = high[order], low[order]
        same[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
    first = np.empty(len(h), bool)
    first[order] = ~same
    return first


def dealt_to(number: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, those of `at` whose number it is), in order."""
    if not len(at):
        return
    order = np.argsort(number, kind="stable")
    at, number = at[order], number[order]
    edges = np.flatnonzero(np.diff(number, prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(at)], strict=True):
        yield int(number[a]), at[a:b]


class Chunk:
    """The documents of one chunk in order, their words and windows."""

    def __init__(self, ids: list, texts: list, width: int):
        self.order = in_order(ids, texts)
        self.ids, self.texts = [ids[k] for k in self.order], [texts[k] or "" for k in self.order]
        self.width = width
        known, hashes = _WordHashes(), []  # words themselves are not kept: they take ten times the space of the text
        for text in self.texts:
            words = text.encode().split()
            hashes.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        self.sizes = np.array([len(h) for h in hashes], np.int64)
        self.ends = np.cumsum(self.sizes)
        del known
        self._windows(np.concatenate(hashes) if hashes else np.empty(0, np.uint64))

    def _windows(self, hashes: np.ndarray) -> None:
        total = len(hashes)
        if total < self.width:
            self.starts, self.high, self.low = (np.empty(0, t) for t in (np.int64, np.uint64, np.uint64))
            return
        inside = np.ones(total - self.width + 1, bool)  # windows that no end of a document cuts
        cut = np.zeros(total + 1, np.int64)
        np.add.at(cut, np.maximum(self.ends - self.width + 1, self.ends - self.sizes), 1)
        np.add.at(cut, self.ends, -1)
        inside &= np.cumsum(cut)[: len(inside)] == 0
        self.starts = np.flatnonzero(inside)
        self.high, self.low = (mix(rolling(hashes, self.width, base)[self.starts]) for base in BASES)

    def firsts(self) -> np.ndarray:
        """Whether each window is the first of its like here."""
        return firsts_of(self.high, self.low)

    def entries(self, first: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, windows): the first windows of each bucket in order."""
        at = np.flatnonzero(first)
        return dealt_to(bucket_of(self.low[at], buckets), at)


def bucket_of(low: np.ndarray, buckets: int) -> np.ndarray:
    """By the upper half of the second hash, of which keys hold lower bytes only: the bucket adds bits to each key."""
    return ((low >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def narrow_of(high: np.ndarray, parts: int) -> np.ndarray:
    return ((high & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


class Keys:
    """Keys of windows as bytes: eight of the first hash, `extra` of the second."""

    def __init__(self, extra: int):
        self.extra = extra

    def packed(self, high: np.ndarray, low: np.ndarray) -> bytes:
        more = np.ascontiguousarray(low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.extra])
        return high.astype("<u8").tobytes() + more.tobytes()

    def unpacked(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """(first hashes, known bytes of the second, number of keys in each row) of all rows, one after another."""
        width = 8 + self.extra
        sizes = [len(x) // width for x in rows]
        high = np.frombuffer(b"".join(x[: 8 * n] for x, n in zip(rows, sizes, strict=True)), "<u8")
        low = np.zeros((len(high), 8), np.uint8)
        low[:, : self.extra] = np.frombuffer(b"".join(x[8 * n :] for x, n in zip(rows, sizes, strict=True)), np.uint8).reshape(len(high), self.extra)
        return high, low.reshape(-1).view("<u8"), sizes


def weight(text_col: str) -> Column:
    """Bytes that a row takes in a chunk, about."""
    return F.coalesce(F.octet_length(text_col), F.lit(0)) + ROW_BYTES


def chunked(rows: DataFrame, size: int, chunks: int, most_bounds: int = MOST_BOUNDS) -> DataFrame:
    """The rows (id, text, ...) with `chunk`, a range of ids: of about as many bytes each, for all that one constant of bounds can hold."""
    key = F.coalesce("id", F.lit(LOWEST))
    ranges = min(chunks, most_bounds)
    if not size or ranges < 2:
        return rows.withColumn("chunk", F.lit(0))
    cells = min(8 * ranges, most_bounds)  # by numbers of rows, then joined by their bytes
    found = rows.agg(F.percentile_approx(key, [k / cells for k in range(1, cells)], 20 * cells)).first()[0]
    at = common.place(common.constant(found), F.lit(len(found)), key, F.col("text"))
    heavy = dict(rows.groupBy(at.alias("cell")).agg(F.sum(weight("text"))).collect())  # a row a cell
    bounds, filled = [], 0
    for cell, bound in enumerate(found):
        filled += heavy.get(cell) or 0
        if filled >= size / ranges:
            bounds.append(bound)
            filled = 0
    rows = rows.withColumn("chunk", common.place(common.constant(bounds), F.lit(len(bounds)), key, F.col("text")))
    if chunks <= most_bounds:
        return rows
    parts = -(-chunks // ranges)
    inside = rows.groupBy("chunk").agg(F.percentile_approx(key, [k / parts for k in range(1, parts)], 20 * parts).alias("inside"))
    inside = F.broadcast(inside) if ranges * parts <= BROADCAST_NUMBERS else inside
    split = rows.join(inside, "chunk")
    return split.withColumn("chunk", F.col("chunk") * parts + common.place(F.col("inside"), F.size("inside"), key, F.col("text"))).drop("inside")


def with_copies(found: DataFrame, width: int) -> DataFrame:
    """Results of rows that stand for `times` equal ones, one a row: later ones lose all words if they have `width` of them."""
    copy = found.withColumn("_copy", F.explode(F.expr("sequence(1L, times)")))
    gone = (F.col("_copy") > 1) & (F.col("n_words") >= width)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop")))
    made = {"n_removed": F.when(gone, F.col("n_words")).otherwise(F.col("n_removed")), "intervals": F.when(gone, whole).otherwise(F.col("intervals")), "kept_text": F.when(gone, F.lit("")).otherwise(F.col("kept_text"))}
    return copy.select(*(made[c].alias(c) if c in made else F.col(c) for c in found.columns if c != "times"))


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, key_bytes: int = KEY_BYTES, untouched: bool = False, carry: tuple[str, ...] = (), buckets: int | None = None, most_buckets: int = MOST_BUCKETS, chunks: int | None = None) -> DataFrame:
    """(id, n_words, n_removed, intervals, kept_text) per row, and the string columns named in `carry` as carried_0, ...

    intervals are the maximal runs of removed words, [start, stop). kept_text joins kept words by one
    space; with `untouched`, a text that loses nothing stays as it was, null too. The numbers of chunks
    and buckets follow the size of the texts unless they are given.
    """
    import pyarrow as pa

    if not 8 <= key_bytes <= 12:
        raise ValueError("key_bytes is 8 to 12")
    spark = df.sparkSession
    parallel = 4 * spark.sparkContext.defaultParallelism
    names = ["id", "text", *(f"carried_{k}" for k in range(len(carry)))]
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *(F.col(c).cast("string").alias(n) for c, n in zip(carry, names[2:], strict=True)))
    rows = common.collapsed(rows)
    size = rows.agg(F.sum(weight("text"))).first()[0] or 0
    chunks = chunks or max(parallel, -(-size // CHUNK_BYTES))
    buckets = buckets or max(parallel, -(-size // (6 * BUCKET_WINDOWS)))
    narrow_parts = -(-buckets // most_buckets)
    wide = -(-buckets // narrow_parts)
    rows = chunked(rows, size, chunks).select("chunk", *names, "times")
    keys = Keys(key_bytes - 8)

    def table(columns: dict[str, tuple[pa.DataType, list]]) -> pa.Table:
        return pa.table({n: pa.array(x, t) for n, (t, x) in columns.items()})

    def sent_rows(block: int, chunk: int, out: list[tuple[int, bytes]]) -> pa.Table:
        return table({"bucket": (pa.int64(), [b for b, _ in out]), "block": (pa.int32(), [block] * len(out)), "chunk": (pa.int32(), [chunk] * len(out)), "keys": (pa.binary(), [k for _, k in out])})

    def send(rows: pa.Table) -> pa.Table:
        chunk = Chunk(rows.column("id").to_pylist(), rows.column("text").to_pylist(), width)
        number = rows.column("chunk")[0].as_py()
        return sent_rows(number // BLOCK_CHUNKS, number, [(b, keys.packed(chunk.high[at], chunk.low[at])) for b, at in chunk.entries(chunk.firsts(), wide)])

    def by_chunk(rows: pa.Table) -> pa.Table:
        return rows.sort_by("chunk")

    def narrow(rows: pa.Table) -> pa.Table:
        """Of a wide bucket and a block: the first of equal keys, dealt to narrow buckets."""
        rows = by_chunk(rows)
        high, low, _ = keys.unpacked(rows.column("keys").to_pylist())
        at = np.flatnonzero(firsts_of(high, low))
        bucket, block = rows.column("bucket")[0].as_py(), rows.column("block")[0].as_py()
        return sent_rows(block, block, [(bucket * narrow_parts + n, keys.packed(high[some], low[some])) for n, some in dealt_to(narrow_of(high[at], narrow_parts), at)])

    def answered(rows: pa.Table, repeated: np.ndarray, sizes: list[int]) -> pa.Table:
        ends = np.cumsum(sizes)
        return table({"chunk": (pa.int32(), rows.column("chunk").to_pylist()), "bucket": (pa.int64(), rows.column("bucket").to_pylist()), "bits": (pa.binary(), [np.packbits(repeated[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)])})

    def count(rows: pa.Table) -> pa.Table:
        """Of a bucket: for each entry whether an earlier chunk has it."""
        rows = by_chunk(rows)
        high, low, sizes = keys.unpacked(rows.column("keys").to_pylist())
        return answered(rows, ~firsts_of(high, low), sizes)

    def widen(rows: pa.Table, answers: pa.Table) -> pa.Table:
        """Answers of narrow buckets to a block, as answers of a wide bucket to its chunks."""
        rows = by_chunk(rows)
        high, low, sizes = keys.unpacked(rows.column("keys").to_pylist())
        first = firsts_of(high, low)
        repeated, at = ~first, np.flatnonzero(first)
        bits = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True))
        bucket = rows.column("bucket")[0].as_py()
        for n, some in dealt_to(narrow_of(high[at], narrow_parts), at):
            repeated[some] = np.unpackbits(np.frombuffer(bits[bucket * narrow_parts + n], np.uint8), count=len(some)).astype(bool)
        return answered(rows, repeated, sizes)

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        carried = {n: table.column(n).to_pylist() for n in names[2:]}
        ids, texts = table.column("id").to_pylist(), table.column("text").to_pylist()
        chunk = Chunk(ids, texts, width)
        first = chunk.firsts()
        repeated = ~first
        bits = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True))
        for bucket, at in chunk.entries(first, wide):
            repeated[at] |= np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=len(at)).astype(bool)
        total = int(chunk.sizes.sum())
        change = np.zeros(total + 1, np.int64)
        starts = chunk.starts[repeated]
        change[starts] += 1
        np.add.at(change, starts + width, -1)
        gone = np.cumsum(change)[:total] > 0
        kept, removed, intervals = [], [], []
        for k, (end, n) in enumerate(zip(chunk.ends.tolist(), chunk.sizes.tolist(), strict=True)):
            mask = gone[end - n : end]
            if not mask.any():
                removed.append(0)
                intervals.append([])
                kept.append(texts[chunk.order[k]] if untouched else b" ".join(chunk.texts[k].encode().split()).decode())
                continue
            edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
            spans = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
            removed.append(int(mask.sum()))
            intervals.append([{"start": a, "stop": b} for a, b in spans])
            kept.append(b" ".join([w for w, g in zip(chunk.texts[k].encode().split(), mask.tolist(), strict=True) if not g]).decode())
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        columns = [pa.array(chunk.ids, pa.int64()), pa.array(chunk.sizes), pa.array(removed, pa.int64()), pa.array(intervals, span), pa.array(kept, pa.string())]
        columns += [pa.array([carried[n][k] for k in chunk.order], pa.string()) for n in names[2:]]
        columns.append(table.column("times").take(pa.array(chunk.order, pa.int64())))
        return pa.table(columns, names=["id", "n_words", "n_removed", "intervals", "kept_text", *names[2:], "times"])

    partitions = common.partitions(spark)
    dealt = rows.repartition(partitions, "chunk")
    sent_shape, answer_shape = "bucket long, block int, chunk int, keys binary", "chunk int, bucket long, bits binary"
    sent = dealt.groupBy("chunk").applyInArrow(send, sent_shape)
    if narrow_parts == 1:
        answers = sent.groupBy("bucket").applyInArrow(count, answer_shape)
    else:
        sent = sent.repartition(partitions, "bucket", "block")
        inner = sent.groupBy("bucket", "block").applyInArrow(narrow, sent_shape).groupBy("bucket").applyInArrow(count, answer_shape)
        inner = inner.select(F.floor(F.col("bucket") / narrow_parts).cast("long").alias("wide"), F.col("chunk").alias("block"), "bucket", "bits")
        answers = sent.groupBy("bucket", "block").cogroup(inner.repartition(partitions, "wide", "block").groupBy("wide", "block")).applyInArrow(widen, answer_shape)
    result = "id long, n_words long, n_removed long, intervals " + INTERVALS + ", kept_text string" + "".join(f", {n} string" for n in names[2:])
    found = dealt.groupBy("chunk").cogroup(answers.repartition(partitions, "chunk").groupBy("chunk")).applyInArrow(cut, result + ", times long")
    return with_copies(found, width)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove(common.table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op9_substring_dedup": op9_substring_dedup}
SQL = {
    "op9_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(text, ''))) AS n, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT n, i AS s, array_to_string(w[i:i + 19], ' ') AS t FROM (SELECT n, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
repeated AS (SELECT n, s AS i, 1 AS hit FROM (SELECT n, s, row_number() OVER (PARTITION BY t ORDER BY n, s) AS k FROM windows) WHERE k > 1),
words AS (SELECT n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
marked AS (SELECT n, i, word, coalesce(max(hit) OVER (PARTITION BY n ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS gone FROM words LEFT JOIN repeated USING (n, i)),
kept AS (SELECT n, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS t FROM marked GROUP BY n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (n)
"""
}
