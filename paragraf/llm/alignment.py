"""Cross-tokenizer alignment (operator 11): id-striped dense count matrices.

A text, with a space before it, is encoded by a byte-level vocabulary (A) and by a piece vocabulary (B). Byte
offsets at which tokens of both end cut it into groups, and each such offset links the two tokens that end
there. Corpus-wide, an id pair's count is the number of its links, and a B id's best partners are those of its
highest count.

Encoding writes, once, a row per document with its links as numbers b * |A| + a, in chunks of about
CHUNK_LINKS links that lie in one partition. Stripe s holds the B ids that leave s modulo the number of
stripes. A task adds up its own links and sends each stripe one row of pairs with counts; a chunk sends each
stripe one row of its distinct pairs, as a request. A stripe's rows are sorted, counts first, and stream
through one block of (its B ids) x (A ids) numbers: counts go in by np.add.at, row maxima give the best, and
requests are answered from the block. Answers meet the chunk's links again by chunk, where documents are
scored. So a pair that a third of all links hold is one entry a task and one a chunk, and memory is that of a
block, a chunk or one text.

Null and empty texts, and texts whose tokens of either vocabulary don't spell the text (B's normaliser may
change some), have no tokens: zeros, and an empty `groups`. Texts of any length are encoded whole; texts with
characters from U+0530 on or very long runs go to the tokenizers library for A, as in packing. Strings of
special tokens are plain text. Repeated rows count each and come back each, null ids too; counts follow the
texts alone. Ties in counts are all best. An empty table gives an empty result. Columns other than id and text
are neither read nor returned, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import BYTE_VOCABULARY, byte_alphabet
from .packing import fast_encoder

PIECE_VOCABULARY = "piece_bpe_32k.model"
#: Links and documents of a chunk, pairs a task holds before it sends them, and stripes at least and at most.
CHUNK_LINKS, CHUNK_DOCUMENTS, TASK_PAIRS, STRIPES = 1 << 21, 1 << 14, 1 << 21, (512, 2048)
SPACE = "▁"
COUNTS, REQUEST = 0, 1
SENT = "stripe int, kind int, chunk long, pairs binary, counts binary"
ENCODED = "chunk long, id long, n_a long, n_b long, n_groups long, groups string, groups_sha256 string, links binary"


def _written(count: int, end: str) -> np.ndarray:
    made = np.empty(count, object)
    made[:] = [f"{k}{end}" for k in range(count)]
    return made


class Aligner:
    """Both vocabularies: encoders, the bytes of their tokens, and the numbers of pairs."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.encode_a = fast_encoder(a_path, plain_special=True)
        alphabet, known = byte_alphabet(), Tokenizer.from_file(a_path).get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(known.values()) + 1)
        for token, k in known.items():
            self.bytes_a[k] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.encode_b = model.encode
        pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)]
        self.size_a, self.size_b = len(self.bytes_a), len(self.bytes_b)
        self.long_a, self.long_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.number = np.dtype("<u4" if self.size_a * self.size_b < 1 << 32 else "<u8")
        self.text_a = _written(self.size_a, ","), _written(self.size_a, "|")
        self.text_b = _written(self.size_b, ","), _written(self.size_b, ";")

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a text by A and by B, if both spell it."""
        if not text:
            return None
        want = (" " + text).encode()
        a, b = self.encode_a(" " + text), self.encode_b(text)
        if b"".join(map(self.bytes_a.__getitem__, a)) != want or b"".join(map(self.bytes_b.__getitem__, b)) != want:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def aligned(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of A and B tokens that end together, a pair a group."""
        ends_a, ends_b = np.cumsum(self.long_a[a]), np.cumsum(self.long_b[b])
        at = np.searchsorted(ends_b, ends_a)
        hit = ends_b[at] == ends_a
        return np.flatnonzero(hit), at[hit]

    def groups(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> str:
        """a1,a2|b1;a3|b2,b3: the ids of each group."""
        out = np.empty(len(a) + len(b), object)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[in_a], last_b[in_b] = True, True
        before_b = np.concatenate(([0], in_b[:-1] + 1))[np.cumsum(last_a) - last_a]
        out[np.arange(len(a)) + before_b] = np.where(last_a, self.text_a[1][a], self.text_a[0][a])
        upto_a = (in_a + 1)[np.cumsum(last_b) - last_b]
        out[np.arange(len(b)) + upto_a] = np.where(last_b, self.text_b[1][b], self.text_b[0][b])
        return "".join(out.tolist())[:-1]

    def by_stripe(self, pairs: np.ndarray, stripes: int) -> tuple[np.ndarray, np.ndarray]:
        """(order, stripe of each in that order) of sorted pairs: by stripe, then as they were."""
        stripe = (pairs // self.number.type(self.size_a)).astype(np.int64) % stripes
        order = np.argsort(stripe, kind="stable")
        return order, stripe[order]


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def encoded(df: DataFrame, id_col: str, text_col: str, paths: tuple[str, str], chunk_links: int = CHUNK_LINKS, with_groups: bool = False) -> DataFrame:
    """A row per document, with its links, in chunks; written once."""
    import pyarrow as pa

    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.binary()]
    names = [x.split()[0] for x in ENCODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(*paths)
        chunk, links, documents = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part, rows = batch.slice(k, 64), []
                for id_, text in zip(part.column(0).to_pylist(), common.python_strings(part.column(1)), strict=True):
                    if links >= chunk_links or documents >= CHUNK_DOCUMENTS:
                        chunk, links, documents = chunk + 1, 0, 0
                    documents += 1
                    found = both.tokens(text)
                    if found is None:
                        rows.append((chunk, id_, 0, 0, 0, "" if with_groups else None, "", b""))
                        continue
                    a, b = found
                    in_a, in_b = both.aligned(a, b)
                    written = both.groups(a, b, in_a, in_b)
                    links += len(in_a)
                    pairs = (b[in_b] * both.size_a + a[in_a]).astype(both.number).tobytes()
                    rows.append((chunk, id_, len(a), len(b), len(in_a), written if with_groups else None, hashlib.sha256(written.encode()).hexdigest(), pairs))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return common.checkpoint(rows.mapInArrow(run, ENCODED))


def sent(rows: DataFrame, paths: tuple[str, str], stripes: int, requests: bool = True) -> DataFrame:
    """What tasks and chunks send to stripes; rows: those of `encoded`, as they lie."""
    import pyarrow as pa

    names = [x.split()[0] for x in SENT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(*paths)

        def dealt(kind: int, chunk: int, pairs: np.ndarray, counts: np.ndarray | None) -> pa.RecordBatch:
            order, stripe = both.by_stripe(pairs, stripes)
            pairs, counts = pairs[order], None if counts is None else counts[order]
            edges = np.flatnonzero(np.diff(stripe, prepend=-1)).tolist()
            spans = list(zip(edges, [*edges[1:], len(pairs)], strict=True))
            columns = [pa.array(stripe[edges], pa.int32()), pa.array([kind] * len(spans), pa.int32()), pa.array([chunk] * len(spans), pa.int64())]
            columns += [pa.array([pairs[x:y].tobytes() for x, y in spans], pa.binary()), pa.array([b"" if counts is None else counts[x:y].tobytes() for x, y in spans], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names)

        held, counted = np.empty(0, both.number), np.empty(0, np.int64)
        flat = ((c, x) for batch in batches for k in range(0, batch.num_rows, 64) for c, x in zip(batch.column(0).slice(k, 64).to_pylist(), batch.column(1).slice(k, 64).to_pylist(), strict=True))
        for chunk, each in groupby(flat, key=lambda x: x[0]):
            pairs, counts = np.unique(np.frombuffer(b"".join(x for _, x in each), both.number), return_counts=True)
            if not len(pairs):
                continue
            if requests:
                yield dealt(REQUEST, chunk, pairs, None)
            held, at = np.unique(np.concatenate((held, pairs)), return_inverse=True)
            counted = np.bincount(at, np.concatenate((counted, counts)), len(held)).astype(np.int64)
            if len(held) > TASK_PAIRS:
                yield dealt(COUNTS, -1, held, counted)
                held, counted = np.empty(0, both.number), np.empty(0, np.int64)
        if len(held):
            yield dealt(COUNTS, -1, held, counted)

    return rows.select("chunk", "links").mapInArrow(run, SENT)


def in_stripes(df: DataFrame) -> DataFrame:
    return df.repartition(common.partitions(df.sparkSession), "stripe").sortWithinPartitions("stripe", "kind")


class Block:
    """Counts of the pairs of one stripe at a time."""

    def __init__(self, both: Aligner, stripes: int):
        self.both, self.stripes, self.stripe = both, stripes, -1
        self.counts = np.zeros((-(-both.size_b // stripes), both.size_a), np.int64)
        self.best: np.ndarray | None = None

    def places(self, pairs: bytes) -> tuple[np.ndarray, np.ndarray]:
        pairs = np.frombuffer(pairs, self.both.number).astype(np.int64)
        b, a = np.divmod(pairs, self.both.size_a)
        return b // self.stripes, a

    def add(self, stripe: int, pairs: bytes, counts: bytes) -> None:
        if stripe != self.stripe:
            self.counts.fill(0)
            self.stripe = stripe
        np.add.at(self.counts, self.places(pairs), np.frombuffer(counts, "<i8"))
        self.best = None

    def found(self, pairs: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(count, whether it is the highest of the B id) of pairs."""
        if self.best is None:
            self.best = self.counts.max(axis=1)
        b, a = self.places(pairs)
        counts = self.counts[b, a]
        return counts, counts == self.best[b]


def answers(messages: DataFrame, paths: tuple[str, str], stripes: int) -> DataFrame:
    """(chunk, stripe, counts, best) of every request."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(aligner(*paths), stripes)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                out: list[tuple] = []
                for stripe, kind, chunk, pairs, counts in zip(*(batch.column(n).slice(k, 256).to_pylist() for n in range(5)), strict=True):
                    if kind == COUNTS:
                        block.add(stripe, pairs, counts)
                        continue
                    count, best = block.found(pairs)
                    out.append((chunk, stripe, count.astype("<i8").tobytes(), np.packbits(best).tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["chunk", "stripe", "counts", "best"])

    return in_stripes(messages).mapInArrow(run, "chunk long, stripe int, counts binary, best binary")


def scored(rows: DataFrame, replies: DataFrame, paths: tuple[str, str], stripes: int) -> DataFrame:
    """Documents with n_best and count_sum: replies meet a chunk's links."""
    import pyarrow as pa

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        both = aligner(*paths)
        links = table.column("links").to_pylist()
        ends = np.cumsum([len(x) for x in links]) // both.number.itemsize
        pairs, at = np.unique(np.frombuffer(b"".join(links), both.number), return_inverse=True)
        counts, best = np.empty(len(pairs), np.int64), np.empty(len(pairs), bool)
        order, _ = both.by_stripe(pairs, stripes)
        found = found.sort_by("stripe")
        each = [np.frombuffer(x, "<i8") for x in found.column("counts").to_pylist()]
        if each:
            counts[order] = np.concatenate(each)
            best[order] = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(n)).astype(bool) for x, n in zip(found.column("best").to_pylist(), each, strict=True)])
        sums = [np.concatenate(([0], np.cumsum(x[at], dtype=np.int64)))[np.concatenate(([0], ends))] for x in (best, counts)]
        made = [table.column(c) for c in ("id", "n_a", "n_b", "n_groups")]
        made += [table.column("n_groups"), *(pa.array(np.diff(x), pa.int64()) for x in sums), table.column("groups"), table.column("groups_sha256")]
        return pa.table(made, names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256"])

    shape = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string, groups_sha256 string"
    n = common.partitions(rows.sparkSession)
    return rows.repartition(n, "chunk").groupBy("chunk").cogroup(replies.repartition(n, "chunk").groupBy("chunk")).applyInArrow(run, shape)


def _settings(df: DataFrame, a_vocabulary: str | None, b_vocabulary: str | None, stripes: int | None) -> tuple[tuple[str, str], int]:
    paths = a_vocabulary or common.vocabulary(BYTE_VOCABULARY), b_vocabulary or common.vocabulary(PIECE_VOCABULARY)
    return paths, stripes or min(max(STRIPES[0], common.partitions(df.sparkSession)), STRIPES[1])


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_vocabulary: str | None = None, b_vocabulary: str | None = None, stripes: int | None = None, chunk_links: int = CHUNK_LINKS, with_groups: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups, groups_sha256) per row; groups is null unless asked for."""
    paths, stripes = _settings(df, a_vocabulary, b_vocabulary, stripes)
    rows = encoded(df, id_col, text_col, paths, chunk_links, with_groups)
    return scored(rows, answers(sent(rows, paths, stripes), paths, stripes), paths, stripes)


def id_pairs(df: DataFrame, text_col: str = "text", a_vocabulary: str | None = None, b_vocabulary: str | None = None, stripes: int | None = None) -> DataFrame:
    """(b, a, count, best): every linked pair of ids, corpus-wide; the table that carries embeddings from one vocabulary to the other."""
    import pyarrow as pa

    paths, stripes = _settings(df, a_vocabulary, b_vocabulary, stripes)
    messages = sent(encoded(df.withColumn(common.fresh(df, "_id"), F.lit(0)), common.fresh(df, "_id"), text_col, paths), paths, stripes, requests=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(*paths)
        block = Block(both, stripes)

        def whole() -> Iterator[pa.RecordBatch]:
            for local in range(len(block.counts)):
                a = np.flatnonzero(block.counts[local])
                if len(a):
                    n = block.counts[local, a]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), local * stripes + block.stripe), pa.int32()), pa.array(a, pa.int32()), pa.array(n, pa.int64()), pa.array(n == n.max())], ["b", "a", "count", "best"])

        for batch in batches:
            for stripe, pairs, counts in zip(*(batch.column(c).to_pylist() for c in ("stripe", "pairs", "counts")), strict=True):
                if stripe != block.stripe and block.stripe >= 0:
                    yield from whole()
                block.add(stripe, pairs, counts)
        if block.stripe >= 0:
            yield from whole()

    return in_stripes(messages).mapInArrow(run, "b int, a int, count long, best boolean")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(common.table(spark, sf_dir, "documents")).drop("groups").withColumnRenamed("id", "doc_id")


QUERIES = {"op11_alignment": op11_alignment}
SQL: dict[str, str] = {}
