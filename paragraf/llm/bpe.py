"""BPE encoding and decoding (operator 2).

The encoder never replays merges. For every pre-token an Aho-Corasick automaton over the vocabulary
lists the tokens that match at each byte; a backtracking walk takes the longest one whose pair with the
token before it is compatible, tries the next shorter one otherwise, and steps back when none is left.
Positions found to be dead ends are remembered, so each is entered once and the walk is linear.
Two tokens are compatible if merging their texts together would stop at exactly this boundary; that is
read off the merge ranks and kept in a table.

Decoding gathers bytes from one blob of all token texts by a table of offsets.

Nulls count as empty texts (no tokens, empty decoded text). Rows are handled one by one: repeated rows,
ties and null ids come back as they went in, an empty table gives an empty result, and columns other
than the id and the text are neither read nor returned, so that clashing names can't arise. Texts of
any length are encoded whole; memory grows with one text's ids only.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BYTE_VOCABULARY = "byte_bpe_50k.json"
#: Pre-tokens kept with their ids in a worker, and pairs in the compatibility table; both start anew when full.
CACHED_WORDS, CACHED_PAIRS = 400_000, 1_000_000
#: Below this code point the `regex` module and the tokenizers library class characters alike.
PLAIN_BELOW = 0x530
DECODE_SLICE = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 stands for itself, the rest follows from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class BytePairs:
    """Tables of one byte-level vocabulary, and its encoder and decoder."""

    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet, vocabulary = byte_alphabet(), spec["model"]["vocab"]
        to_bytes = lambda token: bytes(alphabet[c] for c in token)
        self.library = Tokenizer.from_file(path)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        # Tokens are handled by rank: bytes first, then merges by priority. rank_id gives the vocabulary's ids.
        singles = sorted((t for t in vocabulary if len(t) == 1), key=lambda t: alphabet[t])
        names = list(singles)
        rank = {t: k for k, t in enumerate(names)}
        self.pair: dict[int, int] = {}
        self.halves: list[tuple[int, int]] = [(k, k) for k in range(len(names))]
        for left, right in spec["model"]["merges"]:
            whole = left + right
            if whole not in rank:
                rank[whole] = len(names)
                names.append(whole)
                self.halves.append((rank[left], rank[right]))
            self.pair.setdefault(rank[left] << 32 | rank[right], rank[whole])
        self.texts = [to_bytes(t) for t in names]
        self.rank_id = [vocabulary[t] for t in names]
        self.width = [len(t) for t in self.texts]
        self.matches = ahocorasick.Automaton()
        for k, text in enumerate(self.texts):
            self.matches.add_word(text.decode("latin-1"), k)
        self.matches.make_automaton()
        by_text = {t: k for k, t in enumerate(self.texts)}
        self.shorter = [next((by_text[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in by_text), -1) for t in self.texts]
        self.compatible: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        size = 1 + max([*vocabulary.values(), *self.special.values()])
        pieces = [b""] * size
        for token, k in [*vocabulary.items(), *self.special.items()]:
            pieces[k] = token.encode() if token in self.special else to_bytes(token)
        self.offsets = np.zeros(size + 1, np.int64)
        np.cumsum([len(x) for x in pieces], out=self.offsets[1:])
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        import public_tokenizers

        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.wide = re.compile(f"[^\\x00-{chr(PLAIN_BELOW - 1)}]")

    def fits(self, left: int, right: int) -> bool:
        """Whether exact merging of the two texts' concatenation leaves the boundary between these tokens.

        The merges are undone from the latest to the earliest on both sides of the boundary; if at any
        time the two tokens beside it have a merge of their own that comes before those already undone,
        merging would have crossed the boundary. Of equal ranks the left one is merged first.
        """
        key = left << 32 | right
        known = self.compatible.get(key)
        if known is not None:
            return known
        bound, good = 1 << 31, True
        a, b = left, right
        singles = 256
        while True:
            joined = self.pair.get(a << 32 | b)
            if joined is not None and joined < bound:
                good = False
                break
            open_a, open_b = a >= singles, b >= singles
            if not (open_a or open_b):
                break
            if open_a and (a > b or not open_b):
                bound, a = a, self.halves[a][1]
            else:
                bound, b = b + 1, self.halves[b][0]
        if len(self.compatible) >= CACHED_PAIRS:
            self.compatible.clear()
        self.compatible[key] = good
        return good

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ranks of one pre-token."""
        size = len(piece)
        longest = [-1] * size
        width = self.width
        for end, token in self.matches.iter(piece.decode("latin-1")):
            longest[end + 1 - width[token]] = token  # ends only grow, so the longest comes last
        out: list[int] = []
        dead = set()
        at, token = 0, longest[0] if size else -1
        while at < size:
            while token >= 0:
                after = at + width[token]
                if after not in dead and (not out or self.fits(out[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = after
                token = longest[at] if at < size else -1
            else:
                dead.add(at)
                last = out.pop()
                at -= width[last]
                token = self.shorter[last]
        return out

    def word(self, word: str) -> bytes:
        ids = np.array([self.rank_id[k] for k in self.encode_piece(word.encode())], "<u4").tobytes()
        if len(self.words) >= CACHED_WORDS:
            self.words.clear()
        self.words[word] = ids
        return ids

    def plain(self, text: str) -> bytes:
        if self.wide.search(text):
            words = [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
            # characters of several bytes may be shared between pieces of the library's offsets
            if sum(map(len, words)) != len(text):
                raise ValueError("pre-tokens don't cover the text")
        else:
            words = self.pattern.findall(text)
        known, word = self.words.get, self.word
        return b"".join([known(w) or word(w) for w in words])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; special strings in the text become their ids."""
        if not self.special or not any(x in text for x in self.special):
            return self.plain(text)
        return b"".join(np.array([self.special[x]], "<u4").tobytes() if x in self.special else self.plain(x) for x in self.split_special.split(text) if x)

    def decode(self, ids: bytes) -> bytes:
        """Bytes of ids; ids beyond the vocabulary give nothing."""
        every, out = np.frombuffer(ids, "<u4"), []
        for k in range(0, len(every), DECODE_SLICE):
            part = every[k : k + DECODE_SLICE].astype(np.int64)
            part = part[part < len(self.offsets) - 1]
            starts = self.offsets[part]
            sizes = self.offsets[part + 1] - starts
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.blob[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)].tobytes())
        return b"".join(out)


@lru_cache(maxsize=4)
def byte_pairs(path: str) -> BytePairs:
    return BytePairs(path)


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids): each text's ids as binary, little-endian unsigned 32-bit."""
    import pyarrow as pa

    path = vocabulary or common.vocabulary(BYTE_VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_pairs(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [coder.encode(x) for x in common.python_strings(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["id", "ids"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, ids binary")


def decode_ids(df: DataFrame, id_col: str = "id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(id, text): ids back to text as the library decodes them; broken UTF-8 is replaced. Null ids give an empty text."""
    import pyarrow as pa

    path = vocabulary or common.vocabulary(BYTE_VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_pairs(path)
        for batch in batches:
            texts = [coder.decode(x or b"").decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, text string")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) in one pass, without shipping ids between processes."""
    import pyarrow as pa

    path = vocabulary or common.vocabulary(BYTE_VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_pairs(path)
        for batch in batches:
            counts, ids_hex, text_hex = [], [], []
            for k in range(0, batch.num_rows, 256):
                for text in common.python_strings(batch.column(1).slice(k, 256)):
                    ids = coder.encode(text)
                    counts.append(len(ids) // 4)
                    ids_hex.append(hashlib.sha256(ids).hexdigest())
                    text_hex.append(hashlib.sha256(coder.decode(ids).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op2_bpe": op2_bpe}
SQL: dict[str, str] = {}
