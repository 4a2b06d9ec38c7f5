"""Chunking by token counts: split at ever finer separators, then merge greedily with an overlap."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import as_column, bind

# Separators from coarse to fine, and the token limit.
SEPARATORS = ("\n\n", "\n", ". ", " ")
MAX_TOKENS = 8191


class Words:
    """The default codec: a token is a word with the white space after it."""

    @staticmethod
    def encode(text: str) -> list[str]:
        return re.findall(r"\S+\s*|\s+", text)

    @staticmethod
    def decode(tokens: list[str]) -> str:
        return "".join(tokens)


def windows(tokens: list, limit: int, overlap: int) -> list[list]:
    """Token windows of `limit`, each starting limit - overlap after the one before; the last ends with the tokens."""
    step, out = max(1, limit - overlap), []
    for start in range(0, len(tokens), step):
        out.append(tokens[start : start + limit])
        if start + limit >= len(tokens):
            break
    return out


def pieces(text: str, limit: int, overlap: int, codec, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[str, int]]:
    """(piece, tokens): separators stay at the ends of pieces; what no separator makes small enough is cut in windows."""
    size = len(codec.encode(text))
    if size <= limit:
        return [(text, size)]
    if not separators:
        return [(codec.decode(w), len(w)) for w in windows(codec.encode(text), limit, overlap)] or [("", 0)]
    first, rest = separators[0], separators[1:]
    parts = re.split(f"(?<={re.escape(first)})", text) if first in text else [text]
    return [p for part in parts if part for p in pieces(part, limit, overlap, codec, rest)]


def merge(parts: list[tuple[str, int]], limit: int, overlap: int) -> list[str]:
    """Greedy chunks. After a full chunk, the last pieces that fit in `overlap` start the next one, and the new piece joins them whatever its size."""
    chunks: list[str] = []
    held: list[tuple[str, int]] = []
    for part in parts:
        if held and sum(n for _, n in held) + part[1] > limit:
            chunks.append("".join(t for t, _ in held))
            keep, size = len(held), 0
            while keep and size + held[keep - 1][1] <= overlap:
                keep -= 1
                size += held[keep][1]
            held = held[keep:]
        held.append(part)
    if held:
        chunks.append("".join(t for t, _ in held))
    return chunks or [""]


def chunk_text(text: str | None, limit: int = MAX_TOKENS, overlap: int = 0, codec=Words) -> list[str]:
    """Chunks of a text: blank gives one empty chunk, a short one is its own."""
    if not text or not text.strip():
        return [""]
    if len(codec.encode(text)) <= limit:
        return [text]
    return merge(pieces(text, limit, overlap, codec), limit, overlap)


def chunks(c: Column | str, limit: int = MAX_TOKENS, overlap: int = 0, codec: Callable | type = Words) -> Column:
    """Array of chunks (Arrow function)."""
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([chunk_text(t, limit, overlap, codec) for t in texts])

    return run(as_column(c))


def word_windows(c: Column | str, limit: int, overlap: int = 0) -> Column:
    """The windows of a text's blank-separated words as native columns."""
    words = F.filter(F.split(F.coalesce(as_column(c), F.lit("")), r"(?U)\s+"), lambda x: x != "")
    step = max(1, limit - overlap)

    def cut(words: Column) -> Column:
        # the last window is the first that reaches the end
        count = F.when(F.size(words) <= limit, F.lit(1)).otherwise(F.ceil((F.size(words) - limit) / F.lit(step)) + 1).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice(words, i * step + 1, F.lit(limit)), " "))

    return bind(words, cut)  # else every window would split the text anew
