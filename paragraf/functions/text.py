"""Text functions with Unicode white space and word characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, made) -> Column:
    """made(value), with the value worked out once, as inside lambdas no common parts are shared."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def filled(c: Column | str) -> Column:
    """Null as empty."""
    return F.coalesce(as_column(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(as_column(c), r"(?U)^\s+|\s+$", "")


def collapse(c: Column | str) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return strip(F.regexp_replace(as_column(c), r"(?U)\s+", " "))


def is_blank(c: Column | str) -> Column:
    return strip(filled(c)) == ""


def tokenize(c: Column | str) -> Column:
    """Lower-cased words: runs of letters, digits, marks of them and underscores."""
    return F.filter(F.split(F.lower(filled(c)), r"[^\p{L}\p{N}_]+"), lambda x: x != "")


def truncate(c: Column | str, limit: int, mark: str = "…") -> Column:
    """The first `limit` characters and a mark, if it is longer."""
    c = as_column(c)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(mark))).otherwise(c)


def excerpt(c: Column | str, limit: int = 300) -> Column:
    return truncate(c, limit, "...")


def drop_empty(items: Column) -> Column:
    return F.filter(items, lambda x: x.isNotNull() & (x != ""))


def split_list(c: Column | str, separator: str = ";") -> Column:
    """Trimmed, non-empty items of a delimited list, in order."""
    return drop_empty(F.transform(F.split(filled(c), rf"\Q{separator}\E"), strip))
