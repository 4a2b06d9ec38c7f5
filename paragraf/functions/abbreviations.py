"""Abbreviations of law books: an input table (id, de, fr, it), as a source gives them in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A seed for tests and examples; the full table is an input.
SEED = ("SchKG", "StGB", "StPO", "ZGB", "BGG", "ZPO", "OR", "BV")


def german(table: DataFrame, ord_col: str = "ord") -> list[str]:
    """German abbreviations that don't start with a digit, longest first, then in order of the table, which is a small dictionary."""
    rows = table.where("de is not null and de <> '' and not de rlike '^[0-9]'").orderBy(F.desc(F.length("de")), ord_col).select("de")
    return list(dict.fromkeys(r.de for r in rows.collect()))


def translations(wanted: DataFrame, table: DataFrame, ord_col: str = "ord") -> DataFrame:
    """(abbreviation, id, de, fr, it, known): by id first, then by any language's form, the first row of the table."""
    forms = table.select(ord_col, "id", "de", "fr", "it", F.explode(F.array(F.struct(F.lit(0).alias("p"), F.col("id").alias("form")), *[F.struct(F.lit(1).alias("p"), F.col(c).alias("form")) for c in ("de", "fr", "it")])).alias("f"))
    forms = forms.where("f.form is not null")
    best = forms.groupBy(F.col("f.form").alias("abbreviation")).agg(F.min_by(F.struct("id", "de", "fr", "it"), F.struct("f.p", ord_col)).alias("best"))
    return wanted.join(best, "abbreviation", "left").select("abbreviation", "best.*", F.col("best").isNotNull().alias("known"))
