"""Dictionary matching by join: which of a table's forms (abbreviations of books, say) occur in a text.

A form's start, of at most START characters, is its own beginning; a text's starts are those of its
windows, as long as the longest form, one at each place. A start that forms have tells how long these
are, so a window gives one candidate for each such length, and candidates are joined with forms as wholes:
however many forms share a start, a candidate meets only itself. So plans hold no forms, neither do texts travel: the windows of distinct texts do, and what is
found comes back by the text's md5. A dictionary of a counted size is broadcast; a larger one is shuffled,
and what is found in texts is shuffled always, as Spark's estimates of it come from compressed columns.

Null and empty texts hold no forms; null and empty forms are none. Repeated texts are matched once.
Of equal forms the first by order counts. An empty dictionary gives empty arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled
from ..session import stable

#: Characters of a start and places of a piece of a text; forms up to which the dictionary is broadcast.
START, PIECE, BROADCAST_FORMS = 3, 256, 100_000


def folded(c: Column | str) -> Column:
    """Text in which strings that differ in the case of letters only are equal."""
    return F.lower(F.upper(F.translate(filled(c), "İ", "i")))


def longest_first(table: DataFrame, form_col: str = "de", ord_col: str = "ord") -> DataFrame:
    """(form, ord): distinct forms that don't start with a digit; longer ones are tried first, then those that come first."""
    forms = table.select(F.col(form_col).alias("form"), F.col(ord_col).alias("ord")).where("form <> '' and not form rlike '^[0-9]'")
    return forms.groupBy("form").agg(F.min("ord").alias("at")).select("form", F.struct((-F.length("form")).alias("shorter"), "at").alias("ord"))


def contained(df: DataFrame, text_col: str, forms: DataFrame, name: str = "forms", any_case: bool = False) -> DataFrame:
    """The frame and, as `name`, the array of forms that its text contains, in order of the dictionary; forms: (form, ord)."""
    plain = folded if any_case else filled
    known = forms.where("form <> ''").groupBy("form").agg(F.min("ord").alias("ord")).withColumn("plain", plain("form"))
    known = stable(known.withColumns({"start": F.substring("plain", 1, START), "size": F.length("plain")}))
    sizes = known.agg(F.count("*").alias("n"), F.max("size").alias("longest"), F.collect_set(F.least("size", F.lit(START))).alias("widths")).first()
    if not sizes.n:
        return df.withColumn(name, F.array().cast("array<string>"))

    def joined(left: DataFrame, table: DataFrame, on: str, rows: int) -> DataFrame:
        """A table of counted size is broadcast if small; else neither side is, whatever its estimate says."""
        return left.join(F.broadcast(table), on) if rows <= BROADCAST_FORMS else left.hint("merge").join(table, on)

    starts = stable(known.groupBy("start").agg(F.collect_set("size").alias("sizes")))
    key = f"_{name}_key"
    keyed = df.withColumn(key, F.md5(filled(text_col).cast("binary")))
    texts = keyed.where(filled(text_col) != "").groupBy(key).agg(F.min(plain(text_col)).alias("t")).where("t <> ''")
    pieces = texts.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.length("t"), F.lit(PIECE)), lambda i: F.substring(F.col("t"), i, F.lit(PIECE + sizes.longest - 1)))).alias("piece"))
    windows = pieces.select(key, "piece", F.explode(F.sequence(F.lit(1), F.least(F.length("piece"), F.lit(PIECE)))).alias("at")).select(key, F.expr(f"substring(piece, at, {sizes.longest})").alias("window"))
    each = windows.select(key, "window", F.explode(F.array(*(F.substring("window", 1, w) for w in sorted(sizes.widths)))).alias("start"))
    begun = joined(each, starts, "start", starts.count()).select(key, "window", F.explode("sizes").alias("size")).where("length(window) >= size")
    met = joined(begun.select(key, F.expr("substring(window, 1, size)").alias("plain")), known.select("plain", "form", "ord"), "plain", sizes.n)
    found = met.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("ord", "form"))).alias("_met"))
    found = found.select(key, F.transform("_met", lambda x: x["form"]).alias(name))
    return keyed.join(found.hint("merge"), key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>"))).drop(key)
