"""Corpus preparation: merging equal texts, enriching, gold sets, preference pairs, training rows, token blocks, splits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions.text import as_column, filled, is_blank, strip
from ..session import stable

# Answers of preference pairs, labels of the metadata block.
RELEVANT, NOT_RELEVANT = "Ja, diese Bestimmung ist einschlägig.", "Nein, diese Bestimmung ist nicht einschlägig."
CITATION_LABEL, SUMMARY_LABEL = "Zitat: ", "Zusammenfassung: "


def merge_equal_texts(df: DataFrame, ord_col: str = "ord", citation_col: str = "citation", text_col: str = "text") -> DataFrame:
    """The first row of each stripped text; later citations are appended after "; " unless they are part of what is there.

    A text's distinct citations become one string, so they must fit a row; each is looked for in what is
    there, which takes time by the square of their number.
    """
    rows = df.withColumn("_key", strip(filled(text_col))).withColumn("_cite", strip(filled(citation_col)))
    columns = [c for c in df.columns if c != citation_col]
    # equal citations of a text are made one first, so that a text shared by many rows stays small
    once = rows.groupBy("_key", "_cite").agg(F.min(F.col(ord_col)).alias("_o"), F.min_by(F.struct(*df.columns), ord_col).alias("_row"))
    items = F.array_sort(F.collect_list(F.struct(F.col("_o"), F.col("_cite"))))
    grouped = once.groupBy("_key").agg(items.alias("_items"), F.min_by("_row", "_o").alias("_row"))
    first = filled(F.col(f"_row.{citation_col}"))
    merged = F.aggregate(F.slice("_items", 2, F.greatest(F.size("_items") - 1, F.lit(0))), first, lambda s, x: F.when((x["_cite"] == "") | F.contains(s, x["_cite"]), s).otherwise(F.concat(s, F.lit("; "), x["_cite"])))
    return grouped.select(*[F.col(f"_row.{c}").alias(c) for c in columns], merged.alias(citation_col)).select(*df.columns)


def enriched(citation: Column | str, text: Column | str, summary: Column | None = None) -> Column:
    """The text without a citation glued to its start, and a metadata block with citation and summary, each if there is one."""
    cite, body = strip(filled(citation)), strip(filled(text))
    after = F.substring(body, F.length(cite) + 1, F.length(body))
    glued = (cite != "") & F.startswith(body, cite) & F.substring(after, 1, 1).isin(":", "-", "\n", " ")
    body = F.when(glued, strip(F.regexp_replace(after, r"^[:\- \n]+", ""))).otherwise(body)
    lines = [F.when(cite != "", F.concat(F.lit(CITATION_LABEL), cite))]
    if summary is not None:
        lines.append(F.when(filled(summary) != "", F.concat(F.lit(SUMMARY_LABEL), summary)))
    block = F.concat_ws("\n", *lines)
    return F.when(block != "", F.concat(body, F.lit("\n\n<metadata>\n"), block, F.lit("\n</metadata>"))).otherwise(body)


def summaries(df: DataFrame, cache: DataFrame, model, citation_col: str = "citation", text_col: str = "text", limit: int = 3000) -> DataFrame:
    """(citation, summary): cached ones, and an injected model's of the first `limit` characters for the rest."""
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model(t) for t in texts])

    new = df.join(cache.select("citation"), df[citation_col] == cache["citation"], "left_anti").select(F.col(citation_col).alias("citation"), F.substring(filled(text_col), 1, limit).alias("text"))
    made = new.groupBy("citation").agg(F.min("text").alias("text")).select("citation", run("text").alias("summary"))
    return cache.select("citation", "summary").unionByName(made)


def coverage(df: DataFrame, field_col: str = "citation_field") -> DataFrame:
    """One row rows, with_citations."""
    return df.agg(F.count("*").alias("rows"), F.count_if(~is_blank(field_col)).alias("with_citations"))


def known_citations(df: DataFrame, courts: DataFrame, citation_col: str = "citation") -> DataFrame:
    """Rows whose citation is a law, or a consideration (` E. `) that the court corpus has."""
    law = ~F.startswith(F.col(citation_col), F.lit("BGE"))
    court = df.where(~law & F.contains(F.col(citation_col), F.lit(" E. "))).join(courts.select(F.col("citation").alias(citation_col)).distinct(), citation_col, "left_semi")
    return df.where(law).unionByName(court.select(df.columns))


def gold_sets(samples: DataFrame, abbreviations: list[str], courts: DataFrame | None = None, seed: int = 42, question: str = "question", answer: str = "answer") -> DataFrame:
    """(query_id, query, gold_citations) of rows whose question and answer cite something, in a seeded order."""
    rows = samples.select(F.col(question).alias("query"), C.gold_citations(F.concat_ws(" ", question, answer), abbreviations).alias("items")).where("size(items) > 0")
    if courts is not None:
        rows = rows.withColumn("_row", F.monotonically_increasing_id())
        kept = known_citations(rows.select("_row", "query", F.posexplode("items").alias("pos", "citation")), courts)
        parts = F.array_sort(F.collect_list(F.struct("pos", "citation")))
        rows = kept.groupBy("_row", "query").agg(F.transform(parts, lambda p: p["citation"]).alias("items")).drop("_row")
    shuffled = rows.select("query", F.array_join("items", ";").alias("gold_citations"), F.xxhash64("query", F.lit(seed)).alias("_h"))
    numbered = number(shuffled, ["_h", "query"])
    return numbered.select(F.format_string("train_%04d", "n").alias("query_id"), "query", "gold_citations")


def number(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """Numbers from 1 in a total order, without bringing all rows to one task: counts of sorted ranges are added up."""
    placed = stable(df.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    sizes = sorted(placed.groupBy("_p").agg(F.count("*").alias("c"), F.min("_i").alias("at")).collect())  # one row a partition
    shift, total = [], 0
    for p, c, at in sizes:
        shift.append((p, total - at))
        total += c
    if not shift:
        return placed.drop("_p", "_i").withColumn(name, F.lit(0).cast("long"))
    offsets = df.sparkSession.createDataFrame(shift, "_p int, _shift long")
    return placed.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_i") + F.col("_shift") + 1).drop("_p", "_i", "_shift")


def citation_texts(laws: DataFrame, courts: DataFrame) -> DataFrame:
    """(citation, text): the last text of each citation, courts after laws; (ord, citation, text) each."""
    each = [df.select(strip(filled("citation")).alias("citation"), strip(filled("text")).alias("text"), F.struct(F.lit(n).alias("c"), F.col("ord").alias("o")).alias("at")) for n, df in enumerate((laws, courts))]
    return each[0].unionByName(each[1]).where("citation <> '' and text <> ''").groupBy("citation").agg(F.max_by("text", "at").alias("text"))


def pair_prompt(system: str, citation: Column | str, text: Column | str, case: Column | str) -> Column:
    return F.format_string("%s\n\nRechtsfall:\n%s\n\n" + "-" * 72 + "\n\nBestimmung: %s\n%s", F.lit(system), as_column(case), as_column(citation), as_column(text))


def preference_pairs(gold: DataFrame, queries: DataFrame, texts: DataFrame, system: str = "", seed: int = 42) -> DataFrame:
    """(query_id, citation, prompt, chosen, rejected, positive): every gold citation with a text, and for each query that has one a negative.

    gold: (query_id, citation). The negative is the first non-gold citation on a ring of citations in
    hash order, from a point that the query's hash chooses: no query meets all citations.
    """
    found = gold.select("query_id", "citation").distinct().join(texts, "citation")
    negatives = negative_citations(found.select("query_id").distinct(), gold, texts.select("citation"), seed)
    rows = found.select("query_id", "citation", "text", F.lit(True).alias("positive")).unionByName(negatives.join(texts, "citation").select("query_id", "citation", "text", F.lit(False).alias("positive")))
    answer = lambda yes: F.when(F.col("positive") == yes, F.lit(RELEVANT)).otherwise(F.lit(NOT_RELEVANT))
    made = rows.join(queries.select("query_id", "query"), "query_id")
    return made.select("query_id", "citation", pair_prompt(system, "citation", "text", "query").alias("prompt"), answer(True).alias("chosen"), answer(False).alias("rejected"), "positive")


def negative_citations(wanted: DataFrame, gold: DataFrame, citations: DataFrame, seed: int = 42) -> DataFrame:
    """(query_id, citation): a citation that is not gold for the query, chosen by hashes; none if all are gold.

    Citations are numbered once in hash order; a query tries as many places from its own as it has gold
    citations and one more, of which one at least is free.
    """
    places = number(citations.distinct().withColumn("_h", F.xxhash64("citation", F.lit(seed))), ["_h", "citation"], "place").select("citation", (F.col("place") - 1).alias("place"))
    total = places.count()
    if not total:
        return wanted.select("query_id", F.lit(None).cast("string").alias("citation")).limit(0)
    sizes = gold.groupBy("query_id").agg(F.count_distinct("citation").alias("g"))
    tries = wanted.join(sizes, "query_id", "left").select("query_id", F.posexplode(F.sequence(F.lit(0), F.least(F.coalesce("g", F.lit(0)), F.lit(total - 1)).cast("int"))).alias("n", "_"))
    tries = tries.select("query_id", "n", F.pmod(F.xxhash64("query_id", F.lit(seed)) + F.col("n"), F.lit(total)).alias("place"))
    free = tries.join(places, "place").join(gold.select("query_id", "citation"), ["query_id", "citation"], "left_anti")
    return free.groupBy("query_id").agg(F.min_by("citation", "n").alias("citation"))


def training_text(title: Column | str, citation: Column | str, text: Column | str) -> Column:
    """The non-empty ones of title, citation and text, a line each."""
    return F.concat_ws("\n", *[F.nullif(strip(filled(c)), F.lit("")) for c in (title, citation, text)])


def token_blocks(tokens: DataFrame, length: int, eos: str = "</s>", id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(block, tokens): all token lists in order of ids, each with an end token, cut into blocks; the tail is dropped."""
    sized = block_offsets(tokens.select(F.col(id_col).alias("id"), (F.size(tokens_col) + 1).alias("n")), "id", "n")
    total = sized.agg(F.max(F.col("start") + F.col("n"))).first()[0] or 0
    every = tokens.select(F.col(id_col).alias("id"), F.concat(F.col(tokens_col), F.array(F.lit(eos))).alias("t")).join(sized, "id")
    # a document gives one slice for each block it touches, not one row for each token
    first, last = F.floor(F.col("start") / length), F.floor((F.col("start") + F.col("n") - 1) / length)
    parts = every.select("start", "n", "t", F.explode(F.sequence(first, last)).alias("block")).where(F.col("block") < total // length)
    low = F.greatest(F.col("block") * length, F.col("start"))
    high = F.least((F.col("block") + 1) * length, F.col("start") + F.col("n"))
    slices = parts.select("block", low.alias("low"), F.slice("t", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("t"))
    return slices.groupBy("block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("low", "t"))), lambda x: x["t"])).alias("tokens"))


def block_offsets(sizes: DataFrame, id_col: str, n_col: str) -> DataFrame:
    """(id, n, start): running totals in order of ids by sorted ranges, whose totals are added up on the driver, one number a range."""
    placed = stable(sizes.orderBy(id_col).withColumn("_p", F.spark_partition_id()))
    shift, total = [], 0
    for p, s in sorted(placed.groupBy("_p").agg(F.sum(n_col)).collect()):
        shift.append((p, total))
        total += s
    if not shift:
        return sizes.withColumn("start", F.lit(0).cast("long"))
    offsets = sizes.sparkSession.createDataFrame(shift, "_p int, _shift long")
    before = F.sum(n_col).over(Window.partitionBy("_p").orderBy(id_col).rowsBetween(Window.unboundedPreceding, -1))
    return placed.join(F.broadcast(offsets), "_p").withColumn("start", F.coalesce(before, F.lit(0)) + F.col("_shift")).drop("_p", "_shift")


def split(df: DataFrame, key_col: str, share: float = 0.02, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, validation) by the md5 of key and seed: the same rows however the data lie."""
    mark = F.md5(F.concat_ws("|", F.col(key_col).cast("string"), F.lit(str(seed))))
    held = F.conv(F.substring(mark, 1, 8), 16, 10).cast("long") % 10_000 < int(share * 10_000)
    return df.where(~held), df.where(held)


def log_summary(log: DataFrame, seconds_col: str = "seconds", citations_col: str = "citations", iterations_col: str = "iterations") -> DataFrame:
    """One row queries, seconds_mean, seconds_total, citations_mean, iterations_mean of a run's log."""
    mean = lambda c: F.avg(F.coalesce(c, F.lit(0)))
    return log.agg(F.count("*").alias("queries"), mean(F.col(seconds_col)).alias("seconds_mean"), F.sum(F.coalesce(seconds_col, F.lit(0.0))).alias("seconds_total"), mean(F.greatest(F.size(citations_col), F.lit(0))).alias("citations_mean"), mean(F.col(iterations_col)).alias("iterations_mean"))


def sample_corpora(spark: SparkSession) -> dict[str, DataFrame]:
    """Two tiny corpora to try the engine on."""
    laws = [(0, "Art. 1 XG", "Ein Antrag bindet bis zum Ablauf der Frist.", "XG"), (1, "Art. 2 XG", "Wer Schaden zufügt, ersetzt ihn.", "XG")]
    courts = [(0, "BGE 100 II 1 E. 1", "Vgl. BGE 101 I 5 und Art. 1 OR."), (1, "BGE 101 I 5 E. 2", "Dazu Art. 2 OR.")]
    return {"laws": spark.createDataFrame(laws, "ord long, citation string, text string, title string"), "courts": spark.createDataFrame(courts, "ord long, citation string, text string")}
