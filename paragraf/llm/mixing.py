"""Mixing sources to target weights (operator 12): a low-discrepancy schedule of equal blocks of words.

Targets: every source has a weight and a share of `share` times all words; a target stops at `most` times
its source's words, and the excess is shared again by weight until no target is above. The level (words a
unit of weight) that this ends at is found by a few sums over sources.

Schedule: the mix is a row of slots of `block` words. Slot k has the golden-ratio point k * 0.618... modulo
one (in 32-bit whole numbers), mapped through the targets, laid end to end, to a source. Slots of a source
are ranked by chunks of slots, whose counts are added up, and slot number r of a source holds words
[r * block, (r + 1) * block) of that source, whose documents are laid out in an order shuffled by md5,
`most` times over. The last block of a source is cut at its target, rounded to words; slots that a source
has beyond its target fall away (a few, by the points' low discrepancy), and those it lacks follow at the end.

So each source gives its target to within half a word, no document is taken more than `most` times, and
reruns agree, on any number of partitions: everything follows ids, sizes, sources and the seed.

Texts stay where they are: only (id, source, words) is shuffled. Rows alike in all three are one row with a
count, dealt into parts of at most PART_WORDS words or PART_ROWS rows, so that no flood of copies or null
ids meets in one task; a source is laid out in CELLS cells by the shuffled order, so a hot source does not either.

Null texts have no words, nor do empty and blank ones: they are returned, and none is taken. Null sources are
one source, the last. Null ids are laid out as others; rows alike in id, source and size are interchangeable,
and are taken one by one. An empty table gives an empty result. Columns other than id, text and source are
neither read nor returned, so none can clash. Texts of any length are taken whole; a long one spans many slots.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.corpus import block_offsets, number
from . import common

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST = (3, 1, 2), Fraction(3, 2), 2
#: Words of a block at least, and the most slots: blocks grow beyond.
BLOCK, SLOTS = 256, 1 << 30
#: Copies that are laid out together.
PART_WORDS, PART_ROWS = 1 << 20, 10_000
#: Hexadecimal digits of a cell of the shuffled order; slots of a chunk, as a power of two; cells of the points, likewise.
CELL_DIGITS, CHUNK_BITS, POINT_BITS = 3, 12, 12
#: The golden ratio, less one, times 2 ** 32.
GOLDEN, MODULUS = 2654435769, 1 << 32
#: Sources are broadcast up to so many.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def level_of(sources: DataFrame, share: Fraction, most: int) -> float:
    """Words a unit of weight gets once no source is above `most` times its own; sources: (weight, source_size)."""
    cap = F.col("source_size") * most
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        above = (cap < F.col("weight") * level) if capped >= 0 else F.lit(False)
        found = sources.agg(F.count_if(above).alias("n"), F.sum(F.when(above, cap)).alias("full"), F.sum(F.when(~above, F.col("weight"))).alias("open")).first()
        if found.n == capped:
            return level
        if not found.open:
            return float("inf")
        level, capped = float((share * total - (found.full or 0)) / found.open), found.n


def sources_of(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> DataFrame:
    """(source, n, source_size, target, take, start): n from 1 in order of code points, null last; take: the target in words; start: of sources before.

    rows: (source, size, times).
    """
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"))
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(F.col("n") - 1, F.lit(len(weights))).cast("int"))
    sources = common.checkpoint(number(sizes, [F.asc_nulls_last("source")]).withColumn("weight", weight))
    level = level_of(sources, share, most)
    cap = F.col("source_size") * most
    sources = sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(level)))
    sources = sources.withColumn("take", F.least(cap, F.floor(F.col("target") + 0.5)))
    return common.checkpoint(block_offsets(sources.drop("weight"), "n", "take"))


def laid_out(rows: DataFrame, seed: int = 42) -> DataFrame:
    """Every document with `start`, the words before it in its source; rows: (id, size, times, n, ...), alike rows together."""
    per = F.when(F.col("size") > 0, F.greatest(F.lit(1), F.least(F.lit(PART_ROWS), F.floor(F.lit(PART_WORDS) / F.col("size"))))).otherwise(PART_ROWS)
    parts = rows.withColumn("per", per).withColumn("part", F.explode(F.expr("sequence(0L, (times - 1) div per)")))
    parts = parts.withColumn("copies", F.least(F.col("per"), F.col("times") - F.col("part") * F.col("per"))).drop("per", "times")
    mark = F.md5(F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("size").cast("string"), F.col("part").cast("string"), F.lit(str(seed))).cast("binary"))
    parts = parts.withColumn("mark", mark).withColumn("cell", F.substring("mark", 1, CELL_DIGITS)).withColumn("words", F.col("size") * F.col("copies"))
    before = F.sum("words").over(Window.partitionBy("n", "cell").orderBy("mark", "id", "size", "part").rowsBetween(Window.unboundedPreceding, -1))
    cells = parts.groupBy("n", "cell").agg(F.sum("words").alias("words"))
    ahead = F.sum("words").over(Window.partitionBy("n").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("n", "cell", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    placed = parts.withColumn("before", F.coalesce(before, F.lit(0))).join(cells, ["n", "cell"])
    each = placed.withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
    return each.withColumn("start", F.col("ahead") + F.col("before") + F.col("copy") * F.col("size")).drop("part", "copies", "mark", "cell", "words", "before", "ahead", "copy")


def slots_of(sources: DataFrame, block: int = BLOCK) -> tuple[DataFrame, int]:
    """((slot, n, rank), words of a block): which block of which source a slot holds."""
    spark = sources.sparkSession
    total, count = sources.agg(F.sum("take"), F.max("n")).first()
    total = total or 0
    block = max(block, -(-total // SLOTS))
    points = max(1, -(-total // block))
    shift = MODULUS.bit_length() - 1 - POINT_BITS
    edge = lambda words: F.floor(words.cast("double") / float(max(1, total)) * float(MODULUS))
    spans = sources.where("take > 0").select("n", edge(F.col("start")).alias("low"), edge(F.col("start") + F.col("take")).alias("high")).where("high > low")
    spans = spans.withColumn("cell", F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift))))
    slots = spark.range(points).select(F.col("id").alias("slot"), ((F.col("id") * GOLDEN).bitwiseAND(F.lit(MODULUS - 1))).alias("point"))
    slots = slots.withColumn("cell", F.shiftright("point", shift)).join(spans, "cell").where("point >= low and point < high").select("slot", "n", F.shiftright("slot", CHUNK_BITS).alias("chunk"))
    counts = common.checkpoint(slots.groupBy("n", "chunk").count())
    ahead = F.sum("count").over(Window.partitionBy("n").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    ranked = slots.withColumn("rank", F.row_number().over(Window.partitionBy("n", "chunk").orderBy("slot")).cast("long") - 1)
    ranked = ranked.join(counts.select("n", "chunk", F.coalesce(ahead, F.lit(0)).alias("ahead")), ["n", "chunk"]).select("slot", "n", (F.col("rank") + F.col("ahead")).alias("rank"))
    needs = sources.select("n", F.expr(f"(take + {block - 1}) div {block}").alias("needed"))
    given = needs.join(counts.groupBy("n").agg(F.sum("count").alias("given")), "n", "left").withColumn("given", F.coalesce("given", F.lit(0)))
    kept = ranked.join(F.broadcast(needs) if count and count <= BROADCAST_SOURCES else needs, "n").where("rank < needed").select("slot", "n", "rank")
    closing = given.where("given < needed").withColumn("rank", F.explode(F.expr("sequence(given, needed - 1)")))
    return kept.unionByName(closing.select((F.lit(points) + F.col("rank") * F.lit(count or 0) + F.col("n")).alias("slot"), "n", "rank")), block


class Mix:
    """The mix of a table: `sources`, `documents` as laid out, `spans` of documents by slot, and `taken` by document."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST, block: int = BLOCK, seed: int = 42):
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
        rows = common.checkpoint(rows.groupBy("id", "source", "size").agg(F.count("*").alias("times")))
        self.most = most
        self.sources = sources_of(rows, weights, share, most)
        few = self.sources.count() <= BROADCAST_SOURCES
        known = self.sources.select(F.col("source").alias("_source"), "n", "source_size", "target", "take")
        rows = rows.join(F.broadcast(known) if few else known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        self.documents = common.checkpoint(laid_out(rows, seed))
        self.slots, self.block = slots_of(self.sources, block)

    def spans(self) -> DataFrame:
        """(slot, source, id, word_start, word_stop, n, start, ...): words of a document in a slot; a slot's spans follow one another by `at`."""
        size, block = F.col("size"), self.block
        runs = self.documents.where("size > 0 and start < take").withColumn("lap", F.explode(F.sequence(F.lit(0), F.lit(self.most - 1))))
        runs = runs.withColumn("first", F.col("start") + F.col("lap") * F.col("source_size")).where("first < take").withColumn("last", F.least(F.col("first") + size, F.col("take")))
        runs = runs.withColumn("rank", F.explode(F.expr(f"sequence(first div {block}, (last - 1) div {block})")))
        found = runs.join(self.slots, ["n", "rank"])
        low, high = F.greatest(F.col("first"), F.col("rank") * block), F.least(F.col("last"), (F.col("rank") + 1) * block)
        found = found.withColumn("at", low - F.col("rank") * block).withColumn("word_start", low - F.col("first")).withColumn("word_stop", high - F.col("first"))
        return found.select("slot", "at", "source", "id", "word_start", "word_stop", "lap", "n", "start", "size", "source_size", "target")

    def taken(self) -> DataFrame:
        """(id, size, source_size, target, taken) per row of the table."""
        names = ["id", "size", "source_size", "target"]
        some = self.spans().groupBy("n", "start", *names).agg(F.sum(F.col("word_stop") - F.col("word_start")).alias("taken")).select(*names, "taken")
        none = self.documents.where("size = 0 or start >= take").select(*names, F.lit(0).cast("long").alias("taken"))
        return some.unionByName(none)


def texts(spans: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(slot, at, source, id, text) of spans, for tables whose ids are distinct: the words joined by one space."""
    words = F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))
    found = spans.join(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text")), "id")
    return found.select("slot", "at", "source", "id", F.array_join(F.slice(words, (F.col("word_start") + 1).cast("int"), (F.col("word_stop") - F.col("word_start")).cast("int")), " ").alias("text"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(common.table(spark, sf_dir, "documents")).taken().withColumnRenamed("id", "doc_id")


QUERIES = {"op12_mixing": op12_mixing}
SQL = {
    "op12_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
w AS (SELECT source, CAST(size AS BIGINT) AS size, [3, 1, 2][((n - 1) % 3) + 1] AS weight, n FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY size / weight, n) - 1 AS j FROM w),
c AS (SELECT j, size / weight * 2 AS bound, (3 * (SELECT sum(size) FROM w) - 2 * coalesce(sum(2 * size) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (2 * sum(weight) OVER (ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM o),
t AS (SELECT source, size, least(CAST(2 * size AS DOUBLE), weight * (SELECT arg_min(level, j) FROM c WHERE bound >= level)) AS target FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) - 1 AS k FROM d),
p AS (SELECT *, k // CASE WHEN size > 0 THEN greatest(1, least(10000, 1048576 // size)) ELSE 10000 END AS part FROM k),
l AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), 'null'), size, part, '42')), doc_id, size, part, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p),
m AS (SELECT l.*, t.size AS source_size, target, least(2 * t.size, CAST(floor(target + 0.5) AS BIGINT)) AS take FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(size, take - start)) + greatest(0, least(size, take - source_size - start)) AS BIGINT) AS taken FROM m
"""
}
