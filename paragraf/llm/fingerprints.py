"""Document fingerprints (operator 3), DataFrame functions only: invertible Bloom lookup sketches.

A text's paragraphs are its lines, long lines cut at the first sentence end after `PIECE` characters;
the set of their 64-bit hashes is what a sketch holds. A sketch is three rows of cells; a digest adds
one, itself and its check to one cell of each row (counts add, the others by exclusive or). The base
sketch of twelve cells, written in hex, is the fingerprint. Two sketches subtract cell by cell, which
leaves the digests that differ. Peeling takes a digest from a cell that holds just one (count one either
way and a check that fits) out of its other cells, until all cells are empty: then every differing
digest is recovered, with its side. If cells are left, it is tried again, larger: digests are dealt to
tables of about eight by bits of theirs, each with a sketch of its own, and tables that can't be peeled
have sketches of twice the cells and other positions, up to 192, beyond which sets are compared plainly.
Likeness is the digests in common by those of either text; 1 if both have none.

The next document is that with the next smaller id, the smallest's is the largest one; of equal ids the
md5 of the text decides, null ids count as smallest. It is found by one shuffle of texts into ranges of
(id, md5) of about RANGE_ROWS rows, whose bounds are quantiles (beyond MAX_RANGES ranges hold more rows
each, which a sorted window streams through, and spills); an id that many rows share is split over ranges
by its texts. Each range also gets the last document of the range before. Equal rows are one there, with
their number, so that a flood of them isn't one range.

Null texts count as empty and have a sketch of zeros. Repeated rows come back each: they are each other's
next, and the last of them has the next different row. One row alone is its own next; empty tables give empty results; columns other than id and text are
neither read nor returned. Texts of any length are taken whole, in time that grows as n ** 1.5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Least characters of a cut paragraph, digests of a table, cells in a row of the base sketch, and the row lengths tried.
PIECE, PER_TABLE, ROW, ROWS_TRIED = 100, 8, 4, (4, 8, 16, 32, 64)
#: Documents in a range on average, and the most ranges, whose bounds the plan holds.
RANGE_ROWS, MAX_RANGES = 1000, 1 << 16
LOWEST = -(1 << 63)
CELL = "struct<n:int,k:bigint,c:bigint>"
DIGEST = "struct<n:int,k:bigint,c:bigint>"


def digests(text: str) -> str:
    """SQL: the distinct paragraph hashes of a text column."""
    pieces = rf"regexp_extract_all({text}, '[^\\n]{{1,{PIECE}}}[^\\n.!?]*[.!?]*', 0)"
    return f"array_distinct(transform(filter({pieces}, x -> trim(x) <> ''), x -> xxhash64(x)))"


def _hash(k: str, level: int) -> str:
    return k if level == 0 else f"xxhash64({k}, {level})"


def sketch(keys: str, row: int = ROW, level: int = 0) -> str:
    """SQL: cells of an array of digests."""

    def line(g: int) -> str:
        held = f"filter({keys}, k -> (shiftright({_hash('k', level)}, {16 * g}) & {row - 1}) = j)"
        cell = "named_struct('n', size(s), 'k', aggregate(s, 0L, (x, k) -> x ^ k), 'c', aggregate(s, 0L, (x, k) -> x ^ xxhash64(k, 77)))"
        return f"transform(sequence(0, {row - 1}), j -> transform(array({held}), s -> {cell})[0])"

    return f"concat({', '.join(line(g) for g in range(3))})"


def subtract(left: str, right: str) -> str:
    """SQL: cells of one sketch less those of another."""
    return f"zip_with({left}, {right}, (p, q) -> named_struct('n', p.n - q.n, 'k', p.k ^ q.k, 'c', p.c ^ q.c))"


def peel(cells: str, row: int = ROW, level: int = 0) -> str:
    """SQL: the differing digests (n: 1 only left, -1 only right), or null if peeling gets stuck."""
    h = _hash("q.k", level)
    at = " or ".join(f"i = {g * row} + (shiftright({h}, {16 * g}) & {row - 1})" for g in range(3))
    taken = f"transform(s.cells, (c, i) -> if({at}, named_struct('n', c.n - q.n, 'k', c.k ^ q.k, 'c', c.c ^ q.c), c))"
    step = f"""transform(array(filter(s.cells, c -> abs(c.n) = 1 and xxhash64(c.k, 77) = c.c)),
        p -> if(size(p) = 0, s, transform(array(p[0]), q -> named_struct('cells', {taken}, 'found', array_append(s.found, q)))[0]))[0]"""
    start = f"named_struct('cells', {cells}, 'found', cast(array() as array<{DIGEST}>))"
    empty = "forall(s.cells, c -> c.n = 0 and c.k = 0 and c.c = 0)"
    return f"aggregate(sequence(1, {3 * row}), {start}, (s, t) -> if({empty}, s, {step}), s -> if({empty}, s.found, null))"


def plain(left: str, right: str) -> str:
    """SQL: the differing digests by comparing sets, where even the largest sketch gets stuck."""
    side = lambda a, b, n: f"transform(array_except({a}, {b}), k -> named_struct('n', {n}, 'k', k, 'c', xxhash64(k, 77)))"
    return f"concat({side(left, right, 1)}, {side(right, left, -1)})"


def difference(left: str, right: str, left_cells: str, right_cells: str) -> str:
    """SQL: the differing digests of two arrays of digests with their base sketches."""
    tries = [peel(subtract(sketch("t.a", r, n), sketch("t.b", r, n)), r, n) for n, r in enumerate(ROWS_TRIED)]
    table = f"transform(array(named_struct('a', filter(u.a, k -> pmod(shiftright(k, 42), r) = y), 'b', filter(u.b, k -> pmod(shiftright(k, 42), r) = y))), t -> coalesce({', '.join(tries)}, {plain('t.a', 't.b')}))[0]"
    dealt = f"transform(array(named_struct('a', filter({left}, k -> pmod(shiftright(k, 20), r) = x), 'b', filter({right}, k -> pmod(shiftright(k, 20), r) = x))), u -> flatten(transform(sequence(0, r - 1), y -> {table})))[0]"
    tables = f"greatest(1, cast(ceil(sqrt((size({left}) + size({right})) / {PER_TABLE})) as int))"
    larger = f"transform(array({tables}), r -> flatten(transform(sequence(0, r - 1), x -> {dealt})))[0]"
    return f"coalesce({peel(subtract(left_cells, right_cells))}, {larger})"


def likeness(left: str, right: str, differing: str) -> Column:
    both = F.expr(f"size({left}) + size({right})")
    d = F.expr(f"size({differing})")
    return F.when(both == 0, F.lit(1.0)).otherwise((both - d).cast("double") / (both + d))


def fingerprint(cells: str) -> Column:
    return F.expr(f"array_join(transform({cells}, c -> lower(concat(lpad(hex(c.n), 8, '0'), lpad(hex(c.k), 16, '0'), lpad(hex(c.c), 16, '0')))), '')")


def with_next(rows: DataFrame) -> DataFrame:
    """(id, text, times, own, own_cells) and those of the next different row as `next`; rows: (id, text). Equal rows are one."""
    spark, rows = rows.sparkSession, common.collapsed(rows)
    keyed = rows.withColumn("key", F.coalesce("id", F.lit(LOWEST)))
    count = keyed.count()
    ranges = max(1, min(MAX_RANGES, -(-count // RANGE_ROWS), count))
    bounds: list[int] = []
    if count and ranges > 1:
        bounds = sorted(keyed.agg(F.percentile_approx("key", [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0])
    ranged = keyed.withColumn("range", common.place(common.constant(bounds), F.lit(len(bounds)), F.col("key"), F.col("text"))).withColumn("mark", F.md5("text"))
    last = sorted(ranged.groupBy("range").agg(F.max(F.struct("key", "mark")).alias("last")).collect())  # a row a range
    goes = [(x.key, x.mark, last[(n + 1) % len(last)][0], n == len(last) - 1) for n, (_, x) in enumerate(last)]
    ghosts = spark.createDataFrame(goes, "key long, mark string, to int, wraps boolean")
    own = ranged.select("range", F.lit(False).alias("wraps"), F.lit(False).alias("ghost"), "key", "mark", "id", "text", "times")
    # an id that is null and the lowest one may share key and mark: either goes on, as their texts are alike
    more = ranged.join(F.broadcast(ghosts), ["key", "mark"]).groupBy("key", "mark", "to", "wraps").agg(F.min("id").alias("id"), F.min("text").alias("text"), F.min("times").alias("times"))
    more = more.select(F.col("to").alias("range"), "wraps", F.lit(True).alias("ghost"), "key", "mark", "id", "text", "times")
    dealt = own.unionByName(more).repartition(common.partitions(spark), "range")
    dealt = dealt.withColumn("own", F.expr(digests("text"))).withColumn("own_cells", F.expr(sketch("own")))
    before = Window.partitionBy("range").orderBy(F.desc("wraps"), F.desc("ghost"), "key", "mark")
    return dealt.withColumn("next", F.lag(F.struct("text", "own", "own_cells")).over(before)).where("not ghost").select("id", "text", "times", "own", "own_cells", "next")


def versions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited, fingerprint, edited_fingerprint, changed, near_edited, near_next) per row.

    edited: the text with its last half replaced by the start of the next document; changed: the
    differing digests between the two, recovered from the sketches.
    """
    rows = with_next(df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    # of equal rows, one has the next different row after it, and the others, worked out once, have themselves
    itself = F.struct("text", "own", "own_cells")
    either = F.when(F.col("times") > 1, F.array(F.struct(F.col("next"), F.lit(1).cast("long").alias("times")), F.struct(itself.alias("next"), (F.col("times") - 1).alias("times"))))
    either = either.otherwise(F.array(F.struct(F.col("next"), F.lit(1).cast("long").alias("times"))))
    rows = rows.withColumn("either", F.explode(either)).select("id", "text", "own", "own_cells", "either.next", "either.times")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next.text", F.lit(1), half))
    made = rows.withColumn("edited", edited)
    made = made.withColumn("new", F.expr(digests("edited"))).withColumn("new_cells", F.expr(sketch("new")))
    made = made.select("id", "times", F.length("text").cast("long").alias("n_chars"), "edited", "own", "own_cells", "new", "new_cells", F.col("next.own").alias("other"), F.col("next.own_cells").alias("other_cells"))
    made = made.withColumn("changed", F.expr(difference("own", "new", "own_cells", "new_cells"))).withColumn("apart", F.expr(difference("own", "other", "own_cells", "other_cells")))
    made = made.select("id", "n_chars", "edited", fingerprint("own_cells").alias("fingerprint"), fingerprint("new_cells").alias("edited_fingerprint"), "changed", likeness("own", "new", "changed").alias("near_edited"), likeness("own", "other", "apart").alias("near_next"), "times")
    return made.withColumn("copy", F.explode(F.expr("sequence(1L, times)"))).drop("times", "copy")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = versions(common.table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


QUERIES = {"op3_fingerprints": op3_fingerprints}
SQL: dict[str, str] = {}
