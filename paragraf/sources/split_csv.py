"""CSV files whose quoted fields hold line breaks, read by all cores: true record starts by the parity of quotes.

A line begins a record if the quotes before it in its file are even in number. Each split of a file counts
its lines and quotes in one pass; a prefix over splits says with which parity, and at which line, a split
begins; then every split cuts its own lines into records. What a split has of a record that begins before
it, or ends after it, is a piece; pieces, two a split at most, are put together by their place. Only the
prefix, three numbers a split, goes to all tasks.

Quotes within quoted fields are doubled, as writers do it; a lone quote inside an unquoted field is not
foreseen, nor are files whose lines end with carriage returns alone. A quote that is never closed makes the
rest of its file one record. Blank lines between records are left out, and a byte order mark is none of the
header's. Compressed files are one split. Empty files, and those of a header alone, have no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ready, stable

#: Splits whose prefix is broadcast (24 bytes each); more are not read this way.
MOST_SPLITS = 4_000_000
WHOLE, CONTINUED, OPEN = 0, 1, 2
RECORDS = "file long, at long, part int, record string"


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line) in the order of a file's split."""
    rows = spark.read.text(path, lineSep="\n")
    return rows.select(F.col("value").alias("line"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_path").alias("name"), F.col("_metadata.file_block_start").alias("block"))


def prefixes(lines: DataFrame) -> DataFrame:
    """(file, block, odd, base): whether a split begins inside quotes, and the lines before it in all files, by path and place."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    splits = lines.groupBy("name", "file", "block").agg(F.sum(quotes).alias("quotes"), F.count("*").alias("lines"))
    inside = Window.partitionBy("name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("odd", F.coalesce(F.sum("quotes").over(inside), F.lit(0)) % 2)
    within = F.coalesce(F.sum("lines").over(inside), F.lit(0))
    files = splits.groupBy("name").agg(F.sum("lines").alias("of_file"))
    files = files.select("name", F.coalesce(F.sum("of_file").over(Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))  # a row a file
    return splits.withColumn("within", within).join(files, "name").select("file", "block", "odd", (F.col("ahead") + F.col("within")).alias("base"))


def cut(lines: DataFrame, pieces: bool) -> DataFrame:
    """(file, at, part, record): whole records, or the pieces of those that cross borders; lines: (file, block, odd, base, line) as they lie."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held, part, at, n, inside = None, [], WHOLE, 0, 0, False
        out: list[tuple] = []

        def close(whole: bool) -> None:
            kind = part if part == CONTINUED else WHOLE if whole else OPEN
            if (kind != WHOLE) == pieces:
                out.append((split[0], at, kind, "\n".join(held) if len(held) > 1 else held[0]))

        for batch in batches:
            odd_lines = pc.bit_wise_and(pc.count_substring(batch.column("line"), '"'), 1).to_pylist()
            rows = zip(*(batch.column(c).to_pylist() for c in ("file", "block", "odd", "base", "line")), odd_lines, strict=True)
            for file, block, odd, base, line, flips in rows:
                if split != (file, block):
                    if held:
                        close(False)
                    if odd is None:
                        raise ValueError("a split was not met when quotes were counted")
                    split, held, n, inside = (file, block), [], base, odd == 1
                    part, at = (CONTINUED if inside else WHOLE), base
                if not held:
                    at = n
                held.append(line)
                n += 1
                inside ^= flips == 1
                if not inside:
                    close(True)
                    held, part = [], WHOLE
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["file", "at", "part", "record"])
                out.clear()
        if held:
            close(False)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["file", "at", "part", "record"])

    return lines.select("file", "block", "odd", "base", "line").mapInArrow(run, RECORDS)


def stitched(pieces: DataFrame) -> DataFrame:
    """Records of their pieces: an open one and those that continue it."""
    number = F.sum((F.col("part") == OPEN).cast("int")).over(Window.partitionBy("file").orderBy("at"))
    grouped = pieces.withColumn("number", number).groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("at", "record"))).alias("all"))
    return grouped.select("file", F.get("all", F.lit(0))["at"].alias("at"), F.array_join(F.transform("all", lambda x: x["record"]), "\n").alias("record"))


def records(spark: SparkSession, path: str) -> DataFrame | None:
    """(at, record): the records of all files but their first ones, numbered increasingly by path and place; None if there are too many splits."""
    ready(spark)
    lines = lines_of(spark, path)
    before = stable(prefixes(lines))
    if before.count() > MOST_SPLITS:
        return None
    placed = lines.join(F.broadcast(before), ["file", "block"], "left")
    found = cut(placed, False).select("file", "at", "record")
    if before.where("odd = 1").count():
        found = found.unionByName(stitched(cut(placed, True)))
    first = before.groupBy("file").agg(F.min("base").alias("header"))
    found = found.join(F.broadcast(first), "file").where("at > header")
    return found.select("at", F.regexp_replace("record", "\r$", "").alias("record")).where("record <> ''")
