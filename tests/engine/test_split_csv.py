import csv
import random

import pytest
from pyspark.sql import functions as F

from paragraf import sources
from paragraf.sources import split_csv


@pytest.fixture
def splits(spark):
    """Files in splits of some bytes."""
    names = {"spark.sql.files.maxPartitionBytes": None, "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}

    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield of
    for n, v in before.items():
        spark.conf.set(n, v)


def field(rnd, breaks=("\n", "\r\n", "\n\n")):
    kind = rnd.randrange(6)
    if kind == 0:
        return ""
    if kind == 1:
        return '""'
    if kind == 2:
        return f"plain {rnd.randrange(99)} é"
    words = [rnd.choice(["a", "ü,", '""', *breaks, '"",""', "東京", "text"]) for _ in range(rnd.randint(1, 25))]
    return '"' + "".join(words) + '"'


def written(rnd, path, n, end="\n", **options):
    path.write_bytes(("citation,text,title" + end + "".join(",".join([f"k{k}", field(rnd, **options), field(rnd, **options)]) + end for k in range(n))).encode())


def in_one_task(spark, path):
    return spark.read.options(header="true", **sources.QUOTING).csv(str(path))


def test_as_sparks_reader(spark, splits, tmp_path):
    """Which makes \\r\\n within quotes \\n in some files; here it stays."""
    written(random.Random(9), tmp_path / "a.csv", 300, breaks=("\n", "\n\n"))
    want = sorted(map(tuple, in_one_task(spark, tmp_path).collect()), key=repr)
    splits(100)
    assert sorted((tuple(r)[:3] for r in sources.read_csv(spark, str(tmp_path), sources.LAWS).collect()), key=repr) == want


@pytest.mark.parametrize("size", [40, 333, 1 << 20])
def test_rows_and_their_order(spark, splits, tmp_path, size):
    rnd = random.Random(size)
    for n, end in ((0, "\n"), (1, "\r\n"), (2, "\n")):
        written(rnd, tmp_path / f"part-{n}.csv", 60, end)
    want = []
    for n in range(3):
        with open(tmp_path / f"part-{n}.csv", newline="", encoding="utf-8") as file:
            want += [tuple(r) for r in csv.reader(file)][1:]
    splits(size)
    found = sources.read_csv(spark, str(tmp_path), sources.LAWS)
    got = found.collect()
    assert sorted(tuple(x or "" for x in r[:3]) for r in got) == sorted(want)
    ordered = sorted(got, key=lambda r: r.ord)
    assert len({r.ord for r in got}) == 180 and [tuple(x or "" for x in r[:3]) for r in ordered] == want  # by path, then by place
    if size == 40:
        lines = split_csv.lines_of(spark, str(tmp_path))
        assert split_csv.prefixes(lines).where("odd = 1").count() > 10  # splits do begin inside quotes
        assert lines.select(F.spark_partition_id()).distinct().count() > 20


def test_a_field_over_many_splits(spark, splits, tmp_path):
    text = "line \"\"x\"\"\n" * 300
    (tmp_path / "a.csv").write_text(f'citation,text\nA,"{text}"\nB,b\nC,"open\nto the end', encoding="utf-8")
    splits(64)
    got = {r.citation: r.text for r in sources.read_csv(spark, str(tmp_path / "a.csv"), sources.COURTS).collect()}
    assert got == {"A": text.replace('""', '"'), "B": "b", "C": "open\nto the end"}


def test_small_files(spark, tmp_path):
    (tmp_path / "h.csv").write_text("citation,text\n")
    assert sources.read_csv(spark, str(tmp_path / "h.csv"), sources.COURTS).count() == 0
    (tmp_path / "b.csv").write_bytes("﻿citation,text\r\n\r\nA,b\r\n\r\n".encode())
    assert [tuple(r)[:2] for r in sources.read_csv(spark, str(tmp_path / "b.csv"), sources.COURTS).collect()] == [("A", "b")]
    (tmp_path / "t.csv").write_text("text,other,citation\n\"x\ny\",1,A\n")
    assert [(r.citation, r.text, r.title) for r in sources.read_csv(spark, str(tmp_path / "t.csv"), sources.LAWS).collect()] == [("A", "x\ny", None)]
