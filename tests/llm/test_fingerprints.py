import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from paragraf.llm import fingerprints


def pieces(text):
    return {m for m in re.findall(rf"[^\n]{{1,{fingerprints.PIECE}}}[^\n.!?]*[.!?]*", text) if m.strip(" ")}


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    """Of distinct, non-null ids."""
    ordered = sorted(((k, t or "") for k, t in rows), reverse=True)
    out = {}
    for n, (k, text) in enumerate(ordered):
        following = ordered[(n + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        out[k] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), likeness(pieces(text), pieces(edited)), likeness(pieces(text), pieces(following)))
    return out


def check(df, rows):
    got = {r.id: (r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest(), r.near_edited, r.near_next) for r in df.collect()}
    expected = brute(rows)
    assert set(got) == set(expected)
    for k, x in expected.items():
        assert got[k][:2] == x[:2] and got[k][2:] == pytest.approx(x[2:])


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    expected = brute(rows)
    for r in fingerprints.op3_fingerprints(spark, sf_dir).collect():
        assert (r.n_chars, r.edited_sha256) == expected[r.doc_id][:2]
        assert (r.near_edited, r.near_next) == pytest.approx(expected[r.doc_id][2:])


def test_ranges_and_long_texts(spark, docs, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 7)
    rnd = random.Random(1)
    line = lambda: " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 9) for _ in range(rnd.randint(1, 60)))
    rows = [(rnd.randrange(10**12) - 5 * 10**11, "\n".join(line() for _ in range(rnd.randint(0, 12)))) for _ in range(90)]
    rows += [(7, None), (8, ""), (9, "\n".join(line() for _ in range(900))), (11, "é😀ß." * 400), (12, "x" * 150_000)]
    check(fingerprints.versions(docs(rows)), rows)


def test_equal_texts_have_equal_fingerprints(spark, docs):
    rows = fingerprints.versions(docs([(1, "a b.\nc"), (2, "a b.\nc"), (3, "d"), (4, None), (5, "")])).collect()
    by = {r.id: r.fingerprint for r in rows}
    assert by[1] == by[2] != by[3] and by[4] == by[5] == "0" * len(by[5])
    assert next(r for r in rows if r.id == 5).near_next == 1.0


def test_recovered_digests(spark):
    """Every size of difference, through all sizes of sketches."""
    rnd = random.Random(2)
    some = lambda n: [rnd.getrandbits(64) - 2**63 for _ in range(n)]
    rows = []
    for n in (0, 1, 2, 5, 30, 300):
        both = some(n)
        rows += [(both + some(k), both + some(j)) for k in (0, 1, 3, 40) for j in (0, 2, 9)]
    df = spark.createDataFrame(rows, "left array<long>, right array<long>")
    made = F.expr(fingerprints.difference("left", "right", fingerprints.sketch("left"), fingerprints.sketch("right")))
    for r in df.select("left", "right", made.alias("d")).collect():
        assert {x.k for x in r.d if x.n == 1} == set(r.left) - set(r.right)
        assert {x.k for x in r.d if x.n == -1} == set(r.right) - set(r.left)
        assert len(r.d) == len(set(r.left) ^ set(r.right))


def test_peeling_gets_stuck_and_says_so(spark):
    df = spark.createDataFrame([(list(range(1, 200)), [])], "left array<long>, right array<long>")
    assert df.select(F.expr(fingerprints.peel(fingerprints.subtract(fingerprints.sketch("left"), fingerprints.sketch("right")))).alias("d")).first().d is None


def test_edges(spark, docs):
    one = fingerprints.versions(docs([(5, "alone here")])).first()
    assert one.edited == "aloneaone"[:5] + "alone" and one.near_next == 1.0
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, None)]
    assert fingerprints.versions(docs(rows)).count() == 5
    assert fingerprints.versions(docs(rows).limit(0)).count() == 0


def test_no_python_on_the_main_path(spark, sf_dir):
    plan = fingerprints.op3_fingerprints(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)


def test_an_id_of_many_rows_is_split_over_ranges(spark, docs, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 10)
    rows = [(5, f"text {k}. {k} other") for k in range(300)] + [(None, f"n {k}") for k in range(100)] + [(9, "last"), (-9, "first")]
    found = fingerprints.with_next(docs(rows).select(F.col("doc_id").alias("id"), "text")).select("id", "text", F.col("next.text").alias("next"), F.spark_partition_id().alias("p")).collect()
    mark = lambda r: (fingerprints.LOWEST if r[0] is None else r[0], hashlib.md5(r[1].encode()).hexdigest())
    ordered = sorted(rows, key=mark, reverse=True)
    expected = {r: ordered[(n + 1) % len(ordered)][1] for n, r in enumerate(ordered)}
    assert {(r.id, r.text): r.next for r in found} == expected


def test_equal_rows_are_one_in_a_range(spark, docs, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 10)
    rows = [(None, "same. text")] * 200 + [(7, None)] * 60 + [(k, f"text {k}. {k} other") for k in range(140)]
    found = fingerprints.versions(docs(rows))
    held = found.select("id", "edited", "near_next").collect()
    mark = lambda r: (fingerprints.LOWEST if r[0] is None else r[0], hashlib.md5((r[1] or "").encode()).hexdigest())
    ordered = [(i, t or "") for i, t in sorted(rows, key=mark, reverse=True)]
    want = []
    for n, (i, t) in enumerate(ordered):
        half = len(t) // 2
        want.append((i, t[: len(t) - half] + ordered[(n + 1) % len(ordered)][1][:half]))
    assert sorted(((r.id, r.edited) for r in held), key=repr) == sorted(want, key=repr)
    assert sum(r.near_next == 1.0 for r in held) >= 258
    sizes = [n for _, n in fingerprints.with_next(docs(rows).select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))).groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2]
