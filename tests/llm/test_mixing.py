import math
from collections import defaultdict
from fractions import Fraction

import duckdb
import pytest

from paragraf.llm import mixing


def targets(sizes, weights=(3, 1, 2), share=Fraction(3, 2), most=2):
    """Exact targets of sources in order, by sharing again and again."""
    left, goal, found = dict(enumerate(sizes)), share * sum(sizes), {}
    while left:
        unit = goal / sum(weights[k % 3] for k in left)
        over = [k for k, n in left.items() if weights[k % 3] * unit > most * n]
        if not over:
            return [found.get(k, weights[k % 3] * unit) for k in range(len(sizes))]
        for k in over:
            found[k] = Fraction(most * left.pop(k))
            goal -= found[k]
    return [found[k] for k in range(len(sizes))]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, n string")


ROWS = [(k, " ".join(["w"] * (k * 37 % 211)), f"s{k % 5}" if k % 3 else "hot") for k in range(600)]
ROWS += [(700 + k, None if k % 2 else " \t\n", "s1") for k in range(6)] + [(None, "a b c", "s2")] * 40 + [(800, "x " * 7, None)] * 30 + [(801, "", None), (900, "long " * 30_000, "é")]


def held(rows, found):
    """The rules of the mix; found: (id, size, source_size, target, taken) rows in any order."""
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    want = dict(zip(order, targets([sizes[s] for s in order]), strict=True))
    left = defaultdict(int)
    for i, text, source in rows:
        left[i, len((text or "").split()), sizes[source], round(float(want[source]), 6)] += 1
    taken = defaultdict(int)
    for r in found:
        left[r.id, r.size, r.source_size, round(r.target, 6)] -= 1
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source_size, round(r.target, 6)] += r.taken
    assert not any(left.values())
    for s in order:
        assert abs(taken[sizes[s], round(float(want[s]), 6)] - want[s]) <= 0.5


def test_rules(spark):
    mix = mixing.Mix(frame(spark, ROWS), block=64)
    found = mix.taken().collect()
    held(ROWS, found)
    again = mixing.Mix(frame(spark, ROWS[::-1]).repartition(7), block=64).taken().collect()
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, again), key=repr)


def test_schedule(spark):
    """Slots are full, blocks follow their ranks, and every stretch of the mix has about the shares of the whole."""
    docs = frame(spark, [r for r in ROWS if r[0] is not None and r[0] != 800])
    mix = mixing.Mix(docs, block=64)
    spans = mix.spans().collect()
    slots = defaultdict(list)
    for r in spans:
        slots[r.slot].append(r)
    short = 0
    for held_ in slots.values():
        assert len({r.source for r in held_}) == 1
        held_.sort(key=lambda r: r["at"])
        end = 0
        for r in held_:
            assert r["at"] == end
            end += r.word_stop - r.word_start
        short += end < 64
    total = sum(r.word_stop - r.word_start for r in spans)
    assert short <= mix.sources.count() and abs(len(slots) - total / 64) <= mix.sources.count()
    shares = {r.source: r.take / total for r in mix.sources.collect()}
    points = sorted(slots)[: int(total / 64) // 100 * 100]
    for k in range(0, len(points), 100):
        for s, share in shares.items():
            n = sum(slots[p][0].source == s for p in points[k : k + 100])
            assert abs(n - 100 * share) <= 5, (k, s)
    words = mixing.texts(mix.spans(), docs).collect()
    assert sum(len(r.text.split()) for r in words) == total


def test_floods(spark):
    """Copies in a third of all rows are laid out in parts, one hot source in cells."""
    rows = [(7, "a b", "s")] * 25_000 + [(None, None, None)] * 12_000 + [(k, "c " * (k % 9), "s") for k in range(2_000)]
    mix = mixing.Mix(frame(spark, rows))
    held(rows, mix.taken().collect())


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, " ", "b")], [(1, "one", "a")], [(1, "one two", None), (1, "one two", None)]])
def test_small(spark, rows):
    found = mixing.Mix(frame(spark, rows)).taken().collect()
    held(rows, found)


def test_levels(spark):
    for sizes in ([10, 10, 10], [1, 100, 1000], [1000, 1, 1, 1, 50, 0], [0, 0], [5]):
        df = spark.createDataFrame([(w, n) for w, n in zip((3, 1, 2, 3, 1, 2), sizes, strict=False)], "weight int, source_size long")
        level = mixing.level_of(df, Fraction(3, 2), 2)
        want = targets(sizes)
        for k, n in enumerate(sizes):
            assert min(2 * n, (3, 1, 2)[k % 3] * level) == pytest.approx(float(want[k]))
    assert math.isinf(mixing.level_of(spark.createDataFrame([(1, 5)], "weight int, source_size long"), Fraction(3), 2))


def test_sql(spark, sf_dir):
    found = mixing.op12_mixing(spark, sf_dir)
    assert [t for _, t in found.dtypes] == ["bigint", "bigint", "bigint", "double", "bigint"]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(mixing.SQL["op12_mixing"])
    order = [want.columns.index(c) for c in found.columns]
    assert sorted(map(tuple, found.collect())) == sorted(tuple(r[k] for k in order) for r in want.fetchall())


def test_sql_of_copies(spark):
    rows = frame(spark, ROWS)
    found = sorted((tuple(r) for r in mixing.Mix(rows).taken().collect()), key=repr)
    con = duckdb.connect()
    documents = rows.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"})  # noqa: F841
    con.register("documents", documents)
    assert found == sorted(con.sql(mixing.SQL["op12_mixing"]).fetchall(), key=repr)
