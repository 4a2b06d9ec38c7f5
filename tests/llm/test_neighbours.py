import numpy as np
import pytest
from pyspark.sql import functions as F

from paragraf.llm import neighbours

SHAPE = "vec_id long, embedding array<float>, rank string, least string"


def frame(spark, ids, x):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "x", "y") for i, v in zip(ids, x, strict=True)], SHAPE)


def exact(ids, x, queries, k):
    x = np.asarray(x, np.float32).astype(np.float64)
    out = {}
    for q in queries:
        n = ids.index(q)
        d = np.sqrt(((x - x[n]) ** 2).sum(1))
        out[q] = sorted((float(s), i) for s, i in zip(d, ids, strict=True) if i != q)[:k]
    return out


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    for rows in out.values():
        assert [r for r, _, _ in sorted(rows)] == list(range(1, len(rows) + 1))
    return {q: [(s, i) for _, s, i in sorted(rows)] for q, rows in out.items()}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, folder):
    rows = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet").collect()
    ids, x = [r.vec_id for r in rows], [r.embedding for r in rows]
    got = collected(neighbours.op7_ann(spark, f"/root/testdata/{folder}"))
    expected = exact(ids, x, [i for i in ids if i % 100 == 0], 10)
    assert set(got) == set(expected)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in expected[q]}) for q in expected)
    assert hits >= 0.9 * 10 * len(expected)
    scores = {(q, i): s for q, rows_ in expected.items() for s, i in rows_}
    assert all(scores.get((q, i), s) == pytest.approx(s, rel=1e-12) for q, rows_ in got.items() for s, i in rows_)


def test_hot_vector_and_ties(spark):
    rng = np.random.default_rng(1)
    x = [*np.tile(rng.standard_normal(8), (300, 1)), *rng.standard_normal((200, 8))]
    ids = list(range(500))
    got = collected(neighbours.search(frame(spark, ids, x), F.col("id") % 50 == 0, target=1.0))
    expected = exact(ids, x, [i for i in ids if i % 50 == 0], 10)
    for q in range(0, 300, 50):
        assert [i for _, i in got[q]] == [i for _, i in expected[q]] and [s for s, _ in got[q]] == pytest.approx([s for s, _ in expected[q]])
    hits = sum(len({i for _, i in got[q]} & {i for _, i in expected[q]}) for q in expected)
    assert hits >= 0.9 * 10 * len(expected)


def test_ties_of_a_block():
    rng = np.random.default_rng(3)
    x = np.vstack([np.eye(3000, 3000)[:2500], rng.standard_normal((200, 3000)) * 3])
    ids, q = rng.permutation(10_000)[: len(x)], np.zeros((3, 3000))
    q[1, 0], q[2] = 1, 5
    rows, found, exact_ = neighbours.nearest(q, x, ids, 11)
    for n in range(3):
        d = np.sqrt(((x - q[n]) ** 2).sum(1))
        assert list(zip(exact_[rows == n], found[rows == n], strict=True)) == sorted(zip(d, ids, strict=True))[:11]


def test_many_equal_distances(spark):
    # unit vectors of sixteen dimensions, each several times over in signs: all at one distance from the query
    rng = np.random.default_rng(5)
    x = [[0.25 * s for s in row] for row in rng.choice([-1.0, 1.0], (3000, 16))]
    x[0] = [0.0] * 15 + [1e-3]
    ids = list(range(3000))
    got = collected(neighbours.search(frame(spark, ids, [[0.0] * 15 + [1e-3], *x[1:]]), F.col("id") == 0, target=1.0))
    expected = exact(ids, x, [0], 10)
    assert [s for s, _ in got[0]] == pytest.approx([s for s, _ in expected[0]]) and [i for _, i in got[0]] == [i for _, i in expected[0]]


def test_doubles_are_ranked_as_doubles(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1e-12]), (2, [1.0, 2e-12]), (3, [0.0, 1.0])]
    found = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 0).collect()
    assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r.rank)] == [(1, 1e-12), (2, 2e-12), (3, pytest.approx(2**0.5))]


def test_targets_that_probes_do_not_reach(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MAX_PROBES", 2)
    rng = np.random.default_rng(6)
    x, ids = rng.standard_normal((3000, 16)), list(range(3000))
    got = collected(neighbours.search(frame(spark, ids, x), F.col("id") < 20, target=2.0))
    assert {q: [i for _, i in r] for q, r in got.items()} == {q: [i for _, i in r] for q, r in exact(ids, x, range(20), 10).items()}


def test_split_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "VISITS", 4)
    rng = np.random.default_rng(2)
    x, ids = rng.standard_normal((400, 4)), list(range(400))
    got = collected(neighbours.search(frame(spark, ids, x), F.col("id") < 20, k=5, target=1.0))
    expected = exact(ids, x, list(range(20)), 5)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in expected[q]}) for q in expected)
    assert hits >= 0.9 * 100


def test_who_takes_part(spark):
    x = [[1, 0], [0, 1], None, [0, 0], [None, 1], [float("nan"), 1], [float("inf"), 1], [], [1, 2, 3], [3, 4], [3, 4]]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, None, 9]
    got = collected(neighbours.search(frame(spark, ids, x), F.lit(True)))
    assert {q: {i for _, i in rows} for q, rows in got.items()} == {0: {1, 9}, 1: {0, 9}, 9: {0, 1}}
    twice = collected(neighbours.search(frame(spark, [0, 0, 1], [[1, 0], [1, 0], [0, 1]]), F.lit(True)))
    assert {q: [i for _, i in r] for q, r in twice.items()} == {0: [1], 1: [0]}
    assert neighbours.search(frame(spark, ids, x).limit(0), F.lit(True)).count() == 0
    assert neighbours.search(frame(spark, [3], [[1, 1]]), F.lit(True)).count() == 0


def test_perturbations_come_in_order():
    rest = np.array([0.1, 0.5, 0.8])
    score = lambda steps: sum(rest[j] ** 2 if s < 0 else (1 - rest[j]) ** 2 for j, s in steps)
    every = list(neighbours.perturbations(rest, 1000))
    assert len(every) == len(set(every)) == 27 and every[0] == ()
    assert [score(s) for s in every] == pytest.approx(sorted(score(s) for s in every))


def test_isolated_queries_get_all_their_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 32))
    x[:40] *= 6
    ids = list(range(6000))
    got = collected(neighbours.search(frame(spark, ids, x), F.col("id") < 40))
    expected = exact(ids, x, range(40), 10)
    assert {q: [i for _, i in got.get(q, [])] for q in expected} == {q: [i for _, i in rows] for q, rows in expected.items()}
