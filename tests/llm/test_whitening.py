import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paragraf.llm import whitening


def brute(vectors, components=4):
    """vectors: (id, list); the same results by plain Python and NumPy."""
    x = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in vectors]
    fit = sorted({tuple(v) for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    apart = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in fit])
    cov = apart.T @ apart / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    out = {}
    for i, v in x:
        y = np.array([(n * a - s) / n for a, s in zip(v, sums, strict=True)]) @ u
        out.setdefault(i, []).append((sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)), y / np.sqrt(np.maximum(e, 1e-300)), e / np.trace(cov)))
    return n, out


def frame(spark, rows):
    return spark.createDataFrame([(a, b, 0.5, "x") for a, b in rows], "vec_id long, embedding array<float>, whitened double, id string")


def held(spark, rows, components=4):
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, want = brute(good, components)
    found = whitening.whiten(frame(spark, rows), components=components).collect()
    assert len(found) == components * len(good)
    signs = {}
    for r in found:
        d, y, share = want[r.id][0]
        assert r.n == n and int(r.deviation) == d
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
        sign = signs.setdefault(r.component, np.sign(r.whitened) * np.sign(y[r.component - 1])) or 1
        assert r.whitened * sign == pytest.approx(y[r.component - 1], abs=1e-7)
        assert r.identity_error < 1e-9
    return found


def test_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(k, (rng.normal(size=8) * np.arange(1, 9)).tolist()) for k in range(300)]
    rows += [(1000 + k, rows[3][1]) for k in range(150)]  # a third of all rows hold one vector
    rows += [(2000, None), (2001, []), (2002, [1.0] * 7 + [None]), (2003, [math.nan] + [1.0] * 7), (2004, [math.inf] + [0.0] * 7), (3, rows[3][1])]
    held(spark, rows)


def test_table(spark, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in source.collect()]
    n, want = brute([(i, v) for i, v in rows])
    found = whitening.op13_whitening(spark, sf_dir)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert [t for _, t in found.dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    got = found.collect()
    assert len(got) == 4 * len(rows)
    for r in got:
        d, y, share = want[r.vec_id][0]
        assert (r.n, r.deviation) == (n, d) and r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
        assert abs(r.whitened) == pytest.approx(abs(y[r.component - 1]), abs=1e-7)
        assert r.identity_error < 1e-9
    spread = np.array([[r.whitened for r in sorted(got, key=lambda r: r.vec_id) if r.component == c] for c in range(1, 5)])
    assert np.abs(np.cov(spread, bias=True) - np.eye(4)).max() < 0.05  # rows, not the distinct ones


def test_degenerate(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None)])).collect() == []
    alone = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert len(alone) == 4 and all((r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None) for r in alone)
    line = whitening.whiten(frame(spark, [(k, [float(k), 2.0 * k, 7.0]) for k in range(5)])).collect()
    assert len(line) == 15  # three dimensions, of which one direction varies
    assert all((r.whitened is None) == (r.component > 1) for r in line)
    assert all(r.identity_error < 1e-9 for r in line)
    lengths = whitening.whiten(frame(spark, [(1, [1.0]), (2, [1.0, 2.0]), (3, [2.0, 1.0]), (4, [1.0])])).collect()
    assert {r.id for r in lengths} == {2, 3}


def test_large_numbers(spark):
    """Sums and squares beyond 64 bits are exact."""
    rows = [(1, [1e15, 0.0]), (2, [-1e15, 3.0]), (3, [5e14, 1e-3])]
    _, want = brute(rows, 2)
    assert {(r.id, int(r.deviation)) for r in whitening.whiten(frame(spark, rows)).collect()} == {(i, want[i][0][0]) for i, _ in rows}
    far = whitening.whiten(frame(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0])])).collect()
    assert {r.deviation for r in far} == {None}  # beyond 38 digits
    assert all(abs(r.whitened) == pytest.approx(1.0) for r in far if r.component == 1)
    x = np.array([[1 << 40, -3], [5, 9]], np.int64)
    sums = ((1 << 70) + 1, -7)
    assert whitening.deviations(x, 11, sums) == [sum((11 * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]
    x = np.random.default_rng(0).integers(-500, 500, (20, 64))
    n = 3_000_000_000_000
    sums = tuple(int(s) for s in np.random.default_rng(1).integers(-500 * n, 500 * n, 64))
    assert whitening.deviations(x, n, sums) == [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]


def test_usable(spark):
    df = frame(spark, [(1, [1.0]), (2, None), (3, []), (4, [None]), (5, [math.nan]), (6, [-math.inf])])
    assert [r.vec_id for r in df.where(whitening.usable(F.col("embedding"))).collect()] == [1]
