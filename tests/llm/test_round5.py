from itertools import combinations

import numpy as np

from paragraf.llm import common, near_copies


def test_pairs_are_compared_in_rounds(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 1 << 63, 60, dtype=np.uint64)
    raw = {k: np.unique(np.concatenate((base[: 60 - 3 * (k % 9)], rnd.integers(0, 1 << 63, k % 4, dtype=np.uint64)))) for k in range(24)}
    texts = spark.createDataFrame([(k, len(x)) for k, x in raw.items()], "t long, n int")
    sets = spark.createDataFrame([(k, bytearray(near_copies.packed(x))) for k, x in raw.items()], "t long, s binary")
    pairs = spark.createDataFrame(list(combinations(raw, 2)), "a long, b long")
    expected = sorted((a, b) for a, b in combinations(raw, 2) if len(c := np.intersect1d(raw[a], raw[b])) >= 0.8 * (len(raw[a]) + len(raw[b]) - len(c)))
    assert 0 < len(expected) < pairs.count()
    seen, alike = [], near_copies._alike
    monkeypatch.setattr(near_copies, "_alike", lambda p, *rest: seen.append(p.count()) or alike(p, *rest))
    for bound, several in ((1 << 20, False), (1 << 10, True)):
        monkeypatch.setattr(near_copies, "ROUND_BYTES", bound)
        seen.clear()
        assert sorted(map(tuple, near_copies._in_rounds(pairs, sets, texts, 0.8).collect())) == expected
        assert (len(seen) > 5) == several and sum(seen) == pairs.count()  # was one join of all pairs, however many there were
    folder = spark._jvm.org.apache.hadoop.fs.Path(common.shared_folder(spark))
    left = [x.getPath().getName() for x in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)]
    assert not [x for x in left if x.startswith("sets-")]
