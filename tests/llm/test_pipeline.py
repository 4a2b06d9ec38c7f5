import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paragraf import llm
from paragraf.llm import near_copies

from .test_packing import check
from .test_substring import brute

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def edited(rnd, text, share):
    out = text.split(" ")
    for _ in range(max(1, int(len(out) * share))):
        out[rnd.randrange(len(out))] = words(rnd, 1)
    return " ".join(out)


def jaccard(a, b, n=5):
    sets = [{tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or {tuple(w)} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.fixture(scope="module")
def copies():
    rnd = random.Random(1)
    rows, base = [], []
    for k in range(120):
        base.append(words(rnd, rnd.randint(30, 300)))
        rows.append((k, base[-1]))
    for k in range(120, 400):
        b = rnd.randrange(120)
        rows.append((k, base[b] if k % 4 == 0 else edited(rnd, base[b], rnd.choice([0.005, 0.01, 0.02, 0.2]))))
    return rows


def test_near_copies_by_brute_force(spark, copies):
    root = {k: k for k, _ in copies}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (k, text) in enumerate(copies):
        for j, other in copies[:n]:
            if find(k) != find(j) and jaccard(text, other) >= 0.8:
                root[max(find(k), find(j))] = min(find(k), find(j))
    expected = {k: find(k) for k in root}
    frame = spark.createDataFrame([(k, t, "x") for k, t in copies], "doc_id long, text string, group_id string")
    got = {r.id: r.group_id for r in near_copies.groups(frame).collect()}
    assert set(got) == set(expected)
    assert got == expected
    kept = near_copies.keep_one(frame)
    assert kept.columns == frame.columns and kept.count() == len(set(got.values()))


def test_near_copies_edges(spark):
    rows = [(1, None), (2, ""), (3, " "), (None, "null id stays"), (None, "null id stays"), (4, "two words"), (5, "Two WORDS"), (6, "two other"), (6, "two other"), (7, "z" * 100_000), (8, "w " * 20_000), (9, "w " * 20_001)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id or 0) for r in near_copies.keep_one(frame).collect())
    assert kept == [0, 0, 1, 4, 6, 7, 8]
    assert near_copies.keep_one(frame.limit(0)).count() == 0


@pytest.fixture(scope="module")
def planted(tmp_path_factory, spark, copies):
    """A small corpus with toxic documents, copies, near copies and shared passages."""
    rnd = random.Random(3)
    passage = words(rnd, 60)
    docs = list(copies)
    docs += [(1000 + k, words(rnd, 40) + " you idiot " + words(rnd, 5) + " pathetic moron scum " + words(rnd, 40)) for k in range(60)]
    docs += [(2000 + k, words(rnd, 80) + " " + passage + " " + words(rnd, 80)) for k in range(5)]
    docs += [(3000, None), (3001, "")]
    folder = tmp_path_factory.mktemp("planted")
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in docs], SHAPE).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 0, int(1000 <= k < 2000)) for k, _ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), dict(docs)


def test_stages(spark, planted):
    folder, texts = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    made = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            docs = docs.checkpoint()
        made.append(docs)
    clean = {r.doc_id for r in made[0].collect()}
    assert clean == {k for k in texts if not 1000 <= k < 2000}
    one = {r.doc_id for r in made[1].collect()}
    assert one == {r.group_id for r in near_copies.groups(made[0]).collect()} and {2000, 2004, 3000} <= one and 3001 not in one
    assert len(one) < 260
    before, after = {r.doc_id: r.text for r in made[1].collect()}, {r.doc_id: r for r in made[2].collect()}
    removed = brute(list(before.items()))
    for k, r in after.items():
        assert len((r.text or "").split()) == removed[k][0] - removed[k][1] and r.n_chars == len(r.text or "")
        assert removed[k][1] or (r.text or "") == (before[k] or "")
    assert sum(removed[2000 + k][1] >= 60 for k in range(5)) == 4
    check(made[3].withColumnRenamed("doc_id", "id").select("id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect(), {k: r.text for k, r in after.items()}, 1024)


def test_run_is_the_stages(spark, planted):
    folder, _ = planted
    rows = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, rows.select(key).collect()), key=repr) == sorted(map(tuple, docs.select(key).collect()), key=repr)


def test_stages_take_nulls_and_nothing(spark, planted):
    folder, _ = planted
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "a", None, None, None), (1, "a", None, None, None), (2, "x" * 100_000, "l", "s", 5)], SHAPE).withColumn("_score", F.lit(1)).withColumn("id", F.lit("clash"))
    odd = odd.unionByName(spark.createDataFrame([(3, "", None, None, None, 1, "c"), (4, "\n " * 700_000, None, None, None, 1, "c")], odd.schema))
    kept = ([None, 1, 1, 2, 3, 4], [None, 1, 2, 3], [None, 1, 2, 3])
    for rows, expected in ((odd, kept), (odd.limit(0), ([], [], []))):
        docs = rows
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, folder).checkpoint()
            if n < 3:
                assert sorted((r.doc_id for r in docs.collect()), key=lambda x: x or 0) == expected[n], n
        placed = sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length) for r in docs.collect())
        assert [p for p in placed if p[0] != 2] == ([(-1, 0, 0, 1), (1, 0, 0, 2), (3, 0, 0, 1)] if expected[0] else [])
        assert len({p[1] for p in placed if p[0] == 2}) == sum(p[0] == 2 for p in placed)


def test_registry():
    names = llm.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and set(names) <= set(entry.queries()) and set(llm.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "packing"]


def test_entry_without_this_subpackage(tmp_path):
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    import shutil

    for n, gone in enumerate(({"llm", "corpus_pipeline.py"}, {"corpus_pipeline.py"})):
        ignored = lambda _, names: {x for x in names if x in gone | {".git", "__pycache__"}}  # noqa: B023, E731
        shutil.copytree(root, tmp_path / f"r{n}", ignore=ignored)
        code = f"import __spark_entry__ as e; q = e.queries(); assert 'q_bm25_topk' in q and any(k.startswith('op') for k in q) == {bool(n)} and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path / f"r{n}", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_near_copies_behind_an_unlike_text(spark):
    rnd = random.Random(5)
    shared, rows = words(rnd, 400), []
    for k in range(60):  # unlike texts of one boilerplate, which differ in few bits; copies of each come last
        rows.append((k, shared + " " + words(rnd, 160)))
    for k in range(60):
        rows.append((1000 + k, rows[k][1] + " " + words(rnd, 60)))
    assert jaccard(rows[0][1], rows[1][1]) < 0.8 <= min(jaccard(rows[k][1], rows[60 + k][1]) for k in range(60))
    got = {r.id: r.group_id for r in near_copies.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k % 1000 for k, _ in rows}


def test_near_copies_with_a_repeated_line(spark):
    rnd, rows = random.Random(6), []
    for k in range(20):
        text, line = words(rnd, 300), words(rnd, 10)
        rows += [(k, text), (100 + k, text + (" " + line) * 40)]
    assert min(jaccard(rows[2 * k][1], rows[2 * k + 1][1]) for k in range(20)) >= 0.8
    got = {r.id: r.group_id for r in near_copies.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k % 100 for k, _ in rows}


def test_near_copies_of_every_version(spark):
    rnd, rows = random.Random(7), []
    for k in range(10):
        first, second = words(rnd, 200), words(rnd, 200)
        rows += [(k, first), (k, second), (100 + k, first + " x"), (200 + k, second + " y")]
    got = {r.id: r.group_id for r in near_copies.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k % 100 for k, _ in rows}


def test_large_families_close_up(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    rnd = random.Random(8)
    base = words(rnd, 120)
    rows = [(k, edited(rnd, base, 0.02)) for k in range(150)] + [(500 + k, words(rnd, 60)) for k in range(20)]
    root = {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (k, text) in enumerate(rows):
        for j, other in rows[:n]:
            if find(k) != find(j) and jaccard(text, other) >= 0.8:
                root[max(find(k), find(j))] = min(find(k), find(j))
    got = {r.id: r.group_id for r in near_copies.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: find(k) for k in root}
    odd = spark.createDataFrame([(1, "a b c d e f", 1, 2, 3), (2, "a b c d e f", 1, 2, 3)], "doc_id long, text string, gone int, again int, copy int")
    assert [r.doc_id for r in near_copies.keep_one(odd).collect()] == [1]
