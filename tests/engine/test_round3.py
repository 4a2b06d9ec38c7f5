import random

import numpy as np
from pyspark.sql import functions as F

from paragraf.operators import agent, bm25, chunk, dense, graph


def test_windows_split_a_text_once(spark):
    df = spark.createDataFrame([("a b c d e f g",), ("",), (None,)], "text string").select(chunk.word_windows("text", 3, 1).alias("w"))
    assert [r.w for r in df.collect()] == [["a b c", "c d e", "e f g"], [""], [""]]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_best_of_tiles_by_brute_force():
    rnd = np.random.default_rng(3)
    scores, ids = rnd.integers(0, 9, (5, 70)).astype(float), rnd.permutation(70)
    top_s, top_d = np.full((5, 4), np.nan), np.full((5, 4), dense.NONE)
    for at in (0, 3, 40, 67):
        upto = {0: 3, 3: 40, 40: 67, 67: 70}[at]
        dense.merge_best(top_s, top_d, scores[:, at:upto], ids[at:upto])
    for q in range(5):
        best = sorted((-scores[q, n], ids[n]) for n in range(70))[:4]
        assert [(-s, d) for s, d in zip(top_s[q], top_d[q], strict=True)] == best


def edges_of(spark, n=14, m=60, seed=5):
    rnd = random.Random(seed)
    found = sorted({(f"P{rnd.randrange(n)}", f"P{rnd.randrange(n)}") for _ in range(m)})
    return [(s, d, round(rnd.uniform(-1, 3), 3)) for s, d in found]


def test_neighbours_of_full_seeds_by_brute_force(spark):
    rows = edges_of(spark)
    edges = spark.createDataFrame(rows, "src string, dst string, weight double")
    seeds = spark.createDataFrame([(f"P{n}",) for n in range(14)] + [("P99",)], "seed string")
    for k in (2, 5, 30):  # all seeds, some, or none have k nodes beside them
        expected = []
        for (seed,) in seeds.collect():
            ways = [(d, 1, w) for s, d, w in rows if s == seed] + [(s, 1, w) for s, d, w in rows if d == seed]
            ways += [(e, 2, w * v) for s, d, w in rows if s == seed for t, e, v in rows if t == d] + [(t, 2, w * v) for s, d, w in rows if d == seed for t, e, v in rows if e == s]
            nodes = {}
            for c, d, w in ways:
                if c != seed:
                    old = nodes.get(c, (9, -9.0))
                    nodes[c] = (min(old[0], d), max(old[1], w))
            expected += [(seed, c, d) for c, (d, w) in sorted(nodes.items(), key=lambda x: (x[1][0], -x[1][1], x[0]))[:k]]
        got = graph.neighbours(seeds, edges, k).orderBy("seed", "rank").collect()
        assert sorted(expected) == sorted((r.seed, r.case_id, r.distance) for r in got)
    one = spark.createDataFrame([("a", "b"), ("a", "c"), ("d", "d"), ("e", "b")], "seed string, case_id string")
    marks = {r.seed: r.marks for r in graph._marks(one, 2).collect()}
    assert set(marks["d"]) == set(marks["e"]) == {-1} and 1 <= sum(bin(x % (1 << 64)).count("1") for x in marks["a"]) <= 2


def test_cocited_in_fine_partitions(spark, monkeypatch):
    edges = spark.createDataFrame(edges_of(spark), "src string, dst string, weight double")
    seeds = edges.select(F.col("dst").alias("seed"))
    plain = sorted(map(tuple, graph.cocited(seeds, edges, 4).collect()))
    monkeypatch.setattr(graph, "PARTITION_EDGES", 5)
    fine = graph.cocited(seeds, edges, 4)
    assert sorted(map(tuple, fine.collect())) == plain and plain
    assert "REPARTITION_BY_NUM" in fine._jdf.queryExecution().executedPlan().toString()


def test_scores_in_fine_partitions(spark, monkeypatch):
    rnd = random.Random(4)
    docs = spark.createDataFrame([(n, " ".join(f"w{rnd.randrange(40)}" for _ in range(9))) for n in range(60)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "w1 w2 w2"), (2, "w3 zz w4"), (3, "")], "query_id long, query string")
    index = bm25.build(docs)
    plain = [(r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in bm25.search(asked, index, 5).collect()]
    monkeypatch.setattr(bm25, "TASK_SCORES", 10)
    fine = bm25.search(asked, index, 5)
    assert sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in fine.collect()) == sorted(plain) and plain
    assert "REPARTITION_BY_NUM" in fine._jdf.queryExecution().executedPlan().toString()


def test_tools_that_nobody_calls_are_not_asked(spark):
    asked = []

    def tool(calls):
        asked.append(calls)
        return calls.select("query_id", F.lit("seen").alias("output"))

    def model(prompts):
        return ["Final Answer: done" if "Observation:" in p else "Action: search\nAction Input: x\n" for p in prompts]

    queries = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, query string")
    answers, _ = agent.run(queries, model, {"search": tool, "other": tool}, "{query}\n")
    assert {r.answer for r in answers.collect()} == {"done"} and len(asked) == 1


def test_pipeline_leaves_no_shuffle_files_to_the_collector(spark):
    import corpus_pipeline as c

    c._ready(spark)
    assert spark.conf.get(c.CLEANUP_SETTING) == "true"
