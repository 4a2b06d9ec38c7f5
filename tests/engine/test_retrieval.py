import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paragraf.operators import bm25, chunk, dense, fusion


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def test_small_corpora_have_no_hits(spark):
    index = bm25.build(docs_of(spark, ["der Vertrag kommt zustande", "die Freiheit der Meinung"]))
    assert bm25.search(asked(spark, "Vertrag der"), index).count() == 0
    index = bm25.build(docs_of(spark, ["Zum Abschlusse eines Vertrages", "Das Gesetz findet Anwendung", "Wer fahrlässig handelt"]))
    assert bm25.search(asked(spark, "Vertrag"), index).count() == 0
    assert bm25.search(asked(spark, "Vertrages", "FAHRLÄSSIG", "  ", ""), index).select("query_id").distinct().count() == 2
    assert bm25.search(asked(spark, "Vertrages"), index, 0).count() == 0


def test_scores_by_brute_force(spark, tmp_path):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("a b c d e f g h ä_ö x1".split()) for _ in range(rnd.randint(0, 12))) for _ in range(40)] + [None, ""]
    tokens = [t.split() if t else [] for t in texts]
    n, avg = len(texts), sum(map(len, tokens)) / len(texts)
    df = {w: sum(w in t for t in tokens) for t in tokens for w in t}
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    query = "a a ä_ö zz"
    expected = {d: sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in query.split()) for d, t in enumerate(tokens)}
    index = bm25.build(docs_of(spark, texts))
    got = {r.doc_id: r.score for r in bm25.search(asked(spark, query), index, 100).collect()}
    assert got == pytest.approx({d: s for d, s in expected.items() if s > 0})
    index.save(str(tmp_path / "i"))
    again = bm25.get_or_build(spark, str(tmp_path / "i"), docs_of(spark, ["other"]))
    assert {r.doc_id: r.score for r in bm25.search(asked(spark, query), again, 100).collect()} == pytest.approx(got)
    rebuilt = bm25.get_or_build(spark, str(tmp_path / "none"), docs_of(spark, ["other words"]))
    assert rebuilt.count == 1


def test_dense(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, vec array<double>")
    queries = rows.limit(20).withColumnRenamed("doc_id", "query_id")
    for block in (16384, 3):
        got = dense.search(queries, rows, 5, block=block).collect()
        for q in {r.query_id for r in got}:
            best = np.argsort(-(x @ x[q]), kind="stable")[:5]
            assert [r.doc_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == best.tolist()
    zero = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "vec array<double>").select(dense.normalize("vec").alias("v")).collect()
    assert sorted(r.v for r in zero) == [[0.0, 0.0], [0.6, 0.8]]
    assert dense.dimension(rows) == 8
    assert dense.search(queries.limit(0), rows).count() == 0


def test_embedding_build(spark):
    calls = spark.sparkContext.accumulator(0)

    def embedder(texts):
        calls.add(1)
        return [[float(len(t)), 1.0] for t in texts]

    docs = spark.createDataFrame([(1, "aa bb cc", "x"), (2, None, "y")], "doc_id long, text string, citation string")
    made = dense.build(docs, embedder, chunk.chunks("text", 2)).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.chunk_index, r.n_chunks, r.chunk, r.citation) for r in made] == [(1, 0, 2, "aa bb ", "x"), (1, 1, 2, "cc", "x"), (2, 0, 1, "", "y")]
    assert made[2].vec == pytest.approx([2**-0.5, 2**-0.5])


def test_chunks():
    text = "one two three. four five six\n\nseven eight nine ten\neleven"
    assert chunk.chunk_text(text, 100) == [text]
    assert chunk.chunk_text("  ") == [""] and chunk.chunk_text(None) == [""]
    for limit in (1, 2, 3, 5):
        parts = chunk.chunk_text(text, limit)
        assert "".join(parts) == text and all(len(chunk.Words.encode(p)) <= limit for p in parts)
    assert chunk.windows(list(range(10)), 4, 1) == [[0, 1, 2, 3], [3, 4, 5, 6], [6, 7, 8, 9]]
    assert chunk.merge([("a", 3), ("b", 3), ("c", 4)], 6, 3) == ["ab", "bc"]
    letters = chunk.chunk_text("x" * 5, 2, codec=type("L", (), {"encode": staticmethod(list), "decode": staticmethod("".join)}))
    assert letters == ["xx", "xx", "x"]


def test_word_windows(spark):
    rows = spark.createDataFrame([(0, "a b c d e f g"), (1, ""), (2, None)], "i int, t string")
    assert [r.w for r in rows.orderBy("i").select(chunk.word_windows("t", 4, 1).alias("w")).collect()] == [["a b c d", "d e f g"], [""], [""]]


def test_rrf(spark):
    first = spark.createDataFrame([(1, 1, "A"), (1, 2, " "), (1, 3, "B"), (1, 4, "B")], "query_id int, rank int, c string")
    second = spark.createDataFrame([(1, 1, "A"), (1, 2, "C")], "query_id int, rank int, c string")
    got = [(r.c, r.score) for r in fusion.rrf([first, second], 10, "c").orderBy("rank").collect()]
    assert got == [("A", pytest.approx(2 / 61)), ("B", pytest.approx(1 / 63 + 1 / 64)), ("C", pytest.approx(1 / 62))]


def test_threshold_before_cap(spark):
    hits = spark.createDataFrame([(1, r, r, 1.0 / r) for r in range(1, 60)], "query_id int, rank int, doc_id int, score double")
    assert [r["rank"] for r in fusion.above(hits, 0.3, 2).collect()] == [1, 2]


def test_tool(spark):
    rows = spark.createDataFrame([(1, "Art. 6a Abs. 3 BankG", "Art. 6a Abs. 3"), (2, "Vertrag", None), (3, " ", None), (4, None, None)], "query_id int, query string, expected string")
    assert all(r.x == r.expected for r in rows.select("expected", fusion.loosen("query").alias("x")).collect())
    docs = spark.createDataFrame([(1, "Art. 1 OR", "text")], "doc_id int, citation string, text string")
    results = spark.createDataFrame([(1, 1, 1, 0.5)], "query_id int, rank int, doc_id int, score double")
    out = {r.query_id: r.output for r in fusion.formatted(rows, results, docs).collect()}
    assert out[1] == "[0.500] Art. 1 OR\ntext" and out[2] == "No relevant federal laws found for: 'Vertrag'" and out[3] == out[4] == fusion.EMPTY_QUERY
    both = {r.query_id: r.output for r in fusion.combined(*(fusion.formatted(rows, results, docs, c) for c in ("laws", "courts"))).collect()}
    assert both[2].startswith("=== Federal Laws (SR) ===\nNo relevant federal laws") and "\n\n=== Court Decisions ===\nNo relevant court decisions" in both[2]
    assert "a: b" in fusion.tool_descriptions({"a": " b "})


def test_rerank_with_a_model(spark):
    pairs = spark.createDataFrame([(1, 1, "q", "aa"), (1, 2, "q", "bbbb"), (1, 3, "q", "c")], "query_id int, rank int, query string, text string")
    scored = fusion.model_scores(pairs, lambda q, t: [len(x) for x in t])
    got = fusion.rerank(scored, F.col("model_score"), 2, with_sigmoid=True).orderBy("rank").collect()
    assert [r.text for r in got] == ["bbbb", "aa"] and got[0].rerank_score == pytest.approx(1 / (1 + math.exp(-4)))
