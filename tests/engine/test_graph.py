import math

import pytest
from pyspark.sql import functions as F

from paragraf.operators import graph


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.fixture(scope="module")
def corpora(spark):
    courts = [(0, "BGE 100 I 1 E. 1", "Siehe BGE 101 I 5 E. 2; BGE 101 I 5, Art. 1 OR."), (1, "BGE 101 I 5 E. 1", "BGE 101 I 5 selbst."), (2, "BGE 100 I 1 E. 2", "Zweiter Teil BGE 999 I 9."), (3, "BGE 102 II 7 E. 3", "BGE 101 I 5; Art. 1 OR, Art. 2 ZGB"), (4, "4A_1/2020 E. 1", "BGE 101 I 5"), (5, None, None)]
    laws = [(0, "Art.  1  220", "Art. 1 220 und Art. 2 ZGB; BGE 100 I 1", "T1"), (1, "Art. 1 220", "mehr", "T2"), (2, "", "x", ""), (3, "Art. 2 ZGB", None, None)]
    return spark.createDataFrame(courts, "ord long, citation string, text string"), spark.createDataFrame(laws, "ord long, citation string, text string, title string")


def test_cases(corpora):
    got = {r.id: r for r in graph.cases(corpora[0]).collect()}
    assert set(got) == {"BGE 100 I 1", "BGE 101 I 5", "BGE 102 II 7"}
    assert got["BGE 100 I 1"].text == "Siehe BGE 101 I 5 E. 2; BGE 101 I 5, Art. 1 OR.\n\nZweiter Teil BGE 999 I 9."
    assert (got["BGE 102 II 7"].volume, got["BGE 102 II 7"].section, got["BGE 102 II 7"].page) == (102, "II", 7)
    assert graph.cases(corpora[0], max_rows=2).count() == 2


def test_max_rows_over_partitions(spark):
    from paragraf import sources

    rows = sources.ordinal(spark.range(1000).repartition(8).select(F.concat(F.lit("BGE 1 I "), F.col("id").cast("string")).alias("citation"), F.lit("t").alias("text"), F.lit("").alias("title")))
    assert rows.agg(F.max("ord")).first()[0] > 1000  # not dense
    assert graph.cases(rows, max_rows=500).count() == graph.laws(rows, max_rows=500).count() == 500 and graph.cases(rows, max_rows=0).count() == 1000
    least = {r.citation for r in rows.orderBy("ord").limit(500).collect()}
    assert {r.id for r in graph.cases(rows, max_rows=500).collect()} == least


def test_clear_and_catalogue(corpora):
    built = graph.build(*corpora)
    left = graph.clear(built, "Law")
    assert rows(left.edges.groupBy("rel_type").count(), "rel_type", "count") == [("CITES", 2)] and left.nodes.where("label = 'Law'").isEmpty()
    assert graph.clear(built).nodes.isEmpty() and graph.clear(built).edges.isEmpty()
    assert ("edge", "weight", "double") in rows(graph.schema_info(built.nodes, built.edges), "kind", "name", "type")


def test_laws(corpora):
    got = {r.id: (r.text, r.title, r.sr_number, r.book) for r in graph.laws(corpora[1]).collect()}
    assert got == {"Art. 1 220": ("Art. 1 220 und Art. 2 ZGB; BGE 100 I 1\n\nmehr", "T1", "220", None), "Art. 2 ZGB": ("", "", None, None)}


def test_weights(corpora):
    got = rows(graph.case_edges(graph.cases(corpora[0])), "src", "dst", "tf", "weight")
    assert got == [("BGE 100 I 1", "BGE 101 I 5", 2, round((1 + math.log(2)) * math.log(3 / 2), 6)), ("BGE 102 II 7", "BGE 101 I 5", 1, round(math.log(3 / 2), 6))]
    cited, edges = graph.law_edges(graph.cases(corpora[0]))
    assert rows(cited, "id", "book") == [("Art. 1 OR", "OR"), ("Art. 2 ZGB", "ZGB")]
    assert rows(edges, "src", "dst", "weight") == [("BGE 100 I 1", "Art. 1 OR", round(math.log(3 / 2), 6)), ("BGE 102 II 7", "Art. 1 OR", round(math.log(3 / 2), 6)), ("BGE 102 II 7", "Art. 2 ZGB", round(math.log(3), 6))]


def test_build_save_export(spark, corpora, tmp_path):
    built = graph.build(*corpora, text_limit=30)
    graph.assert_keys(built.nodes)
    assert rows(built.edges.groupBy("rel_type").count(), "rel_type", "count") == [("CITES", 2), ("CITES_LAW", 3), ("LAW_CITES_CASE", 1), ("LAW_CITES_LAW", 1)]
    assert all(len(r.text or "") <= 31 for r in built.nodes.collect())
    built.save(str(tmp_path / "g"))
    again = graph.Graph.load(spark, str(tmp_path / "g"))
    assert again.edges.count() == 7 and again.nodes.count() == built.nodes.count()
    assert graph.export_edges(graph.build(corpora[0]), str(tmp_path / "csv")) == ["case_edges"]
    assert graph.exists(again.nodes, "BGE 101 I 5") and not graph.exists(again.nodes, "x")
    with pytest.raises(ValueError):
        graph.assert_keys(built.nodes.union(built.nodes))


def test_neighbours(spark):
    edges = spark.createDataFrame([("A", "B", 1.0), ("B", "C", 5.0), ("A", "C", 0.5), ("D", "A", None)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("A",), ("zz",)], "seed string")
    got = rows(graph.neighbours(seeds, edges), "case_id", "distance", "best", "score", "rank")
    assert got == [("B", 1, 1.0, 1.0, 2), ("C", 1, 5.0, 5.0, 1), ("D", 1, 1.0, 1.0, 3)]
    assert rows(graph.neighbours(seeds, edges, 10, 1), "case_id", "best") == [("B", 1.0), ("C", 0.5), ("D", 1.0)]
    with pytest.raises(ValueError):
        graph.neighbours(seeds, edges, 10, 3)


def test_cocited(spark):
    edges = spark.createDataFrame([("X", "A"), ("X", "B"), ("Y", "A"), ("Y", "B"), ("Y", "C")], "src string, dst string")
    assert rows(graph.cocited(spark.createDataFrame([("A",)], "seed string"), edges), "rank", "id", "citing") == [(1, "B", 2), (2, "C", 1)]
    assert rows(graph.most_cited(edges, 2), "id", "in_degree") == [("A", 2), ("B", 2)]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, p string, q string")
    new = spark.createDataFrame([(2, None, "z"), (3, "c", None)], "id int, p string, q string")
    assert rows(graph.upsert_coalesce(old, new), "id", "p", "q") == [(1, "a", "x"), (2, "b", "z"), (3, "c", None)]
    assert rows(graph.upsert(old, new), "id", "p", "q") == [(1, "a", "x"), (2, None, "z"), (3, "c", None)]
    kind = "src string, dst string, src_label string, dst_label string, rel_type string, weight double, tf int"
    edge = lambda s, d, w: (s, d, "Case", "Case", "CITES", w, 1)
    nodes = spark.createDataFrame([("A", "Case"), ("B", "Case"), ("L", "Law")], "id string, label string")
    edges, matched = graph.upsert_edges(spark.createDataFrame([edge("A", "B", 1.0), edge("B", "A", 2.0)], kind), spark.createDataFrame([edge("A", "B", 3.0), edge("A", "L", 9.0), edge("A", "B", 4.0)], kind), nodes)
    assert matched == 2 and rows(edges, "src", "dst", "weight") == [("A", "B", 4.0), ("B", "A", 2.0)]


def test_explorer(spark):
    kind = "src string, dst string, src_label string, dst_label string, rel_type string, weight double, tf int"
    edges = spark.createDataFrame([("A", "B", "Case", "Case", "CITES", 1.5, 1), ("C", "A", "Law", "Case", "LAW_CITES_CASE", None, None)], kind)
    nodes = spark.createDataFrame([("A", "Case", "ta"), ("B", "Case", "tb"), ("C", "Law", None), ("A", "Law", "x")], "id string, label string, text string")
    seeds = spark.createDataFrame([("A",), (" ",)], "seed string")
    found = graph.explore(seeds, edges, nodes)
    assert rows(found, "direction", "id", "weight", "tf", "text") == [("in", "C", 0.0, 0, ""), ("out", "B", 1.5, 1, "tb")]
    text = {r.seed: r.output for r in graph.explored_text(seeds, found).collect()}
    assert "[1.50] B [CITES]\ntb" in text["A"] and text[" "].startswith("Error")


def test_graph_search(spark):
    edges = spark.createDataFrame([("BGE 1 I 1", "BGE 2 I 2", 1.0), ("BGE 3 I 3", "BGE 2 I 2", 2.0)], "src string, dst string, weight double")
    docs = spark.createDataFrame([(0, "BGE 2 I 2 E. 1", "old"), (1, "BGE 2 I 2 E. 2", "new")], "ord long, citation string, text string")
    queries = spark.createDataFrame([(1, "siehe BGE 1 I 1 und BGE 3 I 3"), (2, "frei"), (3, None)], "query_id int, query string")
    got = rows(graph.search(queries, edges, docs), "query_id", "rank", "case_id", "distance")
    assert got == [(1, 1, "BGE 2 I 2", 1)]
    assert graph.search(queries, edges, docs).first().doc.text == "new"
    both = rows(graph.search(queries, edges, docs, multi=True), "query_id", "case_id", "score")
    assert both == [(1, "BGE 2 I 2", 1.0)]
    fallback = spark.createDataFrame([(2, 1, "BGE 3 I 3 E. 1"), (2, 2, "Art. 1 OR"), (1, 1, "BGE 9 I 9")], "query_id int, rank int, citation string")
    assert rows(graph.search(queries, edges, docs, fallback=fallback), "query_id", "case_id", "score") == [(1, "BGE 2 I 2", 1.0), (2, "BGE 2 I 2", 2.0)]
