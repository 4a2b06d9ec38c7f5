"""Queries that write files and read them back, and that build the graph from texts.

Files go to the shared folder, each run to a folder of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import sources as S
from ..functions import abbreviations as A
from ..functions import citations as C
from ..functions import text as T
from ..operators import bm25, corpus, dense
from ..operators import graph as G
from ..session import shared_folder
from .retrieval import _ITEMS, _index, _queries, _scored, ints, rounded, table


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _laws(spark, sf_dir):
    """Parts as provisions, with quotes, commas, line breaks and empty fields in their texts."""
    text = F.when(F.col("p_partkey") % 5 == 0, F.lit(None)).otherwise(F.concat("p_name", F.lit(', "so"\n'), "p_type"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("Art. "), F.col("p_partkey").cast("string")).alias("citation"), text.alias("text"), F.col("p_brand").alias("title"))


def q_csv_corpus(spark, sf_dir):
    path = _folder(spark)
    S.write_csv(_laws(spark, sf_dir), f"{path}/laws")
    found = S.first_path(spark, f"{path}/none", f"{path}/laws")
    return S.read_corpus_csv(spark, found).select("citation", F.md5("text").alias("digest"), "title")


def q_jsonl_corpus(spark, sf_dir):
    path = _folder(spark)
    S.write_jsonl(_laws(spark, sf_dir), path)
    return S.read_jsonl(spark, path).select("citation", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "title")


def q_submission_file(spark, sf_dir):
    """Lists of an order's parts, written as a submission, read and parsed."""
    path = _folder(spark)
    name = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    lists = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("q"), F.col("l_orderkey").cast("string")).alias("query_id")).agg(F.sort_array(F.collect_set(F.when(F.col("l_returnflag") == "R", name))).alias("citations"))
    S.write_submission(lists, path)
    items = T.split_list("predicted_citations")
    return S.read_submission(spark, path).select("query_id", F.size(items).alias("n"), F.array_join(items, "|").alias("items"))


def q_gold_file(spark, sf_dir):
    path = _folder(spark)
    S.write_csv(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("query_id"), F.concat(F.lit('"Frage", '), "o_orderpriority").alias("query"), F.when(F.col("o_orderkey") % 3 == 0, None).otherwise(F.col("o_orderstatus")).alias("gold_citations")), path)
    return S.read_gold(spark, path).select("query_id", "query", "gold_citations")


def q_log_file(spark, sf_dir):
    """A run's log as CSV, read back and summed up."""
    path = _folder(spark)
    log = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), (F.col("o_orderkey") % 7).alias("iterations"), (F.col("o_orderkey") % 11).cast("double").alias("seconds"), F.slice(F.array(F.lit("a"), F.lit('b "c"'), F.lit("d")), F.lit(1), (F.col("o_orderkey") % 4).cast("int")).alias("citations"))
    S.write_log(log, path)
    back = S.read_csv(spark, path, "query_id long, iterations long, seconds double, citations string")
    return rounded(corpus.log_summary(back.withColumn("citations", F.from_json("citations", "array<string>"))), "seconds_mean", "citations_mean", "iterations_mean")


def q_abbreviations_file(spark, sf_dir):
    """Nations as a JSON dictionary, read back: German forms, longest first."""
    path = _folder(spark)
    de = F.when(F.col("n_nationkey") % 6 == 0, F.concat(F.lit("1"), "n_name")).when(F.col("n_nationkey") % 7 == 0, None).otherwise(F.col("n_name"))
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").select(F.col("n_nationkey").cast("string").alias("id"), F.struct(de.alias("de"), F.lower("n_name").alias("fr")).alias("abbrev"))
    rows.coalesce(1).agg(F.to_json(F.collect_list(F.struct("id", "abbrev"))).alias("value")).write.text(path)
    forms = A.german(S.read_abbreviations(spark, path))
    return spark.createDataFrame(list(enumerate(forms)), "place int, form string")


def q_index_saved(spark, sf_dir):
    """BM25 with an index that is built, saved and loaded."""
    path = _folder(spark)
    bm25.get_or_build(spark, path, table(spark, sf_dir, "documents"))
    again = bm25.get_or_build(spark, path, table(spark, sf_dir, "documents").limit(0))
    return rounded(bm25.search(_queries(spark, sf_dir), again, 5), "score")


def q_vectors_saved(spark, sf_dir):
    path = _folder(spark)
    vectors = table(spark, sf_dir, "embeddings")
    dense.save(vectors.select("vec_id", dense.normalize("embedding").alias("vec")), path)
    kept = dense.load(spark, path)
    size = dense.dimension(kept)
    return rounded(kept.select("vec_id", F.lit(size).alias("size"), F.element_at("vec", 1).alias("first")), "first")


def _considerations(spark, sf_dir):
    """Orders as considerations of 400 decisions: each cites another one, one that is not known, itself, and a law twice."""
    k = F.col("o_orderkey")
    name = lambda n: F.concat(F.lit("BGE "), (n % 90 + 1).cast("string"), F.lit(" II "), n.cast("string"))
    other, law = F.col("o_custkey") % 400, (F.col("o_custkey") % 30 + 1).cast("string")
    text = F.concat(F.lit("Vgl. "), name(other), F.lit(" E. 2; "), name(k % 100 + 900), F.lit(". So "), name(k % 400), F.lit(" E. 1. Art. "), law, F.lit(" OR und Art. "), law, F.lit("  OR. "))
    return table(spark, sf_dir, "orders").select(k.alias("ord"), F.when(k % 11 == 0, F.lit("4A_1/2020 E. 1")).otherwise(F.concat(name(k % 400), F.lit(" E. "), k.cast("string"))).alias("citation"), text.alias("text"))


def _provisions(spark, sf_dir):
    """Parts as provisions of 40 articles, which cite a decision and an article."""
    k = F.col("p_partkey")
    text = F.when(k % 9 == 0, F.lit(" ")).otherwise(F.concat(F.lit("Siehe BGE "), ((k % 500) % 90 + 1).cast("string"), F.lit(" II "), (k % 500).cast("string"), F.lit("; Art. "), (k % 50 + 1).cast("string"), F.lit(" OR; x ")))
    return table(spark, sf_dir, "part").select(k.alias("ord"), F.concat(F.lit("Art. "), (k % 40 + 1).cast("string"), F.lit(" OR")).alias("citation"), text.alias("text"), F.col("p_brand").alias("title"))


def _graph(spark, sf_dir):
    """Built from texts, saved, and loaded."""
    path = _folder(spark)
    G.build(_considerations(spark, sf_dir), _provisions(spark, sf_dir), text_limit=200).save(path)
    return G.Graph.load(spark, path)


def q_graph_edges(spark, sf_dir):
    return rounded(_graph(spark, sf_dir).edges.select("src", "dst", "rel_type", "weight", "tf"), "weight")


def q_graph_nodes(spark, sf_dir):
    graph = _graph(spark, sf_dir)
    G.assert_keys(graph.nodes)
    return graph.nodes.select("id", "label", "volume", "section", "page", "title", "book", F.length("text").alias("n"), F.md5("text").alias("digest"))


def q_graph_export(spark, sf_dir):
    """Edges as CSV files, one for each kind, read back."""
    path = _folder(spark)
    found = None
    for name in G.export_edges(_graph(spark, sf_dir), path):
        rows = S.read_csv(spark, f"{path}/{name}", S.EDGES).select(F.lit(name).alias("file"), "source", "target", "weight", "tf")
        found = rows if found is None else found.unionByName(rows)
    return rounded(found, "weight")


def q_max_rows(spark, sf_dir):
    """Decisions of the first 3,000 considerations in file order."""
    return G.cases(_considerations(spark, sf_dir), max_rows=3000).select("id", F.length("text").alias("n"))


def q_graph_catalogue(spark, sf_dir):
    graph = G.Graph(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"))
    return G.schema_info(graph.nodes, graph.edges)


QUERIES = {f.__name__: f for f in (q_csv_corpus, q_jsonl_corpus, q_submission_file, q_gold_file, q_log_file, q_abbreviations_file, q_index_saved, q_vectors_saved, q_graph_edges, q_graph_nodes, q_graph_export, q_max_rows, q_graph_catalogue)}

_LAWS = "laws AS (SELECT 'Art. ' || p_partkey AS citation, CASE WHEN p_partkey % 5 <> 0 THEN p_name || ', \"so\"' || chr(10) || p_type END AS text, p_brand AS title FROM part)"
_NAME = lambda n: f"'BGE ' || ({n} % 90 + 1) || ' II ' || ({n})"
_FROM_TEXTS = f"""
cons AS (SELECT o_orderkey AS k, o_orderkey % 11 <> 0 AS known, o_orderkey % 400 AS c, o_custkey % 400 AS other, o_orderkey % 100 + 900 AS unknown, o_custkey % 30 + 1 AS law FROM orders),
prov AS (SELECT p_partkey AS k, p_partkey % 40 + 1 AS law, p_partkey % 9 <> 0 AS says, p_partkey % 500 AS c, p_partkey % 50 + 1 AS other, p_brand AS title FROM part),
found_cases AS (SELECT DISTINCT c FROM cons WHERE known),
found_laws AS (SELECT DISTINCT law FROM prov UNION SELECT law FROM cons WHERE known),
counts AS (
  SELECT 'CITES' AS rel_type, {_NAME('c')} AS src, {_NAME('other')} AS dst, count(*) AS tf FROM cons WHERE known AND other <> c AND other IN (SELECT c FROM found_cases) GROUP BY ALL
  UNION ALL SELECT 'CITES_LAW', {_NAME('c')}, 'Art. ' || law || ' OR', 2 * count(*) FROM cons WHERE known GROUP BY ALL
  UNION ALL SELECT 'LAW_CITES_CASE', 'Art. ' || law || ' OR', {_NAME('c')}, count(*) FROM prov WHERE says AND c IN (SELECT c FROM found_cases) GROUP BY ALL
  UNION ALL SELECT 'LAW_CITES_LAW', 'Art. ' || law || ' OR', 'Art. ' || other || ' OR', count(*) FROM prov WHERE says AND other <> law AND other IN (SELECT law FROM found_laws) GROUP BY ALL),
totals AS (SELECT rel_type, dst, count(*) AS df, CASE WHEN rel_type LIKE 'LAW%' THEN (SELECT count(DISTINCT law) FROM prov) ELSE (SELECT count(*) FROM found_cases) END AS total FROM counts GROUP BY ALL),
edges AS (SELECT src, dst, rel_type, round(round((1 + ln(tf)) * ln(total::DOUBLE / df), 6), 6) AS weight, CAST(tf AS BIGINT) AS tf FROM counts JOIN totals USING (rel_type, dst))"""
_TEXT = f"'Vgl. ' || {_NAME('other')} || ' E. 2; ' || {_NAME('unknown')} || '. So ' || {_NAME('c')} || ' E. 1. Art. ' || law || ' OR und Art. ' || law || '  OR.'"
_CUT = "CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…' ELSE text END"

SQL = {
    "q_csv_corpus": f"WITH {_LAWS} SELECT citation, md5(coalesce(text, '')) AS digest, title FROM laws",
    "q_jsonl_corpus": f"WITH {_LAWS} SELECT citation, md5(coalesce(text, '')) AS digest, title FROM laws",
    "q_submission_file": "SELECT 'q' || l_orderkey AS query_id, CAST(count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS INTEGER) AS n, coalesce(string_agg(DISTINCT CASE WHEN l_returnflag = 'R' THEN 'P' || l_partkey END, '|' ORDER BY CASE WHEN l_returnflag = 'R' THEN 'P' || l_partkey END), '') AS items FROM lineitem GROUP BY l_orderkey",
    "q_gold_file": "SELECT CAST(o_orderkey AS VARCHAR) AS query_id, '\"Frage\", ' || o_orderpriority AS query, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS gold_citations FROM orders",
    "q_log_file": "SELECT count(*) AS queries, round(avg(o_orderkey % 11), 6) AS seconds_mean, CAST(sum(o_orderkey % 11) AS DOUBLE) AS seconds_total, round(avg(least(o_orderkey % 4, 3)), 6) AS citations_mean, round(avg(o_orderkey % 7), 6) AS iterations_mean FROM orders",
    "q_abbreviations_file": "SELECT CAST(row_number() OVER (ORDER BY length(n_name) DESC, n_nationkey) - 1 AS INTEGER) AS place, n_name AS form FROM nation WHERE n_nationkey % 6 <> 0 AND n_nationkey % 7 <> 0",
    "q_index_saved": ints(_scored(_ITEMS) + "SELECT query_id, rank, doc_id, round(score, 6) AS score FROM hits WHERE rank <= 5", "rank"),
    "q_vectors_saved": "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS size, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS first FROM embeddings",
    "q_graph_edges": f"WITH {_FROM_TEXTS} SELECT src, dst, rel_type, weight, tf FROM edges",
    "q_graph_nodes": f"""WITH {_FROM_TEXTS},
case_texts AS (SELECT c, string_agg({_TEXT}, chr(10) || chr(10) ORDER BY k) AS text FROM cons WHERE known GROUP BY c),
law_texts AS (SELECT law, string_agg(CASE WHEN says THEN 'Siehe ' || {_NAME('c')} || '; Art. ' || other || ' OR; x' ELSE '' END, chr(10) || chr(10) ORDER BY k) AS text, arg_min(title, k) AS title FROM prov GROUP BY law),
every AS (SELECT {_NAME('c')} AS id, 'Case' AS label, CAST(c % 90 + 1 AS INTEGER) AS volume, 'II' AS section, CAST(c AS INTEGER) AS page, NULL AS title, NULL AS book, {_CUT} AS text FROM case_texts
  UNION ALL SELECT 'Art. ' || law || ' OR', 'Law', NULL, NULL, NULL, title, CASE WHEN law IN (SELECT law FROM cons WHERE known) THEN 'OR' END, {_CUT} FROM found_laws LEFT JOIN law_texts USING (law))
SELECT id, label, volume, section, page, title, book, CAST(length(text) AS INTEGER) AS n, md5(text) AS digest FROM every""",
    "q_graph_export": f"WITH {_FROM_TEXTS} SELECT CASE rel_type WHEN 'CITES' THEN 'case_edges' WHEN 'CITES_LAW' THEN 'case_to_law_edges' WHEN 'LAW_CITES_CASE' THEN 'law_to_case_edges' ELSE 'law_to_law_edges' END AS file, src AS source, dst AS target, weight, tf FROM edges",
    "q_max_rows": f"""WITH {_FROM_TEXTS}, firsts AS (SELECT * FROM cons ORDER BY k LIMIT 3000)
SELECT {_NAME('c')} AS id, CAST(length(string_agg({_TEXT}, chr(10) || chr(10) ORDER BY k)) AS INTEGER) AS n FROM firsts WHERE known GROUP BY c""",
    "q_graph_catalogue": "SELECT CASE table_name WHEN 'nation' THEN 'node' ELSE 'edge' END AS kind, column_name AS name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' ELSE lower(data_type) END AS type FROM (SELECT 'nation' AS table_name, column_name, column_type AS data_type FROM (DESCRIBE nation) UNION ALL SELECT 'region', column_name, column_type FROM (DESCRIBE region))",
}
