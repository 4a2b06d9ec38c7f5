"""Queries of graph operators: parts cite later parts of their order, suppliers are decisions that cite parts as laws."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..session import stored
from .retrieval import ints, rounded, table

_ID = lambda c, letter: F.concat(F.lit(letter), F.col(c).cast("string"))


def _case_counts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    later = lines.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"))
    pairs = lines.join(later, "l_orderkey").where("l_linenumber < n and l_partkey <> p")
    return pairs.groupBy(F.col("l_partkey").alias("src"), F.col("p").alias("dst")).agg(F.count("*").alias("tf"))


def _named(edges, source):
    """Edges of keys with names of both ends, which are longer: keys are counted and joined."""
    return edges.select(_ID("src", source).alias("src"), _ID("dst", "P").alias("dst"), "weight", "tf")


def _cites(spark, sf_dir):
    return _named(G.weighted(_case_counts(spark, sf_dir), table(spark, sf_dir, "part").count()), "P")


def _cites_law(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.count("*").alias("tf"))
    return _named(G.weighted(counts, table(spark, sf_dir, "supplier").count()), "S")


def _written(spark, sf_dir):
    """Edges of decisions, written once, as traversals read them several times."""
    return stored(_cites(spark, sf_dir))


def _edges(spark, sf_dir):
    more = _cites_law(spark, sf_dir).select("src", F.concat(F.lit("L"), "dst").alias("dst"), "weight", "tf")
    return stored(G.typed(_cites(spark, sf_dir), G.CITES).unionByName(G.typed(more, G.CITES_LAW)))


def _nodes(spark, sf_dir):
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    cases = part.select(_ID("p_partkey", "P").alias("id"), F.lit("Case").alias("label"), F.nullif(F.col("p_size"), F.lit(7)).alias("volume"), F.col("p_name").alias("text"))
    more = supplier.select(_ID("s_suppkey", "S").alias("id"), F.lit("Case").alias("label"), F.lit(None).cast("int").alias("volume"), F.col("s_name").alias("text"))
    laws = part.select(_ID("p_partkey", "LP").alias("id"), F.lit("Law").alias("label"), F.lit(None).cast("int").alias("volume"), F.lit(None).cast("string").alias("text"))
    return cases.unionByName(more).unionByName(laws)


def _seeds(spark, sf_dir, letter="P"):
    """Every part whose key is divisible by 20."""
    return table(spark, sf_dir, "part").where("p_partkey % 20 = 0").select(_ID("p_partkey", letter).alias("seed"))


def q_case_edges(spark, sf_dir):
    return _cites(spark, sf_dir)


def q_law_edges(spark, sf_dir):
    return _cites_law(spark, sf_dir)


def q_neighbors(spark, sf_dir):
    return G.neighbours(_seeds(spark, sf_dir), _written(spark, sf_dir), 20).select("seed", "rank", "case_id", "distance", F.round("score", 6).alias("score"))


def q_neighbors_one_hop(spark, sf_dir):
    return G.neighbours(_seeds(spark, sf_dir), _written(spark, sf_dir), 20, 1).select("seed", "rank", "case_id", "distance", F.round("score", 6).alias("score"))


def q_citing_cited(spark, sf_dir):
    edges, nodes, seeds = _edges(spark, sf_dir), _nodes(spark, sf_dir), _seeds(spark, sf_dir)
    both = [G.linked(seeds, edges.where(F.col("rel_type") == G.CITES), nodes, d).withColumn("direction", F.lit(d)) for d in ("in", "out")]
    return both[0].unionByName(both[1])


def q_cited_laws(spark, sf_dir):
    seeds = table(spark, sf_dir, "supplier").where("s_suppkey % 20 = 0").select(_ID("s_suppkey", "S").alias("seed"))
    return G.linked(seeds, _edges(spark, sf_dir), _nodes(spark, sf_dir), "out", "Law")


def q_top_citing_law(spark, sf_dir):
    return G.top_citing_law(_seeds(spark, sf_dir, letter="LP"), _edges(spark, sf_dir), _nodes(spark, sf_dir))


def q_top_in_out(spark, sf_dir):
    seeds = _seeds(spark, sf_dir).unionByName(_seeds(spark, sf_dir, letter="LP"))
    return G.explore(seeds, _edges(spark, sf_dir), _nodes(spark, sf_dir))


def q_explored_text(spark, sf_dir):
    seeds = _seeds(spark, sf_dir)
    return G.explored_text(seeds, G.explore(seeds, _edges(spark, sf_dir), _nodes(spark, sf_dir), 3), 3).select("seed", F.length("output").alias("n"), F.md5("output").alias("digest"))


def q_cocitation(spark, sf_dir):
    return G.cocited(_seeds(spark, sf_dir), _written(spark, sf_dir), 20)


def q_graph_stats(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    top = G.most_cited(edges).select(F.lit("in_degree").alias("kind"), F.col("id").alias("name"), F.col("in_degree").alias("n"))
    return G.stats(_nodes(spark, sf_dir), edges).unionByName(top)


def q_upsert_coalesce(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_size")
    old = part.where("id % 3 <> 0")
    new = part.where("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, F.concat("p_name", F.lit(" new"))).alias("p_name"), (F.col("p_size") + 100).alias("p_size"))
    return G.upsert_coalesce(old, new)


def q_upsert(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_size")
    return G.upsert(part.where("id % 3 <> 0"), part.where("id % 2 = 0").select("id", F.lit(None).cast("string").alias("p_name"), (F.col("p_size") + 100).alias("p_size")))


def q_upsert_edges(spark, sf_dir):
    """Edges whose ends exist among half of the parts replace those of the other table."""
    old = stored(G.typed(_cites(spark, sf_dir), G.CITES))
    new = old.select("src", "dst", "src_label", "dst_label", "rel_type", (F.col("weight") + 1).alias("weight"), (F.col("tf") + 1).alias("tf"))
    nodes = _nodes(spark, sf_dir).where("volume % 2 = 0")
    return rounded(G.upsert_edges(old, new, nodes)[0].select("src", "dst", "rel_type", "weight", "tf"), "weight")


def q_group_case_text(spark, sf_dir):
    grouped = G.ordered_concat(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return grouped.select("conv_id", F.md5("text").alias("digest"), F.length("text").alias("n"))


def q_graph_search(spark, sf_dir):
    """Queries that name a part as a decision; documents are parts."""
    number = lambda c: F.concat(F.lit("BGE "), (c.cast("long") % 90 + 1).cast("string"), F.lit(" II "), c)
    edges = _written(spark, sf_dir).select(number(F.substring("src", 2, 20)).alias("src"), number(F.substring("dst", 2, 20)).alias("dst"), "weight", "tf")
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), number(F.col("p_partkey").cast("string")).alias("citation"), F.col("p_name").alias("text"))
    queries = docs.where("ord % 20 = 0").select(F.col("ord").alias("query_id"), F.concat(F.lit("siehe "), "citation", F.lit(" E. 3")).alias("query"))
    found = G.search(queries, edges, docs, 10)
    return found.select("query_id", "rank", "case_id", "distance", F.round("score", 6).alias("score"), F.col("doc.text").alias("text"))


QUERIES = {f.__name__: f for f in (q_case_edges, q_law_edges, q_neighbors, q_neighbors_one_hop, q_citing_cited, q_cited_laws, q_top_citing_law, q_top_in_out, q_explored_text, q_cocitation, q_graph_stats, q_upsert_coalesce, q_upsert, q_upsert_edges, q_group_case_text, q_graph_search)}

_CITES = """
pairs AS (SELECT a.l_partkey AS s, b.l_partkey AS d, count(*) AS tf FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber WHERE a.l_partkey <> b.l_partkey GROUP BY ALL),
pair_df AS (SELECT d, count(*) AS df FROM pairs GROUP BY d),
cites AS MATERIALIZED (SELECT 'P' || s AS src, 'P' || d AS dst, round((1 + ln(tf)) * ln((SELECT count(*) FROM part)::DOUBLE / df), 6) AS weight, tf FROM pairs JOIN pair_df USING (d))"""
_LAW = """
lawpairs AS (SELECT l_suppkey AS s, l_partkey AS d, count(*) AS tf FROM lineitem GROUP BY ALL),
law_df AS (SELECT d, count(*) AS df FROM lawpairs GROUP BY d),
cites_law AS MATERIALIZED (SELECT 'S' || s AS src, 'P' || d AS dst, round((1 + ln(tf)) * ln((SELECT count(*) FROM supplier)::DOUBLE / df), 6) AS weight, tf FROM lawpairs JOIN law_df USING (d))"""
_GRAPH = f"""{_CITES}, {_LAW},
edges AS MATERIALIZED (SELECT src, dst, 'Case' AS src_label, 'Case' AS dst_label, 'CITES' AS rel_type, weight, tf FROM cites
  UNION ALL SELECT src, 'L' || dst, 'Case', 'Law', 'CITES_LAW', weight, tf FROM cites_law),
nodes AS (SELECT 'P' || p_partkey AS id, 'Case' AS label, nullif(p_size, 7) AS volume, p_name AS text FROM part
  UNION ALL SELECT 'S' || s_suppkey, 'Case', NULL, s_name FROM supplier UNION ALL SELECT 'LP' || p_partkey, 'Law', NULL, NULL FROM part)"""
_SEEDS = "seeds AS (SELECT 'P' || p_partkey AS seed FROM part WHERE p_partkey % 20 = 0)"


def _near(hops: int) -> str:
    two = """
  UNION ALL SELECT seed, b.dst, a.weight * b.weight, 2 FROM seeds JOIN cites a ON a.src = seed JOIN cites b ON b.src = a.dst
  UNION ALL SELECT seed, b.src, a.weight * b.weight, 2 FROM seeds JOIN cites a ON a.dst = seed JOIN cites b ON b.dst = a.src"""
    return f"""WITH {_CITES}, {_SEEDS},
ways AS (SELECT seed, dst AS case_id, weight AS w, 1 AS d FROM seeds JOIN cites ON src = seed
  UNION ALL SELECT seed, src, weight, 1 FROM seeds JOIN cites ON dst = seed{two if hops == 2 else ''}),
best AS (SELECT seed, case_id, min(d) AS distance, max(w) AS best FROM ways WHERE case_id <> seed GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY distance, best DESC, case_id) AS rank FROM best)
SELECT seed, rank, case_id, distance, round(best / distance, 6) AS score FROM ranked WHERE rank <= 20"""


_EXPLORE = """
found AS (
  SELECT seed, src AS id, src_label AS label, rel_type AS type, weight, tf, 'in' AS direction FROM seeds JOIN edges ON dst = seed
  UNION ALL SELECT seed, dst, dst_label, rel_type, weight, tf, 'out' FROM seeds JOIN edges ON src = seed),
top AS (SELECT *, row_number() OVER (PARTITION BY seed, direction ORDER BY weight DESC, id, type) AS rank FROM found),
shown AS (SELECT seed, rank, t.id, type, weight, tf, coalesce(text, '') AS text, direction FROM top t LEFT JOIN nodes n ON n.id = t.id AND n.label = t.label WHERE rank <= {k})"""

SQL = {
    "q_case_edges": f"WITH {_CITES} SELECT * FROM cites",
    "q_law_edges": f"WITH {_LAW} SELECT * FROM cites_law",
    "q_neighbors": ints(_near(2), "rank", "distance"),
    "q_neighbors_one_hop": ints(_near(1), "rank", "distance"),
    "q_citing_cited": ints(
        f"""WITH {_GRAPH}, {_SEEDS},
found AS (SELECT DISTINCT seed, src AS id, 'in' AS direction FROM seeds JOIN cites ON dst = seed UNION ALL SELECT DISTINCT seed, dst, 'out' FROM seeds JOIN cites ON src = seed),
ranked AS (SELECT seed, f.id, direction, row_number() OVER (PARTITION BY seed, direction ORDER BY volume DESC NULLS FIRST, f.id) AS rank FROM found f JOIN nodes n ON n.id = f.id AND label = 'Case')
SELECT seed, rank, id, direction FROM ranked WHERE rank <= 100""",
        "rank",
    ),
    "q_cited_laws": ints(
        f"""WITH {_GRAPH},
found AS (SELECT DISTINCT src AS seed, dst AS id FROM edges WHERE rel_type = 'CITES_LAW' AND CAST(substr(src, 2) AS BIGINT) % 20 = 0),
ranked AS (SELECT seed, id, row_number() OVER (PARTITION BY seed ORDER BY id) AS rank FROM found)
SELECT seed, rank, id FROM ranked WHERE rank <= 100""",
        "rank",
    ),
    "q_top_citing_law": ints(
        f"""WITH {_GRAPH},
seeds AS (SELECT 'LP' || p_partkey AS seed FROM part WHERE p_partkey % 20 = 0),
ranked AS (SELECT seed, src, weight, row_number() OVER (PARTITION BY seed ORDER BY weight DESC, src) AS rank FROM seeds JOIN edges ON dst = seed AND rel_type = 'CITES_LAW')
SELECT seed, rank, src AS id, weight, text FROM ranked LEFT JOIN nodes n ON n.id = src AND label = 'Case' WHERE rank <= 10""",
        "rank",
    ),
    "q_top_in_out": ints(
        f"""WITH {_GRAPH},
seeds AS (SELECT 'P' || p_partkey AS seed FROM part WHERE p_partkey % 20 = 0 UNION ALL SELECT 'LP' || p_partkey FROM part WHERE p_partkey % 20 = 0), {_EXPLORE.format(k=5)}
SELECT * FROM shown""",
        "rank",
    ),
    "q_explored_text": f"""WITH {_GRAPH}, {_SEEDS}, {_EXPLORE.format(k=3)},
lines AS (SELECT seed, direction, string_agg(printf('[%.2f] %s [%s]', weight, id, type) || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS l FROM shown GROUP BY ALL),
made AS (SELECT s.seed, '=== Citation Explorer: ' || s.seed || ' ===' || chr(10) || chr(10) || chr(10) || '--- Cited BY (top 3) ---' || chr(10) || chr(10)
  || coalesce(a.l, '  (no inbound citations found)') || chr(10) || chr(10) || chr(10) || '--- CITES (top 3) ---' || chr(10) || chr(10) || coalesce(b.l, '  (no outbound citations found)') AS o
  FROM seeds s LEFT JOIN lines a ON a.seed = s.seed AND a.direction = 'in' LEFT JOIN lines b ON b.seed = s.seed AND b.direction = 'out')
SELECT seed, CAST(length(o) AS INTEGER) AS n, md5(o) AS digest FROM made""",
    "q_cocitation": ints(
        f"""WITH {_CITES}, {_SEEDS},
both_cited AS (SELECT seed, b.dst AS id, count(DISTINCT a.src) AS citing FROM seeds JOIN cites a ON a.dst = seed JOIN cites b ON b.src = a.src WHERE b.dst <> seed GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY citing DESC, id) AS rank FROM both_cited)
SELECT seed, rank, id, citing FROM ranked WHERE rank <= 20""",
        "rank",
    ),
    "q_graph_stats": f"""WITH {_GRAPH},
top AS (SELECT dst, count(*) AS n FROM cites GROUP BY dst ORDER BY n DESC, dst LIMIT 10)
SELECT 'node' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY label
UNION ALL SELECT 'edge', rel_type, count(*) FROM edges GROUP BY rel_type UNION ALL SELECT 'in_degree', dst, n FROM top""",
    "q_upsert_coalesce": """
WITH old AS (SELECT p_partkey AS id, p_name, p_size FROM part WHERE p_partkey % 3 <> 0),
new AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN p_name || ' new' END AS p_name, p_size + 100 AS p_size FROM part WHERE p_partkey % 2 = 0)
SELECT id, coalesce(new.p_name, old.p_name) AS p_name, coalesce(new.p_size, old.p_size) AS p_size FROM old FULL JOIN new USING (id)
""",
    "q_upsert": """
SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_name END AS p_name, CASE WHEN p_partkey % 2 = 0 THEN p_size + 100 ELSE p_size END AS p_size
FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0
""",
    "q_upsert_edges": f"""WITH {_GRAPH},
old AS (SELECT * FROM edges WHERE rel_type = 'CITES'),
known AS (SELECT id FROM nodes WHERE volume % 2 = 0),
made AS (SELECT src, dst, rel_type, CASE WHEN hit THEN weight + 1 ELSE weight END AS weight, CASE WHEN hit THEN tf + 1 ELSE tf END AS tf FROM (SELECT *, src IN (SELECT id FROM known) AND dst IN (SELECT id FROM known) AS hit FROM old))
SELECT src, dst, rel_type, round(weight, 6) AS weight, tf FROM made""",
    "q_group_case_text": "SELECT conv_id, md5(t) AS digest, CAST(length(t) AS INTEGER) AS n FROM (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, text) AS t FROM conversations GROUP BY conv_id)",
    "q_graph_search": ints(
        "WITH near AS ("
        + _near(2).replace("'P' || s ", "'BGE ' || (s % 90 + 1) || ' II ' || s ").replace("'P' || d ", "'BGE ' || (d % 90 + 1) || ' II ' || d ")
        .replace("'P' || p_partkey AS seed", "'BGE ' || (p_partkey % 90 + 1) || ' II ' || p_partkey AS seed")
        .replace("WHERE rank <= 20", "WHERE rank <= 10").replace("round(best / distance, 6) AS score", "best / distance AS score")
        + """),
again AS (SELECT *, CAST(regexp_extract(seed, '[0-9]+$') AS BIGINT) AS query_id, CAST(regexp_extract(case_id, '[0-9]+$') AS BIGINT) AS p, row_number() OVER (PARTITION BY seed ORDER BY score DESC, rank) AS k FROM near)
SELECT query_id, k AS rank, case_id, distance, round(score, 6) AS score, p_name AS text FROM again JOIN part ON p_partkey = p""",
        "rank",
        "distance",
    ),
}
