"""Queries of injected models, tools and formatted outputs; the models are stubs that SQL can follow."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import text as T
from ..operators import chunk, corpus, dense, fusion, toolcalls
from ..operators import graph as G
from .graph import _CITES, _EXPLORE, _GRAPH, _edges, _near, _nodes, _written
from .retrieval import _ITEMS, _index, _queries, _scored, ints, rounded, table

_NAME = lambda c: F.concat(F.lit("D"), F.lpad(F.col(c).cast("string"), 8, "0"))


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", _NAME("doc_id").alias("citation"), "text")


def _lengths(queries, texts):
    return [(len(t) % 100) / 10 - len(q) % 7 for q, t in zip(queries, texts, strict=True)]


def q_model_rerank(spark, sf_dir):
    """Hits reranked by a model of two texts."""
    hits = _index(spark, sf_dir).search(_queries(spark, sf_dir), 10).join(_docs(spark, sf_dir), "doc_id").join(_queries(spark, sf_dir), "query_id")
    scored = fusion.model_scores(hits, _lengths)
    return rounded(fusion.rerank(scored, F.col("model_score"), 5, with_sigmoid=True).select("query_id", "rank", "doc_id", "rerank_score"), "rerank_score")


def q_combined_tools(spark, sf_dir):
    """Both tools' outputs under their headings; the courts have nothing for even queries."""
    asked, docs = _queries(spark, sf_dir), _docs(spark, sf_dir)
    hits = _index(spark, sf_dir).search(asked, 2)
    laws = fusion.formatted(asked, hits, docs)
    courts = fusion.formatted(asked, hits.where("query_id % 2 = 1"), docs, "courts")
    return fusion.combined(laws, courts).select("query_id", F.md5("output").alias("digest"), F.length("output").alias("n"))


def q_excerpts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.excerpt("text")).alias("digest"))


def q_tool_descriptions(spark, sf_dir):
    rows = table(spark, sf_dir, "region").orderBy("r_regionkey").collect()  # names of tools, a handful
    return spark.createDataFrame([(fusion.tool_descriptions({r.r_name: f" for {r.r_name.lower()} " for r in rows}),)], "output string")


def q_output_list(spark, sf_dir):
    """Citations of bracketed lists in model output, or of all of it."""
    k = F.col("o_orderkey").cast("string")
    listed = F.concat(F.lit("Gern: ['Art. "), k, F.lit(" ZGB (so)', 'BGE 1 I "), k, F.lit("'] und Art. 1 OR"))
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("ohne Liste: Art. "), k, F.lit(" OR"))).when(F.col("o_orderkey") % 3 == 1, F.lit("['nichts']")).otherwise(listed)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(C.output_list(text), "|").alias("citations"))


def _embedder(texts):
    return [[float(len(t)), float(t.count("e")), 1.0] for t in texts]


def q_embedded_chunks(spark, sf_dir):
    """Documents in windows of 64 words, with vectors of a model of lengths."""
    made = dense.build(_docs(spark, sf_dir), _embedder, chunk.word_windows("text", 64, 8))
    size = dense.dimension(made)
    return rounded(made.select("doc_id", "chunk_index", "n_chunks", "citation", F.md5("chunk").alias("digest"), F.lit(size).alias("size"), F.element_at("vec", 2).alias("second")), "second")


def _capital(c):
    """A letter's capital as SQL has it: one character for one."""
    return "ẞ" if c == "ß" else c.upper() if len(c.upper()) == 1 else c


def _summary(text):
    return "".join(map(_capital, text[:10])) + str(len(text))


def q_summaries(spark, sf_dir):
    docs = _docs(spark, sf_dir).where("text is not null")
    cache = docs.where("doc_id % 3 = 0").select("citation", F.lit("known").alias("summary"))
    return corpus.summaries(docs, cache, _summary)


def q_graph_search_fallback(spark, sf_dir):
    """Queries that name two parts, one, or none; these take their first hits' decisions."""
    number = lambda c: F.concat(F.lit("BGE "), (c % 90 + 1).cast("string"), F.lit(" II "), c.cast("string"))
    edges = _written(spark, sf_dir).select(number(F.substring("src", 2, 20).cast("long")).alias("src"), number(F.substring("dst", 2, 20).cast("long")).alias("dst"), "weight", "tf")
    part = table(spark, sf_dir, "part")
    docs = part.select(F.col("p_partkey").alias("ord"), number(F.col("p_partkey")).alias("citation"), F.col("p_name").alias("text"))
    key = F.col("p_partkey")
    queries = part.where("p_partkey % 20 = 0").select(key.alias("query_id"), F.when(key % 3 == 0, F.lit("frei")).when(key % 3 == 1, F.concat(F.lit("zu "), number(key))).otherwise(F.concat(number(key), F.lit(" und "), number(key - 1))).alias("query"))
    fallback = queries.select("query_id", F.explode(F.array(*[F.struct(F.lit(n).alias("rank"), number(F.col("query_id") - 4 + n).alias("citation")) for n in range(1, 5)])).alias("x")).select("query_id", "x.rank", "x.citation")
    found = G.search(queries, edges, docs, 10, 1, fallback, multi=True)
    return found.select("query_id", "rank", "case_id", "distance", F.round("score", 6).alias("score"))


def _caller(prompts):
    return [json.dumps({"text": "Schluss: Art. 1 OR", "calls": []} if "Observation:" in p else {"text": None, "calls": [{"name": "search_laws", "arguments": {"query": p}}]}) for p in prompts]


def _even(prompts):
    return ["ja" if "Art. 1 OR" in p or int(p.split("Bestimmung:\n")[1].split("\n")[0][1:]) % 2 == 0 else "nein" for p in prompts]


def q_tool_agent(spark, sf_dir):
    """One search a query, whose hits the judge takes if their number is even, and a final answer."""
    index = _index(spark, sf_dir)
    tools = {"search_laws": toolcalls.search_tool(index.search, _docs(spark, sf_dir))}
    return toolcalls.run(_queries(spark, sf_dir), _caller, tools, _even)[0]


def _explorer(prompts):
    """Explores the decision that a query names and searches court texts for it, then ends."""
    out = []
    for p in prompts:
        name = p.split("\n")[0]
        calls = [{"name": "explore_citation", "arguments": {"citation_id": name}}, {"name": "search_courts", "arguments": {"query": name}}]
        out.append(json.dumps({"text": "Schluss: Art. 1 OR", "calls": []} if "Observation:" in p else {"text": None, "calls": calls}))
    return out


def _not_odd(prompts):
    names = [p.split("Bestimmung:\n")[1].split("\n")[0] for p in prompts]
    return ["nein" if n.startswith("P") and n[-1] in "13579" else "ja" for n in names]


def q_tool_agent_graph(spark, sf_dir):
    """An agent with the graph's tool and court texts, whose articles are candidates too; the judge refuses decisions of odd numbers."""
    part = table(spark, sf_dir, "part")
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    docs = part.select(key.alias("doc_id"), F.concat(F.lit("P"), key.cast("string")).alias("citation"), F.concat(F.lit("Nach Art. "), size, F.lit(" OR und Art. "), size, F.lit("a Abs. 2 ZGB.")).alias("text"))

    def following(queries, k):
        """The two decisions after the one that is named."""
        hits = queries.select("query_id", F.substring("query", 2, 20).try_cast("long").alias("n"), F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"))
        return hits.select("query_id", "rank", (F.col("n") + F.col("rank")).alias("doc_id"), (50.0 - F.col("rank")).cast("double").alias("score")).where(F.col("rank") <= k)

    tools = {"explore_citation": toolcalls.explore_tool(_edges(spark, sf_dir), _nodes(spark, sf_dir)), "search_courts": toolcalls.search_tool(following, docs, "courts", in_texts=True)}
    queries = part.where("p_partkey % 20 = 0").select(key.alias("query_id"), F.concat(F.lit("P"), key.cast("string")).alias("query"))
    return toolcalls.run(queries, _explorer, tools, _not_odd)[0]


QUERIES = {f.__name__: f for f in (q_model_rerank, q_combined_tools, q_excerpts, q_tool_descriptions, q_output_list, q_embedded_chunks, q_summaries, q_graph_search_fallback, q_tool_agent, q_tool_agent_graph)}

_LINES = """, lines AS (
  SELECT query_id, rank, printf('[%.3f] D%08d', score, d.doc_id) || chr(10) || coalesce(t.text, '') AS line FROM hits h JOIN docs d ON d.doc_id = h.doc_id JOIN documents t ON t.doc_id = h.doc_id WHERE rank <= 2),
joined AS (SELECT query_id, string_agg(line, chr(10) || chr(10) ORDER BY rank) AS lines FROM lines GROUP BY query_id)"""
_BGE = lambda n: f"'BGE ' || (({n}) % 90 + 1) || ' II ' || ({n})"

SQL = {
    "q_model_rerank": ints(
        _scored(_ITEMS)
        + """, both_sides AS (SELECT h.query_id, h.rank, h.doc_id, (length(t.text) % 100) / 10.0::DOUBLE - length(b.text) % 7 AS s FROM hits h JOIN documents t ON t.doc_id = h.doc_id JOIN benchmark b ON b.item_id = h.query_id WHERE h.rank <= 10),
ranked AS (SELECT query_id, doc_id, 1 / (1 + exp(-s)) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY 1 / (1 + exp(-s)) DESC, rank) AS k FROM both_sides)
SELECT query_id, k AS rank, doc_id, round(rerank_score, 6) AS rerank_score FROM ranked WHERE k <= 5""",
        "rank",
    ),
    "q_combined_tools": ints(
        _scored(_ITEMS)
        + _LINES
        + """, made AS (SELECT a.query_id, '=== Federal Laws (SR) ===' || chr(10) || coalesce(lines, printf('No relevant federal laws found for: ''%s''', query)) || chr(10) || chr(10) || '=== Court Decisions ===' || chr(10)
  || CASE WHEN a.query_id % 2 = 1 AND lines IS NOT NULL THEN lines ELSE printf('No relevant court decisions found for: ''%s''', query) END AS o FROM asked a LEFT JOIN joined USING (query_id))
SELECT query_id, md5(o) AS digest, length(o) AS n FROM made""",
        "n",
    ),
    "q_excerpts": "SELECT doc_id, md5(CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END) AS digest FROM documents",
    "q_tool_descriptions": "SELECT string_agg(r_name || ': for ' || lower(r_name), chr(10) || chr(10) ORDER BY r_regionkey) AS output FROM region",
    "q_output_list": "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Art. ' || o_orderkey || ' OR' WHEN 1 THEN '' ELSE 'Art. ' || o_orderkey || ' ZGB|BGE 1 I ' || o_orderkey END AS citations FROM orders",
    "q_embedded_chunks": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, w, CASE WHEN len(w) <= 64 THEN 1 ELSE CAST(ceil((len(w) - 64) / 56.0) AS INTEGER) + 1 END AS n FROM d),
p AS (SELECT doc_id, n, i, coalesce(array_to_string(w[i * 56 + 1 : i * 56 + 64], ' '), '') AS t FROM (SELECT *, unnest(range(n)) AS i FROM c)),
v AS (SELECT *, CASE WHEN t = '' THEN 1.0 ELSE length(t) END::DOUBLE AS a, (length(t) - length(replace(t, 'e', '')))::DOUBLE AS b FROM p)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(n AS INTEGER) AS n_chunks, 'D' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS citation, md5(t) AS digest, 3 AS size, round(b / sqrt(a * a + b * b + 1), 6) AS second FROM v
""",
    "q_summaries": "SELECT 'D' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS citation, CASE WHEN doc_id % 3 = 0 THEN 'known' ELSE upper(substr(text, 1, 10)) || least(length(text), 3000) END AS summary FROM documents WHERE text IS NOT NULL",
    "q_graph_search_fallback": ints(
        f"""WITH {_CITES},
parts AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 20 = 0),
seeds AS (SELECT k AS query_id, k AS s, 0 AS pos FROM parts WHERE k % 3 <> 0 UNION ALL SELECT k, k - 1, 1 FROM parts WHERE k % 3 = 2
  UNION ALL SELECT k, k - 4 + n, n FROM parts, (SELECT unnest([1, 2, 3]) AS n) WHERE k % 3 = 0),
ways AS (SELECT DISTINCT s, CAST(substr(dst, 2) AS BIGINT) AS c, weight AS w FROM seeds JOIN cites ON src = 'P' || s UNION ALL SELECT DISTINCT s, CAST(substr(src, 2) AS BIGINT), weight FROM seeds JOIN cites ON dst = 'P' || s),
best AS (SELECT s, c, max(w) AS w FROM ways WHERE c <> s GROUP BY ALL),
near AS (SELECT s, c, w, row_number() OVER (PARTITION BY s ORDER BY w DESC, {_BGE('c')}) AS near_rank FROM best QUALIFY near_rank <= 10),
met AS (SELECT query_id, c, pos, near_rank, w FROM seeds JOIN near USING (s) WHERE NOT EXISTS (SELECT 1 FROM seeds t WHERE t.query_id = seeds.query_id AND t.s = near.c)),
firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id, c ORDER BY pos, near_rank) AS k FROM met),
ranked AS (SELECT query_id, c, w, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, pos, near_rank) AS rank FROM firsts WHERE k = 1)
SELECT query_id, rank, {_BGE('c')} AS case_id, 1 AS distance, round(w, 6) AS score FROM ranked WHERE rank <= 10""",
        "rank",
        "distance",
    ),
    "q_tool_agent": _scored(_ITEMS)
    + "SELECT query_id, 'D' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS citation FROM hits WHERE rank <= 10 AND doc_id % 2 = 0 AND score >= 0.3 UNION SELECT item_id, 'Art. 1 OR' FROM benchmark",
}
SQL["q_tool_agent_graph"] = f"""WITH {_GRAPH},
seeds AS (SELECT 'P' || p_partkey AS seed FROM part WHERE p_partkey % 20 = 0), {_EXPLORE.format(k=5)},
hits AS (SELECT a.p_partkey AS query_id, b.p_partkey AS k, b.p_size AS z FROM part a JOIN part b ON b.p_partkey IN (a.p_partkey + 1, a.p_partkey + 2) WHERE a.p_partkey % 20 = 0),
every AS (SELECT CAST(substr(seed, 2) AS BIGINT) AS query_id, id AS citation FROM shown UNION SELECT query_id, 'P' || k FROM hits
  UNION SELECT query_id, 'Art. ' || z || ' OR' FROM hits UNION SELECT query_id, 'Art. ' || z || 'a Abs. 2 ZGB' FROM hits UNION SELECT p_partkey, 'Art. 1 OR' FROM part WHERE p_partkey % 20 = 0)
SELECT * FROM every WHERE NOT (citation LIKE 'P%' AND right(citation, 1) IN ('1', '3', '5', '7', '9'))"""
