"""Queries of corpus preparation and of the agent over the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import agent as A
from ..operators import bm25, fusion
from ..operators import corpus as K
from ..session import shared_folder
from ..sources import shards, spread
from .citations import _FLAT, BOOKS, _TEXTS
from .citations import _texts as citing_texts
from .retrieval import _scored, table


def _cited(spark, sf_dir):
    name = F.concat(F.lit("D"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), name.alias("citation"), "text")


def q_dedup_merge(spark, sf_dir):
    return K.merge_equal_texts(_cited(spark, sf_dir)).select("ord", "citation", F.md5("text").alias("digest"))


def q_enrich(spark, sf_dir):
    rows = _cited(spark, sf_dir).withColumn("text", F.when(F.col("ord") % 3 == 0, F.concat("citation", F.lit(": "), "text")).otherwise(F.col("text")))
    summary = F.when(F.col("ord") % 5 == 0, F.concat(F.lit("s"), F.col("ord").cast("string")))
    return rows.select("ord", K.enriched("citation", "text", summary).alias("t")).select("ord", F.md5("t").alias("digest"), F.length("t").alias("n"))


def q_coverage(spark, sf_dir):
    return K.coverage(citing_texts(spark, sf_dir).select(F.when(F.col("o_orderkey") % 4 == 0, F.lit(" ")).otherwise(F.col("form")).alias("citation_field")))


def q_gold_sets(spark, sf_dir):
    """With a number in place of the id's text; which number a row has follows a hash, so they are compared as a set, in a column of their own."""
    texts = citing_texts(spark, sf_dir).select("form", F.concat(F.lit("Frage "), F.col("o_orderkey").cast("string")).alias("question"))
    made = K.gold_sets(texts.select("question", F.col("form").alias("answer")), BOOKS)
    ids = made.select(F.col("query_id").alias("query"), F.lit(None).cast("string").alias("gold_citations"))
    return made.select("query", "gold_citations").unionByName(ids)


def q_known_citations(spark, sf_dir):
    cites = F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.lit("BGE 1 I ")).otherwise(F.lit("Art. ")), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 4 == 0, F.lit(" E. 1")).otherwise(F.lit("")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", cites.alias("citation"))
    return K.known_citations(rows, rows.where("o_orderkey % 8 = 0").select("citation"))


def _gold(spark, sf_dir):
    name = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), name.alias("citation")).distinct()
    texts = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("citation"), F.col("p_name").alias("text"))
    queries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("query"))
    return lines, queries, texts


def q_pairs_pos(spark, sf_dir):
    made = K.preference_pairs(*_gold(spark, sf_dir), system="S").where("positive")
    return made.select("query_id", "citation", F.md5("prompt").alias("digest"), "chosen")


def q_pairs_shards(spark, sf_dir):
    """Preference pairs written as shards with a manifest, compared with it, and read back."""
    made = K.preference_pairs(*_gold(spark, sf_dir), system="S").where("positive").select("query_id", "citation", "prompt", "chosen")
    path = f"{shared_folder(spark)}/pairs-{uuid.uuid4().hex}"
    shards.write_shards(made, path, 1 << 20)
    back = shards.read_shards(spark, path, "query_id long, citation string, prompt string, chosen string")
    return back.select("query_id", "citation", F.md5("prompt").alias("digest"), "chosen")


def q_pairs_neg(spark, sf_dir):
    """How many queries get a negative that is not gold for them."""
    gold, queries, texts = _gold(spark, sf_dir)
    made = K.preference_pairs(gold, queries, texts, system="S").where("not positive")
    wrong = made.join(gold, ["query_id", "citation"], "left_semi").count()
    return made.agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("queries")).withColumn("gold", F.lit(wrong).cast("long"))


def q_citation_texts(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.concat(F.lit("C"), (F.col("p_partkey") % 500).cast("string")).alias("citation"), F.col("p_name").alias("text"))
    return K.citation_texts(part.where("ord % 2 = 0"), part.where("ord % 3 = 0"))


def q_training_text(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    title = F.when(F.col("p_partkey") % 2 == 0, F.lit("  ")).otherwise(F.col("p_type"))
    return part.select("p_partkey", K.training_text(title, "p_brand", F.when(F.col("p_partkey") % 3 == 0, None).otherwise(F.col("p_name"))).alias("text"))


def q_block_offsets(spark, sf_dir):
    sizes = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("id"), (F.size(T.tokenize("text")) + 1).alias("n"))
    return K.block_offsets(sizes, "id", "n").select("id", "n", "start")


def q_pack(spark, sf_dir):
    made = K.token_blocks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.tokenize("text").alias("tokens")), 512)
    return made.select("block", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ")).alias("digest"))


def q_split(spark, sf_dir):
    train, held = K.split(table(spark, sf_dir, "orders"), "o_orderkey", 0.02)
    return train.select("o_orderkey", F.lit("train").alias("part")).unionByName(held.select("o_orderkey", F.lit("held").alias("part")))


def q_submission(spark, sf_dir):
    """Lists of an order's parts written as a submission has them."""
    name = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    lists = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.sort_array(F.collect_set(name)).alias("citations"))
    both = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id")).join(lists, "query_id", "left")
    joined = F.array_join(F.coalesce("citations", F.array().cast("array<string>")), ";")
    return both.select("query_id", F.when(joined == "", F.lit(" ")).otherwise(joined).alias("predicted_citations"))


def _outputs(spark, sf_dir):
    key = F.col("conv_id").cast("string")
    text = F.concat(F.lit("Thought: x\nAction: search_"), F.col("role"), F.lit("\nAction Input:  Art. "), key, F.lit(" OR \nObservation: y\naction: Second\nAction Input: "), F.col("turn").cast("string"), F.lit("\nmore"), F.when(F.col("turn") == 1, F.concat(F.lit("\nFinal Answer: BGE "), key, F.lit(" I 2\nend "))).otherwise(F.lit("")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("output"), "text")


def q_parse_actions(spark, sf_dir):
    a = A.action("output")
    return _outputs(spark, sf_dir).select("conv_id", "turn", a["action"].alias("action"), a["input"].alias("input"), A.final_answer("output").alias("answer"))


def q_all_actions(spark, sf_dir):
    rows = _outputs(spark, sf_dir).select("conv_id", "turn", F.posexplode(A.all_actions("output")).alias("i", "a"))
    return rows.select("conv_id", "turn", "i", F.col("a.action").alias("action"), F.md5("a.input").alias("digest"))


def q_json_args(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(A.tool_arguments("props"), F.lit("k")).alias("k"))


def q_short_texts(spark, sf_dir):
    rows = _outputs(spark, sf_dir).select("conv_id", "turn", F.concat(F.lit("sys [/INST]"), "text").alias("c"), "text")
    return rows.select("conv_id", "turn", F.md5(A.short_observation("text", 50)).alias("observation"), F.md5(A.short_conversation("c", 150)).alias("conversation"), F.md5(A.short_conversation("text", 60)).alias("tail"), A.exceeds("text", 40).alias("long"))


def q_prompt(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(A.prompt("Q: {query}\nT: {tools}", query="text", tools=F.lit("search"))).alias("digest"))


def q_relevant(spark, sf_dir):
    """A stub model that says yes to prompts with an even number, over repeated citations."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("citation"), F.struct("l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity").alias("rank"), F.col("l_partkey").cast("string").alias("prompt"))
    return A.relevant(rows, lambda prompts: ["ja" if int(p) % 2 == 0 else "NEIN" for p in prompts]).select("query_id", "citation")


def q_agent_stub(spark, sf_dir):
    """An agent whose model searches once and then answers with what it saw."""
    index = bm25.build(table(spark, sf_dir, "documents"))
    docs = _cited(spark, sf_dir).select(F.col("ord").alias("doc_id"), F.concat(F.lit("SR "), F.lpad(((F.col("ord") % 900) + 100).cast("string"), 3, "0")).alias("citation"), F.regexp_replace("text", "(?i)bge|art|sr", "x").alias("text"))

    def tool(calls):
        return fusion.formatted(calls, bm25.search(calls, index, 3), docs)

    def model(prompts):
        return ["Final Answer: done" if "Observation:" in p else f"Action: search\nAction Input: {' '.join(p.split())}\n" for p in prompts]

    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    answers, _ = A.run(queries, model, {"search": tool}, "{query}\n")
    return answers.select("query_id", "answer", "iterations", F.size("citations").alias("n_citations"))


QUERIES = {f.__name__: f for f in (q_dedup_merge, q_enrich, q_coverage, q_gold_sets, q_known_citations, q_pairs_pos, q_pairs_shards, q_pairs_neg, q_citation_texts, q_training_text, q_block_offsets, q_pack, q_split, q_submission, q_parse_actions, q_all_actions, q_json_args, q_short_texts, q_prompt, q_relevant, q_agent_stub)}

_STRIP = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
_GOLD = """
gold AS (SELECT DISTINCT l_orderkey AS query_id, 'P' || l_partkey AS citation FROM lineitem),
known AS (SELECT 'P' || p_partkey AS citation, p_name AS text FROM part)"""
_TOKENS = r"""
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w FROM documents),
o AS (SELECT doc_id, w, len(w) + 1 AS n, CAST(coalesce(sum(len(w) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d)"""
_OUTPUTS = r"""
o AS (SELECT conv_id, turn, text, 'Thought: x' || chr(10) || 'Action: search_' || role || chr(10) || 'Action Input:  Art. ' || conv_id || ' OR ' || chr(10) || 'Observation: y' || chr(10) || 'action: Second' || chr(10)
  || 'Action Input: ' || turn || chr(10) || 'more' || CASE WHEN turn = 1 THEN chr(10) || 'Final Answer: BGE ' || conv_id || ' I 2' || chr(10) || 'end ' ELSE '' END AS output, role FROM conversations)"""

SQL = {
    "q_dedup_merge": f"""
WITH k AS (SELECT doc_id, text, {_STRIP("coalesce(text, '')")} AS t FROM documents)
SELECT min(doc_id) AS ord, string_agg('D' || lpad(CAST(doc_id AS VARCHAR), 8, '0'), '; ' ORDER BY doc_id) AS citation, md5(arg_min(text, doc_id)) AS digest FROM k GROUP BY t""",
    "q_enrich": f"""
WITH k AS (SELECT doc_id AS ord, 'D' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS c, {_STRIP("coalesce(text, '')")} AS t FROM documents),
m AS (SELECT ord, regexp_replace(CASE WHEN ord % 3 = 0 THEN ltrim(t, ':- ' || chr(10)) ELSE t END, '^$', '') || chr(10) || chr(10) || '<metadata>' || chr(10) || 'Zitat: ' || c || CASE WHEN ord % 5 = 0 THEN chr(10) || 'Zusammenfassung: s' || ord ELSE '' END || chr(10) || '</metadata>' AS t FROM k)
SELECT ord, md5(t) AS digest, CAST(length(t) AS INTEGER) AS n FROM m""",
    "q_coverage": "SELECT count(*) AS rows, count(*) FILTER (WHERE o_orderkey % 4 <> 0) AS with_citations FROM orders",
    "q_gold_sets": rf"""WITH {_TEXTS}
SELECT 'Frage ' || o_orderkey AS query, CASE o_orderkey % 8 WHEN 0 THEN {_FLAT('form')} WHEN 4 THEN 'BGE' || regexp_extract(form, '^bge(.*) cons. 2b$', 1) || ' E. 2b' ELSE form END AS gold_citations
FROM texts WHERE o_orderkey % 8 IN (0, 2, 4, 6)
UNION ALL SELECT printf('train_%04d', row_number() OVER ()), NULL FROM orders WHERE o_orderkey % 8 IN (0, 2, 4, 6)""",
    "q_split": "SELECT o_orderkey, CASE WHEN CAST('0x' || substr(md5(o_orderkey || '|42'), 1, 8) AS BIGINT) % 10000 < 200 THEN 'held' ELSE 'train' END AS part FROM orders",
    "q_agent_stub": _scored("SELECT item_id AS query_id, text AS query FROM benchmark") + ", cited AS (SELECT query_id, count(DISTINCT doc_id % 900) AS n FROM hits WHERE rank <= 3 GROUP BY query_id) SELECT query_id, 'done' AS answer, 2 AS iterations, CAST(coalesce(n, 0) AS INTEGER) AS n_citations FROM asked LEFT JOIN cited USING (query_id)",
    "q_known_citations": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'BGE 1 I ' ELSE 'Art. ' END || o_orderkey || CASE WHEN o_orderkey % 4 = 0 THEN ' E. 1' ELSE '' END AS citation FROM orders WHERE o_orderkey % 2 = 1 OR o_orderkey % 8 = 0",
    "q_pairs_pos": f"""WITH {_GOLD}
SELECT query_id, citation, md5('S' || chr(10) || chr(10) || 'Rechtsfall:' || chr(10) || o_orderpriority || chr(10) || chr(10) || repeat('-', 72) || chr(10) || chr(10) || 'Bestimmung: ' || citation || chr(10) || text) AS digest,
  'Ja, diese Bestimmung ist einschlägig.' AS chosen FROM gold JOIN known USING (citation) JOIN (SELECT DISTINCT o_orderkey AS query_id, o_orderpriority FROM orders) USING (query_id)""",
    "q_pairs_neg": f"WITH {_GOLD} SELECT count(DISTINCT query_id) AS n, count(DISTINCT query_id) AS queries, CAST(0 AS BIGINT) AS gold FROM gold JOIN known USING (citation) WHERE query_id IN (SELECT o_orderkey FROM orders)",
    "q_citation_texts": """
WITH p AS (SELECT 0 AS c, p_partkey AS o, 'C' || (p_partkey % 500) AS citation, p_name AS text FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 1, p_partkey, 'C' || (p_partkey % 500), p_name FROM part WHERE p_partkey % 3 = 0)
SELECT citation, arg_max(text, c * 1000000000 + o) AS text FROM p GROUP BY citation
""",
    "q_training_text": "SELECT p_partkey, concat_ws(chr(10), CASE WHEN p_partkey % 2 <> 0 THEN p_type END, p_brand, CASE WHEN p_partkey % 3 <> 0 THEN p_name END) AS text FROM part",
    "q_block_offsets": f"WITH {_TOKENS} SELECT doc_id AS id, CAST(n AS INTEGER) AS n, start FROM o",
    "q_pack": f"""WITH {_TOKENS},
t AS (SELECT start + i - 1 AS pos, list_append(w, '</s>')[i] AS tok FROM (SELECT start, w, unnest(range(1, n + 1)) AS i FROM o)),
b AS (SELECT pos // 512 AS block, tok, pos FROM t WHERE pos // 512 < (SELECT count(*) FROM t) // 512)
SELECT block, CAST(count(*) AS INTEGER) AS n, md5(string_agg(tok, ' ' ORDER BY pos)) AS digest FROM b GROUP BY block""",
    "q_submission": """
WITH l AS (SELECT l_orderkey AS query_id, string_agg(DISTINCT 'P' || l_partkey, ';' ORDER BY 'P' || l_partkey) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey AS query_id, coalesce(s, ' ') AS predicted_citations FROM orders LEFT JOIN l ON query_id = o_orderkey
""",
    "q_parse_actions": f"WITH {_OUTPUTS} SELECT conv_id, turn, 'search_' || role AS action, 'Art. ' || conv_id || ' OR' AS input, CASE WHEN turn = 1 THEN 'BGE ' || conv_id || ' I 2' || chr(10) || 'end' END AS answer FROM o",
    "q_all_actions": f"""WITH {_OUTPUTS}
SELECT conv_id, turn, CAST(0 AS INTEGER) AS i, 'search_' || role AS action, md5('Art. ' || conv_id || ' OR ' || chr(10) || 'Observation: y') AS digest FROM o
UNION ALL SELECT conv_id, turn, 1, 'Second', md5(turn || chr(10) || 'more' || CASE WHEN turn = 1 THEN chr(10) || 'Final Answer: BGE ' || conv_id || ' I 2' || chr(10) || 'end' ELSE '' END) FROM o""",
    "q_json_args": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "q_short_texts": r"""
WITH t AS (SELECT conv_id, turn, text, 'sys [/INST]' || text AS c FROM conversations)
SELECT conv_id, turn, md5(CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || chr(10) || '... (truncated, ' || (length(text) - 50) || ' chars remaining)' ELSE text END) AS observation,
  md5(CASE WHEN length(c) <= 150 THEN c ELSE 'sys [/INST]' || CASE WHEN length(text) > 39 THEN chr(10) || '...[earlier conversation truncated]...' || chr(10) || right(text, 39) ELSE text END END) AS conversation,
  md5(CASE WHEN length(text) <= 60 THEN text ELSE '...' || right(text, 60) END) AS tail, length(text) / 4.0 > 40 AS long FROM t
""",
    "q_prompt": "SELECT item_id, md5('Q: ' || text || chr(10) || 'T: search') AS digest FROM benchmark",
    "q_relevant": """
WITH l AS (SELECT DISTINCT l_orderkey AS query_id, l_partkey FROM lineitem)
SELECT query_id, 'P' || l_partkey AS citation FROM l WHERE l_partkey % 2 = 0
""",
}
SQL["q_pairs_shards"] = SQL["q_pairs_pos"]
