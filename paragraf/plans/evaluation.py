"""Queries of metrics: for every order the returned parts are predicted, by price, and the parts of open lines are gold."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from .retrieval import ints, rounded, table


def _sides(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    name = F.concat(F.lit("Art. "), F.col("l_partkey").cast("string"))
    pred = lines.where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("query_id"), name.alias("citation")).agg(F.max("l_extendedprice").alias("price"))
    order = Window.partitionBy("query_id").orderBy(F.desc("price"), "citation")
    pred = pred.select("query_id", F.row_number().over(order).alias("rank"), "citation")
    gold = lines.where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("query_id"), name.alias("citation")).distinct()
    return pred, gold, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"))


def _strings(spark, sf_dir):
    pred, gold, queries = _sides(spark, sf_dir)
    lists = lambda df, name: df.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list("citation")), ";").alias(name))
    a = queries.where("query_id % 3 <> 0").join(lists(pred, "predicted_citations"), "query_id", "left")
    b = queries.where("query_id % 5 <> 0").join(lists(gold, "gold_citations"), "query_id", "left")
    return a, b


def q_confusion(spark, sf_dir):
    return M.confusion(*_sides(spark, sf_dir))


def q_f1_per_query(spark, sf_dir):
    return rounded(M.per_query(*_sides(spark, sf_dir)), "precision", "recall", "f1")


def q_macro(spark, sf_dir):
    return rounded(M.macro(*_sides(spark, sf_dir)), "macro_precision", "macro_recall", "macro_f1")


def q_micro(spark, sf_dir):
    return rounded(M.micro(*_sides(spark, sf_dir)), "micro_precision", "micro_recall", "micro_f1")


def q_average_precision(spark, sf_dir):
    return rounded(M.average_precision(*_sides(spark, sf_dir)), "ap")


def q_map(spark, sf_dir):
    return rounded(M.mean_average_precision(*_sides(spark, sf_dir)), "map")


def q_ndcg(spark, sf_dir):
    return rounded(M.ndcg(*_sides(spark, sf_dir), 3), "ndcg")


def q_mean_ndcg(spark, sf_dir):
    return rounded(M.mean_ndcg(*_sides(spark, sf_dir), 3), "mean_ndcg")


def q_report(spark, sf_dir):
    pred, gold, queries = _sides(spark, sf_dir)
    return M.report(pred, gold, queries).select("query_id", *[F.array_join(c, "|").alias(c) for c in ("tp", "fp", "fn")])


def q_score_join(spark, sf_dir):
    return M.joined(*_strings(spark, sf_dir)).groupBy("side").agg(F.count("*").alias("n"))


def q_score_inner(spark, sf_dir):
    return rounded(M.score(*_strings(spark, sf_dir), None, strict=False), "macro_precision", "macro_recall", "macro_f1", "micro_precision", "micro_recall", "micro_f1", "map")


def q_competition(spark, sf_dir):
    submission, solution = _strings(spark, sf_dir)
    return rounded(M.competition(submission, solution.where("query_id % 3 <> 0")), "score")


def q_validate(spark, sf_dir):
    """Repeated order keys of lines as ids; the citations have a book that is not known."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.lit("Art. 1 QQ").alias("predicted_citations"))
    errors = M.validate(lines, ["OR", "ZGB"], "x.csv", "query_id")
    return spark.createDataFrame([(n, e) for n, e in enumerate(errors)], "n int, error string")


QUERIES = {f.__name__: f for f in (q_confusion, q_f1_per_query, q_macro, q_micro, q_average_precision, q_map, q_ndcg, q_mean_ndcg, q_report, q_score_join, q_score_inner, q_competition, q_validate)}

_SIDES = """
priced AS (SELECT l_orderkey AS query_id, 'Art. ' || l_partkey AS citation, max(l_extendedprice) AS price FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL),
pred AS (SELECT query_id, citation, row_number() OVER (PARTITION BY query_id ORDER BY price DESC, citation) AS rank FROM priced),
gold AS (SELECT DISTINCT l_orderkey AS query_id, 'Art. ' || l_partkey AS citation FROM lineitem WHERE l_linestatus = 'O'),
queries AS (SELECT DISTINCT o_orderkey AS query_id FROM orders)"""
_COUNTS = """
counts AS (SELECT query_id, (SELECT count(*) FROM pred p WHERE p.query_id = q.query_id) AS n_pred, (SELECT count(*) FROM gold g WHERE g.query_id = q.query_id) AS n_gold,
  (SELECT count(*) FROM pred p JOIN gold g USING (query_id, citation) WHERE p.query_id = q.query_id) AS tp FROM queries q),
each AS (SELECT query_id, CASE WHEN n_pred = 0 AND n_gold = 0 THEN 1.0 WHEN n_pred = 0 OR n_gold = 0 THEN 0 ELSE tp::DOUBLE / n_pred END::DOUBLE AS p,
  CASE WHEN n_pred = 0 AND n_gold = 0 THEN 1.0 WHEN n_pred = 0 THEN 0 WHEN n_gold = 0 THEN 1 ELSE tp::DOUBLE / n_gold END::DOUBLE AS r FROM counts),
f AS (SELECT *, CASE WHEN p + r > 0 AND p > 0 AND r > 0 THEN 2 * p * r / (p + r) ELSE 0 END::DOUBLE AS f1 FROM each)"""
_MICRO = "(SELECT CASE WHEN sum(n_pred) > 0 THEN sum(tp)::DOUBLE / sum(n_pred) ELSE 0 END::DOUBLE AS mp, CASE WHEN sum(n_gold) > 0 THEN sum(tp)::DOUBLE / sum(n_gold) ELSE 0 END::DOUBLE AS mr FROM counts)"
_AP = """
hits AS (SELECT query_id, rank, g.citation IS NOT NULL AS hit FROM pred LEFT JOIN gold g USING (query_id, citation)),
so_far AS (SELECT query_id, rank, hit, sum(hit::INT) OVER (PARTITION BY query_id ORDER BY rank) AS n FROM hits),
summed AS (SELECT query_id, sum(n::DOUBLE / rank) AS s FROM so_far WHERE hit GROUP BY query_id),
sizes AS (SELECT query_id, count(*) AS g FROM gold GROUP BY query_id),
ap AS (SELECT query_id, CASE WHEN g > 0 THEN coalesce(s, 0) / g ELSE 0 END::DOUBLE AS ap FROM queries LEFT JOIN summed USING (query_id) LEFT JOIN sizes USING (query_id))"""
_NDCG = """
hits AS (SELECT query_id, rank FROM pred JOIN gold USING (query_id, citation) WHERE rank <= 3),
dcg AS (SELECT query_id, sum(1 / log2(rank + 1)) AS d FROM hits GROUP BY query_id),
sizes AS (SELECT query_id, least(count(*), 3) AS g FROM gold GROUP BY query_id),
ndcg AS (SELECT query_id, CASE WHEN g > 0 THEN coalesce(d, 0) / list_sum(list_transform(range(1, g + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END::DOUBLE AS ndcg FROM queries LEFT JOIN dcg USING (query_id) LEFT JOIN sizes USING (query_id))"""

SQL = {
    "q_confusion": f"WITH {_SIDES}, {_COUNTS} SELECT * FROM counts",
    "q_f1_per_query": f"WITH {_SIDES}, {_COUNTS} SELECT query_id, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM f",
    "q_macro": f"WITH {_SIDES}, {_COUNTS} SELECT round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM f",
    "q_micro": f"WITH {_SIDES}, {_COUNTS} SELECT round(mp, 6) AS micro_precision, round(mr, 6) AS micro_recall, round(CASE WHEN mp + mr > 0 THEN 2 * mp * mr / (mp + mr) ELSE 0 END, 6) AS micro_f1 FROM {_MICRO}",
    "q_average_precision": f"WITH {_SIDES}, {_AP} SELECT query_id, round(ap, 6) AS ap FROM ap",
    "q_map": f"WITH {_SIDES}, {_AP} SELECT round(avg(ap), 6) AS map FROM ap",
    "q_ndcg": f"WITH {_SIDES}, {_NDCG} SELECT query_id, round(ndcg, 6) AS ndcg FROM ndcg",
    "q_mean_ndcg": f"WITH {_SIDES}, {_NDCG} SELECT round(avg(ndcg), 6) AS mean_ndcg FROM ndcg",
    "q_report": f"""WITH {_SIDES}, p AS (SELECT query_id, list(citation) AS l FROM pred GROUP BY query_id), g AS (SELECT query_id, list(citation) AS l FROM gold GROUP BY query_id),
b AS (SELECT query_id, coalesce(p.l, []) AS p, coalesce(g.l, []) AS g FROM queries LEFT JOIN p USING (query_id) LEFT JOIN g USING (query_id))
SELECT query_id, coalesce(array_to_string(list_sort(list_filter(p, lambda x: list_contains(g, x))), '|'), '') AS tp, coalesce(array_to_string(list_sort(list_filter(p, lambda x: NOT list_contains(g, x))), '|'), '') AS fp,
  coalesce(array_to_string(list_sort(list_filter(g, lambda x: NOT list_contains(p, x))), '|'), '') AS fn FROM b""",
    "q_score_join": "SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'left_only' WHEN o_orderkey % 3 = 0 THEN 'right_only' ELSE 'both' END AS side, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 5 <> 0 GROUP BY 1",
    "q_score_inner": f"""WITH {_SIDES.replace("queries AS (SELECT DISTINCT o_orderkey AS query_id FROM orders)", "queries AS (SELECT DISTINCT o_orderkey AS query_id FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0)").replace("ORDER BY price DESC, citation", "ORDER BY citation")}, {_COUNTS}, {_AP}
SELECT * FROM (SELECT round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM f),
(SELECT round(mp, 6) AS micro_precision, round(mr, 6) AS micro_recall, round(CASE WHEN mp + mr > 0 THEN 2 * mp * mr / (mp + mr) ELSE 0 END, 6) AS micro_f1 FROM {_MICRO}),
(SELECT round(avg(ap), 6) AS map FROM ap), (SELECT count(*) AS num_queries FROM queries)""",
    "q_competition": f"""WITH {_SIDES.replace("queries AS (SELECT DISTINCT o_orderkey AS query_id FROM orders)", "queries AS (SELECT DISTINCT o_orderkey AS query_id FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0)")}, {_COUNTS}
SELECT round(avg(CASE WHEN n_pred = 0 AND n_gold = 0 THEN 1 WHEN tp = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (n_pred + n_gold) END), 6) AS score FROM counts""",
}
SQL["q_validate"] = """
WITH again AS (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1 ORDER BY l_orderkey LIMIT 5)
SELECT 0 AS n, 'repeated query_ids: [' || (SELECT string_agg(l_orderkey, ', ' ORDER BY l_orderkey) FROM again) || ']' AS error
UNION ALL SELECT 1, 'citations that can''t be read: [''Art. 1 QQ'', ''Art. 1 QQ'', ''Art. 1 QQ'']'
"""
