"""Evaluation over long tables: predictions (query_id, rank, citation), gold (query_id, citation), queries (query_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions.text import collapse, drop_empty, filled

# Limits of the competition score.
MAX_ITEMS, MAX_CHARS = 200, 10_000
#: Names under which a metric may be asked for.
ALIASES = {"f1": "macro_f1", "precision": "macro_precision", "recall": "macro_recall", "mean_average_precision": "map"}


class EvaluationError(ValueError):
    """What a participant is told."""


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(0.0)


def confusion(pred: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, n_pred, n_gold, tp) of the sets of every query."""
    a = pred.select("query_id", "citation").distinct().withColumn("p", F.lit(1))
    b = gold.select("query_id", "citation").distinct().withColumn("g", F.lit(1))
    met = a.join(b, ["query_id", "citation"], "full").groupBy("query_id").agg(F.count("p").alias("n_pred"), F.count("g").alias("n_gold"), F.count(F.when(F.col("p").isNotNull() & F.col("g").isNotNull(), 1)).alias("tp"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return queries.select("query_id").distinct().join(met, "query_id", "left").select("query_id", zero("n_pred"), zero("n_gold"), zero("tp"))


def per_query(pred: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, precision, recall, f1): all 1 if both sets are empty; nothing predicted 0; no gold precision 0, recall 1, F1 0."""
    p, g, tp = F.col("n_pred"), F.col("n_gold"), F.col("tp")
    precision = F.when((p == 0) & (g == 0), 1.0).when((p == 0) | (g == 0), 0.0).otherwise(tp.cast("double") / p)
    recall = F.when((p == 0) & (g == 0), 1.0).when(p == 0, 0.0).when(g == 0, 1.0).otherwise(tp.cast("double") / g)
    rows = confusion(pred, gold, queries).select("query_id", precision.alias("precision"), recall.alias("recall"))
    return rows.withColumn("f1", F.when((F.col("precision") == 0) | (F.col("recall") == 0), 0.0).otherwise(_f1(F.col("precision"), F.col("recall"))))


def macro(pred: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """One row macro_precision, macro_recall, macro_f1; zeros without queries."""
    return per_query(pred, gold, queries).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def micro(pred: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """One row micro_precision, micro_recall, micro_f1 of summed counts."""
    total = confusion(pred, gold, queries).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_pred", "n_gold", "tp")])
    rows = total.select(_ratio(F.col("tp"), F.col("n_pred")).alias("micro_precision"), _ratio(F.col("tp"), F.col("n_gold")).alias("micro_recall"))
    return rows.withColumn("micro_f1", _f1(F.col("micro_precision"), F.col("micro_recall")))


def _hits(pred: DataFrame, gold: DataFrame) -> DataFrame:
    wanted = gold.select("query_id", "citation").distinct().withColumn("hit", F.lit(1))
    return pred.select("query_id", "rank", "citation").join(wanted, ["query_id", "citation"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def average_precision(pred: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, ap): hits so far over rank, summed at hits, by the size of gold; repeated predictions count again."""
    so_far = F.sum("hit").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    summed = _hits(pred, gold).withColumn("n", so_far).where("hit = 1").groupBy("query_id").agg(F.sum(F.col("n").cast("double") / F.col("rank")).alias("s"))
    size = gold.groupBy("query_id").agg(F.count_distinct("citation").alias("g"))
    rows = queries.select("query_id").distinct().join(summed, "query_id", "left").join(size, "query_id", "left")
    return rows.select("query_id", F.when(F.col("g") > 0, F.coalesce("s", F.lit(0.0)) / F.col("g")).otherwise(0.0).alias("ap"))


def mean_average_precision(pred: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    return average_precision(pred, gold, queries).agg(F.coalesce(F.avg("ap"), F.lit(0.0)).alias("map"))


def ndcg(pred: DataFrame, gold: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg): gains 1 / log2(rank + 1) of hits in the first k, by the best that min(gold, k) hits give; 0 without gold."""
    got = _hits(pred, gold).where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(F.col("hit") / F.log2(F.col("rank") + 1)).alias("dcg"))
    size = gold.groupBy("query_id").agg(F.least(F.count_distinct("citation"), F.lit(k)).cast("int").alias("g"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("g")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + 1))
    rows = queries.select("query_id").distinct().join(got, "query_id", "left").join(size, "query_id", "left")
    return rows.select("query_id", F.when(F.col("g") > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg"))


def mean_ndcg(pred: DataFrame, gold: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    return ndcg(pred, gold, queries, k).agg(F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("mean_ndcg"))


def report(pred: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, tp, fp, fn, predicted and gold lists): sets as they stand, not normalised."""
    sets = lambda df, name: df.groupBy("query_id").agg(F.sort_array(F.collect_set("citation")).alias(name))
    rows = queries.select("query_id").distinct().join(sets(pred, "p"), "query_id", "left").join(sets(gold, "g"), "query_id", "left")
    p, g = (F.coalesce(c, F.array().cast("array<string>")) for c in ("p", "g"))
    return rows.select("query_id", F.array_intersect(p, g).alias("tp"), F.array_except(p, g).alias("fp"), F.array_except(g, p).alias("fn"), p.alias("predicted"), g.alias("gold"))


def joined(submission: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, predicted_citations, gold_citations, side): side is both, left_only or right_only."""
    a = submission.select("query_id", "predicted_citations", F.lit(1).alias("in_a"))
    b = gold.select("query_id", "gold_citations", F.lit(1).alias("in_b"))
    side = F.when(F.col("in_b").isNull(), "left_only").when(F.col("in_a").isNull(), "right_only").otherwise("both")
    return a.join(b, "query_id", "full").select("query_id", "predicted_citations", "gold_citations", side.alias("side"))


def _long(df: DataFrame, col: str, abbreviations: list[str] | None) -> DataFrame:
    items = C.parse_list(col, abbreviations) if abbreviations is not None else F.array_distinct(drop_empty(F.transform(F.split(filled(col), ";"), collapse)))
    return df.select("query_id", F.posexplode(items).alias("rank", "citation")).withColumn("rank", F.col("rank") + 1)


def score(submission: DataFrame, gold: DataFrame, abbreviations: list[str] | None, strict: bool = True, metrics: list[str] | None = None) -> DataFrame:
    """One row of macro, micro, map and num_queries over normalised citations (blank-collapsed if abbreviations is None).

    strict: queries that the submission lacks are an error, and those only it has are scored too;
    otherwise only queries of both are scored.
    """
    both = joined(submission, gold)
    if strict:
        missing = [r.query_id for r in both.where("side = 'right_only'").select("query_id").orderBy("query_id").limit(5).collect()]
        if missing:
            raise EvaluationError(f"no predictions for {missing}")
    else:
        both = both.where("side = 'both'")
    pred, wanted, queries = _long(both, "predicted_citations", abbreviations), _long(both, "gold_citations", abbreviations), both.select("query_id")
    one = lambda df: df.withColumn("_one", F.lit(1))
    row = one(macro(pred, wanted, queries)).join(one(micro(pred, wanted, queries)), "_one").join(one(mean_average_precision(pred, wanted, queries)), "_one")
    row = row.join(one(queries.agg(F.count("*").alias("num_queries"))), "_one").drop("_one")
    return row.select(*[ALIASES.get(m, m) for m in metrics]) if metrics else row


def competition(submission: DataFrame, solution: DataFrame, row_id: str = "query_id", separator: str = ";", max_items: int = MAX_ITEMS, max_chars: int = MAX_CHARS) -> DataFrame:
    """One row `score`: mean F1 of blank-collapsed sets, 1 if both are empty; raises EvaluationError on what the competition refuses."""
    for name, df in (("Solution", solution), ("Submission", submission)):
        if row_id not in df.columns:
            raise EvaluationError(f"no column {row_id!r} in the {name.lower()}")
    others = [c for c in submission.columns if c != row_id]
    if len(others) != 1:
        raise EvaluationError(f"one column of predictions is expected beside {row_id!r}, not {len(others)}")
    golds = [c for c in solution.columns if c != row_id]
    gold_col = "gold_citations" if "gold_citations" in golds else others[0] if others[0] in golds else golds[0] if len(golds) == 1 else None
    if gold_col is None:
        raise EvaluationError(f"none of the solution's columns {golds} is known to be gold")
    a = submission.select(F.col(row_id).alias("query_id"), F.col(others[0]).cast("string").alias("p"), F.lit(1).alias("there"))
    rows = solution.select(F.col(row_id).alias("query_id"), F.col(gold_col).cast("string").alias("g")).join(a, "query_id", "left")
    pieces = lambda c: F.size(F.split(filled(c), rf"\Q{separator}\E"))
    check = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("there").isNull(), 1)).alias("missing"), F.max(F.greatest(F.length(filled("p")), F.length(filled("g")))).alias("chars"), F.max(F.greatest(pieces("p"), pieces("g"))).alias("items")).first()
    if check.missing:
        raise EvaluationError(f"{check.missing} ids of the solution are not in the submission")
    if not check.n:
        raise EvaluationError("the solution is empty")
    if check.chars > max_chars:
        raise EvaluationError(f"a field has {check.chars} characters, more than {max_chars}")
    if check["items"] > max_items:
        raise EvaluationError(f"a row has {check['items']} citations, more than {max_items}")
    sets = lambda c: F.array_distinct(drop_empty(F.transform(F.split(filled(c), rf"\Q{separator}\E"), collapse)))
    tp, n, m = F.size(F.array_intersect(sets("p"), sets("g"))), F.size(sets("p")), F.size(sets("g"))
    f1 = F.when((n == 0) & (m == 0), 1.0).when(tp == 0, 0.0).otherwise(2.0 * tp / (n + m))
    return rows.agg(F.avg(f1).alias("score"))


def validate(submission: DataFrame, abbreviations: list[str], path: str | None = None, ord_col: str | None = None) -> list[str]:
    """Errors of a submission's form, none if it is valid: suffix, columns, null ids, repeated ids (first five), citations that can't be read in the first ten rows (first three)."""
    errors = [] if path is None or path.lower().endswith(".csv") else [f"not a .csv file: {path}"]
    missing = {"query_id", "predicted_citations"} - set(submission.columns)
    if missing:
        return [*errors, f"columns that are missing: {sorted(missing)}"]
    if not submission.where("query_id is null").limit(1).isEmpty():
        errors.append("some query_id is null")
    again = submission.where("query_id is not null").groupBy("query_id").count().where("count > 1").orderBy("query_id").limit(5).collect()
    if again:
        errors.append(f"repeated query_ids: {[r.query_id for r in again]}")
    head = submission.orderBy(ord_col).limit(10) if ord_col else submission.limit(10)
    items = head.select(F.explode(drop_empty(F.transform(F.split(filled("predicted_citations"), ";"), collapse))).alias("c"))
    bad = items.where(C.canonical_id("c", abbreviations).isNull()).limit(3).collect()
    if bad:
        errors.append(f"citations that can't be read: {[r.c for r in bad]}")
    return errors
