"""URL filter (operator 6), DataFrame functions only: blocked Bloom filter, then an exact hash join.

A rule is a host and the start of a path. It fits the urls of its host and of all subdomains whose path
starts with the rule's; the longest fitting rule wins (by characters of host and path together, then by
those of the host); if no rule fits, the verdict is `allow`. Equal rules with different verdicts block.

Every rule's canonical string (host and path) sets four bits in one 64-bit block of a Bloom filter. A
url's candidates are the last labels of its host, as many as some rule has, each with the start of its
path of that rule's length: as many as there are different pairs of the two numbers among the rules, and
in time that grows with the url's length only. The filter has a block for four rules, however many there
are: up to `constant_blocks` it is a constant of the plan, a larger one is a table that candidates are
joined with by block (broadcast only if counted to have at most BROADCAST_BLOCKS rows). Candidates that the filter passes, usually none or one, go on to a hash join with the
rules, which removes false positives; all other urls never meet a join or a shuffle. The rules are
broadcast only if counting them shows that there are at most `broadcast_rules`, else both sides are
shuffled by candidate, and Spark splits skewed ones.

Null urls and those without "://" have an empty host and path, and are allowed. Repeated rows come back
each; null ids stay null; empty tables of pages or rules give empty results or verdicts without rules;
columns other than id and url are neither read nor returned. Urls of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bits of the filter for a rule; and the most blocks that the driver holds and the plan carries as a constant.
BITS_PER_RULE, CONSTANT_BLOCKS = 16, 1 << 14
BROADCAST_RULES, BROADCAST_BLOCKS = 100_000, 1 << 22
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, ADDRESS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    mixed = F.xxhash64(key, F.lit(6))
    bits = [F.shiftright(mixed, n).bitwiseAND(F.lit(63)).cast("int") for n in (0, 6, 12, 18)]
    mask = None
    for bit in bits:
        one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
        mask = one if mask is None else mask.bitwiseOR(one)
    return mask


def filter_blocks(n_rules: int) -> int:
    return max(1, -(-n_rules * BITS_PER_RULE // 64))


def bloom(rules: DataFrame, blocks: int) -> DataFrame:
    """(block, word) of the filter's blocks that are not empty."""
    return rules.groupBy(_block(F.col("rule"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("rule"))).alias("word"))


def numbers(values, default: str = "0") -> Column:
    """A constant array of numbers, short in the plan."""
    return F.split(F.lit(",".join(map(str, values)) or default), ",").cast("array<bigint>")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES, constant_blocks: int = CONSTANT_BLOCKS) -> DataFrame:
    """(id, host, path, rule, verdict) per page; rules: (host, path, verdict)."""
    known = rules.where("host is not null").select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict")
    known = known.groupBy(F.concat("rule_host", "rule_path").alias("rule"), "rule_host", "rule_path").agg(F.max(F.col("verdict") == "block").alias("blocks"))
    shape = F.struct(F.size(F.split("rule_host", "\\.")).alias("labels"), F.length("rule_path").alias("length"))
    counted = known.agg(F.count("*").alias("n"), F.sort_array(F.collect_set(shape)).alias("shapes")).first()
    blocks = filter_blocks(counted.n)
    filled = bloom(known, blocks)
    shapes = F.arrays_zip(numbers(x.labels for x in counted.shapes).alias("labels"), numbers(x.length for x in counted.shapes).alias("length"))
    url = F.col(url_col)
    base = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    split = F.split("host", "\\.")
    count = F.size(split)
    fitting = F.filter(shapes, lambda x: (x["labels"] <= count) & (x["length"] <= F.length("path")))
    tails = lambda n: F.array_join(F.slice(split, (count - n + 1).cast("int"), n.cast("int")), ".")
    candidates = F.transform(fitting, lambda x: F.struct(tails(x["labels"]).alias("host"), F.substring(F.col("path"), F.lit(1), x["length"].cast("int")).alias("path")))
    key = lambda c: F.concat(c["host"], c["path"])
    if blocks <= constant_blocks:
        held = {r.block: r.word for r in filled.collect()}
        words = numbers(held.get(k, 0) for k in range(blocks))
        passed = lambda c: F.get(words, _block(key(c), blocks)).bitwiseAND(_mask(key(c))) == _mask(key(c))
        met = base.withColumn("hits", F.filter(candidates, passed))
    else:
        # by url, not by a number of the row, which might be another if a lost task ran again
        tries = base.select("host", "path").distinct().withColumn("c", F.explode(candidates)).withColumn("block", _block(key(F.col("c")), blocks))
        table = F.broadcast(filled) if filled.count() <= BROADCAST_BLOCKS else filled
        good = tries.join(table, "block").where(F.col("word").bitwiseAND(_mask(key(F.col("c")))) == _mask(key(F.col("c"))))
        good = good.groupBy("host", "path").agg(F.collect_list("c").alias("good"))
        met = base.withColumn("hits", candidates).join(good, ["host", "path"], "left").select("id", "host", "path", F.coalesce("good", F.filter("hits", lambda _: F.lit(False))).alias("hits"))
    none, verdict = F.lit(None).cast("string"), F.lit(default)
    plain = met.where(F.size("hits") == 0).select("id", "host", "path", none.alias("rule"), verdict.alias("verdict"))
    some = met.where(F.size("hits") > 0).groupBy("id", "host", "path").agg(F.count("*").alias("times"), F.min("hits").alias("hits"))  # equal rows as one
    pairs = some.select("times", "id", "host", "path", F.explode("hits").alias("hit")).select("times", "id", "host", "path", F.col("hit.host").alias("rule_host"), F.col("hit.path").alias("rule_path"))
    exact = F.broadcast(known) if counted.n <= broadcast_rules else known
    found = pairs.join(exact, ["rule_host", "rule_path"], "left")
    rank = F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("m"), F.col("rule"), F.col("blocks")))
    best = found.groupBy("times", "id", "host", "path").agg(F.max(rank).alias("best")).withColumn("copy", F.explode(F.expr("sequence(1L, times)")))
    decided = F.when(F.col("best").isNull(), verdict).when(F.col("best.blocks"), F.lit("block")).otherwise(F.lit("allow"))
    return plain.unionByName(best.select("id", "host", "path", F.col("best.rule").alias("rule"), decided.alias("verdict")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(common.table(spark, sf_dir, "pages"), rules).withColumnRenamed("id", "page_id")


QUERIES = {"op6_url_filter": op6_url_filter}
SQL = {
    "op6_url_filter": """
WITH rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
parts AS (
  SELECT row_number() OVER () AS n, page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
fits AS (
  SELECT n, h || p AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, length(h) DESC) AS k
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (n)
"""
}
