import duckdb
from pyspark.sql import functions as F

from paragraf.llm import url_filter


def verdict(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
        host, path = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = path[: next((k for k, c in enumerate(path) if c in "?#"), len(path))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


URLS = [None, "", "no scheme", "://", "http://", "HTTP://WWW.A.COM/en/x", "http://a.com?x://b.com/en/", "http://com/en/", "http://.com/en/", "http://example.com/en/71", "http://m.example.com/en/7#a", "http://Example.NET/de/8?q", "http://x.net/de/", "http://xnet/de/", "http://x.org/es/a\nb", "http://x.org/ES/", "ftp://a.org/es/", "http://user@b.com:80/en/", "http://b.com/en/" + "a" * 5000, "http://İ.com/en/", "x" * 10_000]


def test_by_brute_force(spark):
    rules = url_filter.RULES
    pages = spark.createDataFrame([(k, u, "clash", "clash") for k, u in enumerate(URLS)], "page_id long, url string, rule string, hits string")
    for few in (0, 100_000):
        got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), broadcast_rules=few).collect()}
        assert got == {k: verdict(u, rules) for k, u in enumerate(URLS)}


def test_many_rules_and_a_crowded_filter(spark):
    rules = [(f"h{k % 50}.example", f"/p{k}", "block" if k % 3 else "allow") for k in range(600)] + [("h1.example", "/p1", "allow"), ("H2.example", None, "block"), (None, "/x", "block")]
    known = [(h.lower(), p or "", v) for h, p, v in rules if h]
    urls = [f"http://a.h{k % 60}.example/p{k}/x" for k in range(800)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    for blocks in (0, 1 << 17):  # the filter as a table, and as a constant
        got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, frame, constant_blocks=blocks).collect()}
        expected = {k: verdict(u, known) for k, u in enumerate(urls)}
        expected = {k: (h, p, r, "block" if r == "h1.example/p1" else v) for k, (h, p, r, v) in expected.items()}
        assert got == expected


def test_deep_rules_and_long_hosts(spark):
    rules = [("com", "", "block"), (".".join(f"l{k}" for k in range(40)) + ".com", "/a", "allow"), ("b..c", "/", "block"), ("x." * 300 + "org", "/p", "block")]
    urls = ["http://" + "a." * n + "com/x" for n in (1, 1000, 100_000)] + ["http://z." + rules[1][0] + "/ab", "http://" + rules[1][0] + "/b", "http://a.b..c/", "http://b.c/", "http://..c/", "http://" + "x." * 301 + "org/p", "http://" + "x." * 299 + "org/p", "http://com./x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for blocks in (0, 1 << 17):
        got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), constant_blocks=blocks).collect()}
        assert got == {k: verdict(u, rules) for k, u in enumerate(urls)}


def test_edges(spark):
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    twice = spark.createDataFrame([(1, "http://a.com/en/"), (1, "http://a.com/en/"), (None, "http://a.com/en/"), (None, None)], "page_id long, url string")
    assert sorted(str(r.verdict) for r in url_filter.judge(twice, rules).collect()) == ["allow", "block", "block", "block"]
    assert url_filter.judge(twice.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge(twice, rules.limit(0)).collect()} == {"allow"}


def test_query_against_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    expected = con.sql("SELECT page_id, host, path, rule, verdict FROM (" + url_filter.SQL["op6_url_filter"] + ")").fetchall()
    found = url_filter.op6_url_filter(spark, sf_dir)
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)) for r in found.select("page_id", "host", "path", "rule", "verdict").collect())
    assert found.where(F.col("verdict") == "block").count() > 0
