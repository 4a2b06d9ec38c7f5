import hashlib
import random

from pyspark.sql import functions as F

from paragraf.llm import common, substring


def brute(rows, width=20):
    """doc -> (words, removed, digest of kept words) of distinct ids."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        words = [w for w in (text or "").encode().split()]
        gone = [False] * len(words)
        for k in range(len(words) - width + 1):
            window = tuple(words[k : k + width])
            if window in seen:
                gone[k : k + width] = [True] * width
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_query_by_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.op9_substring_dedup(spark, sf_dir).collect()}
    assert got == brute(rows)


def test_random_repeats(spark, docs):
    rnd = random.Random(4)
    phrases = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))) for _ in range(12)]
    rows = [(k, " ".join(rnd.choice(phrases) for _ in range(rnd.randint(0, 9)))) for k in range(150)]
    for width, size in ((4, 9), (5, 8), (20, 12), (1, 9)):
        found = substring.remove(docs(rows), width=width, key_bytes=size)
        got = {r.id: (r.n_words, r.n_removed, r.h) for r in found.withColumn("h", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()}
        assert got == brute(rows, width)
        for r in found.collect():
            assert sum(i.stop - i.start for i in r.intervals) == r.n_removed
            assert all(a.stop < b.start for a, b in zip(r.intervals, r.intervals[1:], strict=False))


def test_two_deals_and_second_bounds(spark, docs, monkeypatch):
    rnd = random.Random(5)
    phrases = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))) for _ in range(30)]
    rows = [(rnd.randrange(10**6), " ".join(rnd.choice(phrases) for _ in range(rnd.randint(0, 9)))) for _ in range(300)]
    rows = list(dict(rows).items())
    monkeypatch.setattr(substring, "BLOCK_CHUNKS", 3)
    for options in ({"most_buckets": 5, "buckets": 40, "chunks": 20}, {"most_buckets": 1, "buckets": 7, "chunks": 9}, {"chunks": 1}):
        found = substring.remove(docs(rows), width=4, **options)
        assert {r.id: (r.n_words, r.n_removed, r.h) for r in found.withColumn("h", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()} == brute(rows, 4)
    frame = spark.createDataFrame(rows, "id long, text string")
    for most in (4, 1000):
        placed = substring.chunked(frame, sum(len(t) + substring.ROW_BYTES for _, t in rows), 24, most_bounds=most).collect()
        by_id = [r.chunk for r in sorted(placed, key=lambda r: r.id)]
        assert by_id == sorted(by_id) and len(set(by_id)) > 15


def test_bytes_and_rows_of_a_chunk(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    chunk, keys = substring.Chunk([r.doc_id for r in rows], [r.text for r in rows], 20), substring.Keys(1)
    first = chunk.firsts()
    for buckets in (136, 8000):
        sent = [keys.packed(chunk.high[at], chunk.low[at]) for _, at in chunk.entries(first, buckets)]
        assert sum(map(len, sent)) == 9 * first.sum() and len(sent) <= buckets


def test_an_id_of_many_rows_is_split(spark):
    rnd = random.Random(6)
    rows = [(k if k < 200 else 150, " ".join(rnd.choice("abcdefghijkl") for _ in range(30))) for k in range(600)] + [(None, f"t{k} " * 25) for k in range(300)]
    frame = spark.createDataFrame(rows, "id long, text string")
    placed = substring.chunked(frame, sum(len(t) + substring.ROW_BYTES for _, t in rows), 16).collect()
    sizes = {}
    for r in placed:
        sizes[r.chunk] = sizes.get(r.chunk, 0) + 1
    assert max(sizes.values()) < 200
    keyed = sorted(placed, key=lambda r: (substring.LOWEST if r.id is None else r.id, hashlib.md5(r.text.encode()).digest()))
    assert [r.chunk for r in keyed] == sorted(r.chunk for r in placed)
    order = [(n, r.text) for n, r in enumerate(keyed)]
    got = sorted((r.id if r.id is not None else -1, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring.remove(frame, "id", chunks=16).collect())
    assert got == sorted((r.id if r.id is not None else -1, *brute(order)[n]) for n, r in enumerate(keyed))


def test_edges(spark, docs):
    passage = " ".join(f"w{k}" for k in range(25))
    rows = [(3, passage), (1, "start " + passage), (None, passage), (4, None), (5, ""), (6, passage), (6, passage), (7, "z " * 30_000), (8, "x" * 300_000), (9, "  odd\tspace \n")]
    got = sorted((r.id is not None, r.id or 0, r.n_words, r.n_removed) for r in substring.remove(docs(rows)).collect())
    assert got == sorted([(False, 0, 25, 0), (True, 1, 26, 25), (True, 3, 25, 25), (True, 4, 0, 0), (True, 5, 0, 0), (True, 6, 25, 25), (True, 6, 25, 25), (True, 7, 30_000, 30_000 - 1), (True, 8, 1, 0), (True, 9, 2, 0)])
    kept = {r.id: (r.kept_text, r.carried_0) for r in substring.remove(docs(rows), untouched=True, carry=("fp",)).collect()}
    assert kept[9] == ("  odd\tspace \n", "x") and kept[1][0] == "start" and kept[4][0] is None and kept[5][0] == ""
    assert substring.remove(docs(rows).limit(0)).count() == 0


def flood(n=600):
    """Half of all rows are equal, a third have null ids."""
    rnd = random.Random(8)
    passage = " ".join(f"w{k}" for k in range(40))
    rows = [(None, passage)] * (n // 2) + [(5, "few words")] * 40 + [(None, f"null {k} " * 3) for k in range(30)]
    return rows + [(k, " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 5) for _ in range(60)) + (" " + passage if k % 7 == 0 else "")) for k in range(n - len(rows))]


def test_equal_rows_are_one_in_a_chunk(spark, docs):
    rows = flood()
    keyed = sorted(rows, key=lambda r: (substring.LOWEST if r[0] is None else r[0], hashlib.md5(r[1].encode()).digest()))
    want = sorted((repr(r[0]), *brute([(n, x[1]) for n, x in enumerate(keyed)])[m]) for m, r in enumerate(keyed))
    found = substring.remove(docs(rows), chunks=16).collect()
    assert sorted((repr(r.id), r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in found) == want
    assert all(sum(i.stop - i.start for i in r.intervals) == r.n_removed for r in found)
    once = common.collapsed(docs(rows).select(F.col("doc_id").alias("id"), "text")).collect()
    assert len(once) == len(set(rows)) and sum(r.times for r in once) == len(rows)
    sizes = {}
    frame = spark.createDataFrame([(r.id, r.text, r.times) for r in once], "id long, text string, times long")
    for r in substring.chunked(frame, sum(len(r.text) + substring.ROW_BYTES for r in once), 8).collect():
        sizes[r.chunk] = sizes.get(r.chunk, 0) + 1
    assert max(sizes.values()) <= 3 * sorted(sizes.values())[len(sizes) // 2]


def test_collapsed(spark):
    rows = [(1, None, "x"), (1, None, "x"), (1, "", "x"), (None, "a", None), (None, "a", None), (None, "a", "y"), (2, "b", "z")]
    made = common.collapsed(spark.createDataFrame(rows, "id long, text string, carried_0 string"))
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(((*r, rows.count(r)) for r in set(rows)), key=repr)
    assert common.collapsed(spark.createDataFrame([], "id long, text string")).count() == 0
