"""Near copies by similarity (operator 1 for filtering): SimHash ball hashing, completed by prefix filtering.

Two texts are linked if the Jaccard likeness of their sets of five-word shingles reaches `likeness`;
groups are connected components of links. The majority fingerprints of shingle sets go through the
meet-in-the-middle hashing of `simhash.links`; texts of one fingerprint and those whose fingerprints
meet are candidates. No radius that can be enumerated is sure to hold all texts of a likeness of 0.8
(about ten of 64 bits differ then), so prefix filtering finds the rest, without loss:

Under any one order of shingles, two sets so alike share one among the first n - ceil(likeness * n) + 1
of each (n: size of the set). The order puts shingles that are frequent in a sample of texts last, the
most frequent at the end, which keeps boilerplate out of the prefixes; it decides only how much work
there is. First every text meets the REACH texts after it in each bucket of a prefix shingle (in blocks
of BLOCK texts, so that no bucket is one task), which makes one group of most families of copies without
comparing all their pairs. Then, for every shingle whose texts are not all in one group yet, all pairs
of texts from different groups are tried: nothing is capped. Before sets are compared, pairs go whose
sizes, whose places of the shared shingle or whose parities (512 bits, which differ in at most as many
as the sets do) rule the likeness out; all three are bounds, not estimates.

Texts are known by 64 bits of their hash (odds of one clash about 4e-6 at twelve million texts), shingles
by 64 bits, of which KEY_BYTES * 8 are compared in the end (a false match among the shingles of two texts
of a thousand words has odds of 1e-6, and would change the likeness by a thousandth). Copies of one text
are one entry from the start. Ids choose: the smallest id of a group stands for it.
Null texts count as empty; texts with fewer than five words have one shingle, all their words, and those
without words are alike. Texts of any length are taken whole. Empty tables give empty results. Rows with
null ids are left out of groups; texts that share an id count as versions of one document, each compared
for itself. Columns other than id and text are not read, so that none can clash. Sets joined to texts are
broadcast only when counted to be at most BROADCAST_IDS.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import delete_folder
from . import common, simhash
from .components import components

SHINGLE, LIKENESS = 5, 0.8
#: Texts of the sample that orders shingles, how many of them make a shingle frequent, and how many shingles are ranked.
SAMPLE, FREQUENT, RANKED = 25_000, 4, 500_000
PARITY = tuple(f"p{k}" for k in range(8))
#: Texts that one meets after it in a bucket, texts of a block, and bytes of a shingle's hash that sets are compared by.
REACH, BLOCK, KEY_BYTES = 8, 4096, 5
#: Keys of texts that a task remembers, so as to send copies once.
REMEMBERED = 1_000_000
#: Bytes of sets that travel with pairs at once, at least: more pairs are compared in rounds, so that disk follows the texts and not the pairs.
ROUND_BYTES = 256 << 20
BROADCAST_IDS = 1_000_000


def _shingles(tokens: list[bytes], words: int) -> list[bytes]:
    if len(tokens) < words:
        return [b" ".join(tokens)]
    return list(map(b" ".join, zip(*(tokens[k:] for k in range(words)), strict=False)))


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    import xxhash

    digest = partial(xxhash.xxh64_digest, seed=SHINGLE)
    return np.unique(np.frombuffer(b"".join(map(digest, _shingles(text.lower().split(), SHINGLE))), ">u8")).astype("<u8")


def text_key(text: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(text)[:8]


def parity(hashes: np.ndarray) -> bytes:
    """A bit for each 64th of PARITY's bits' values: whether the hashes that fall to it are odd in number."""
    bits = 64 * len(PARITY)
    return np.packbits(np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def majority(hashes: np.ndarray) -> bytes:
    """SimHash fingerprint of a set of shingles."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), simhash.SLICE):
        part = np.ascontiguousarray(hashes[k : k + simhash.SLICE]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype=np.uint32)
    return np.packbits(2 * counts > len(hashes)).tobytes()


def prints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t, n, fp, parities): the text's key, the size, the fingerprint and the parities of its set of shingles."""
    import pyarrow as pa

    longs = ["t", "fp", *PARITY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                raw, sizes = [], []
                for x in common.python_strings(part.column(1)):
                    hashes = shingle_set(encoded := x.encode())
                    raw.append(text_key(encoded) + majority(hashes) + parity(hashes))
                    sizes.append(len(hashes))
                columns = np.frombuffer(b"".join(raw), ">i8").astype("i8").reshape(-1, len(longs))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int32()), *(pa.array(columns[:, j]) for j in range(len(longs)))], ["id", "n", *longs])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    return rows.mapInArrow(run, "id long, n int, " + ", ".join(f"{c} long" for c in longs))


def frequent(df: DataFrame, id_col: str, text_col: str, count: int) -> np.ndarray:
    """Hashes of shingles that are frequent in a sample of the texts, the most frequent last."""
    import pyarrow as pa

    every = max(1, count // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                for x in common.python_strings(batch.column(0).slice(k, 512)):
                    if int.from_bytes(text_key(x.encode())) % every == 0:
                        yield pa.RecordBatch.from_arrays([pa.array(shingle_set(x.encode()).view("<i8"))], ["h"])

    rows = df.where(F.col(id_col).isNotNull()).select(F.col(text_col).alias("text"))
    counts = rows.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= FREQUENT)
    found = counts.orderBy(F.desc("count"), "h").select("h").limit(RANKED).toArrow().column(0).to_numpy()
    return found[::-1].astype("<i8").view("<u8")


def prefixes(df: DataFrame, id_col: str, text_col: str, likeness: float, late: np.ndarray) -> DataFrame:
    """(h, t, n, at): the first shingles of every row's text, with their places."""
    import pyarrow as pa

    order = np.argsort(late, kind="stable")
    held = df.sparkSession.sparkContext.broadcast((late[order], (order + 1).astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ranks = held.value
        seen: set[bytes] = set()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                out: dict[bytes, tuple[np.ndarray, int]] = {}
                for x in common.python_strings(batch.column(0).slice(k, 256)):
                    key = text_key(raw := x.encode())
                    if key in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(key)
                    hashes = shingle_set(raw)
                    if len(known):
                        place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                        # hashes are sorted, so a stable sort by rank orders by rank, then hash
                        hashes = hashes[np.argsort(np.where(known[place] == hashes, ranks[place], 0), kind="stable")]
                    n = len(hashes)
                    out[key] = hashes[: n - int(np.ceil(likeness * n - 1e-9)) + 1], n
                if not out:
                    continue
                sizes = [len(h) for h, _ in out.values()]
                keys = np.frombuffer(b"".join(out), ">i8").astype("<i8")
                columns = [np.concatenate([h for h, _ in out.values()]).view("<i8"), np.repeat(keys, sizes), np.repeat(np.array([n for _, n in out.values()], np.int32), sizes), np.concatenate([np.arange(z, dtype=np.int32) for z in sizes])]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["h", "t", "n", "at"])

    rows = df.where(F.col(id_col).isNotNull()).select(F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "h long, t long, n int, at int")


def _sets(df: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(t, s): sorted distinct hashes, KEY_BYTES each, of the shingles of texts under wanted ids."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                texts = [x.encode() for x in common.python_strings(batch.column(1).slice(k, 256))]
                keys = np.frombuffer(b"".join(map(text_key, texts)), ">i8").astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([packed(shingle_set(x)) for x in texts], pa.binary())], ["t", "s"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    near = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    return rows.join(near, "id", "left_semi").mapInArrow(run, "t long, s binary").groupBy("t").agg(F.min("s").alias("s"))


def packed(hashes: np.ndarray) -> bytes:
    """The upper KEY_BYTES of sorted hashes."""
    return np.ascontiguousarray(hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).tobytes()


def unpacked(raw) -> np.ndarray:
    flat = np.frombuffer(raw, np.uint8).reshape(-1, KEY_BYTES)
    wide = np.zeros((len(flat), 8), np.uint8)
    wide[:, 8 - KEY_BYTES :] = flat
    return wide.reshape(-1).view(">u8").astype("<u8")


def _alike(pairs: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """The pairs whose sets are alike enough."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (unpacked(z.as_buffer()) for z in (x, y))
                least = likeness * max(len(p), len(q))
                common_ = 0
                if min(len(p), len(q)) >= least:
                    both = np.concatenate((p, q))
                    both.sort(kind="stable")  # two sorted runs: one merge
                    common_ = int((both[1:] == both[:-1]).sum())
                keep.append(common_ >= likeness * (len(p) + len(q) - common_))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("t").alias("a"), F.col("s").alias("p")), sets.select(F.col("t").alias("b"), F.col("s").alias("q"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "p", "q").mapInArrow(run, "a long, b long")


def _in_rounds(pairs: DataFrame, sets: DataFrame, texts: DataFrame, likeness: float) -> DataFrame:
    """The pairs whose sets are alike enough, compared in rounds of about as many bytes as all sets have (or ROUND_BYTES).

    A text has the more pairs the more copies a table holds, so what travels with pairs grows faster than the
    texts; a round's shuffle files go when its links are written.
    """
    size = F.sum(F.col("n").cast("long") * KEY_BYTES)
    sent = pairs.join(texts.select(F.col("t").alias("a"), "n"), "a").agg(size).first()[0] or 0
    rounds = 1
    if sent > ROUND_BYTES:
        ends = pairs.select(F.col("a").alias("t")).union(pairs.select("b")).distinct()
        rounds = -(-sent // max(ROUND_BYTES, ends.join(texts.select("t", "n"), "t").agg(size).first()[0]))
    if rounds == 1:
        return common.checkpoint(_alike(pairs, sets, likeness))
    spark, path = pairs.sparkSession, f"{common.shared_folder(pairs.sparkSession)}/sets-{uuid.uuid4().hex}"
    sets.write.parquet(path)  # every round reads them
    number = F.pmod(F.xxhash64("a", "b"), F.lit(rounds))
    found = [common.checkpoint(_alike(pairs.where(number == k), spark.read.parquet(path), likeness)) for k in range(rounds)]
    delete_folder(spark, path)
    return reduce(DataFrame.unionByName, found)


def _met_by_fingerprint(texts: DataFrame) -> DataFrame:
    """(a, b): texts whose fingerprints meet within the radius, one for each; and neighbours among those of one fingerprint."""
    prints_ = texts.groupBy("fp").agg(F.min("t").alias("least"), F.count("*").alias("m"))
    found = simhash.links(prints_.select("fp"))
    a, b = (prints_.select(F.col("fp").alias(c), F.col("least").alias(f"t{c}")) for c in "ab")
    beside = found.join(a, "a").join(b, "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
    several = prints_.where("m > 1").select("fp", F.ceil(F.col("m") / BLOCK).alias("blocks"))
    same = texts.join(several, "fp").select("t", F.lag("t").over(Window.partitionBy("fp", F.pmod("t", "blocks")).orderBy("t")).alias("before"))
    return beside.unionByName(same.where("before is not null").select(F.col("before").alias("a"), F.col("t").alias("b")))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", likeness: float = LIKENESS) -> DataFrame:
    """(id, group_id) of every distinct id; group_id is the smallest id of its near copies."""
    rows = common.checkpoint(prints(df, id_col, text_col))
    texts = common.checkpoint(rows.groupBy("t").agg(*(F.min(c).alias(c) for c in ("id", "n", "fp", *PARITY))))
    # one document of each text is enough; what stays beside (an id with several texts) only makes buckets look larger
    key = common.fresh(df, "copy")
    copies = common.checkpoint(rows.join(texts.select("id").distinct(), "id", "left_anti").select(F.col("id").alias(key)).distinct())
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
    once = df.join(copies, F.col(id_col).cast("long") == F.col(key), "left_anti")
    met = prefixes(once, id_col, text_col, likeness, frequent(once, id_col, text_col, texts.count()))
    several = met.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h", F.ceil(F.col("m") / BLOCK).alias("blocks"))
    shared = common.checkpoint(met.join(several, "h").distinct())
    most = (1 - likeness) / (1 + likeness)  # of two sizes' sum, what sets so alike differ in

    def sizes(na: Column, nb: Column) -> Column:
        return F.least(na, nb) >= likeness * F.greatest(na, nb) - 1e-6

    def close(a: str, b: str) -> Column:
        """Whether sizes and parities, in columns that end in these, leave room for the likeness."""
        apart = sum((F.bit_count(F.col(p + a).bitwiseXOR(F.col(p + b))) for p in PARITY), F.lit(0))
        return (apart <= most * (F.col("n" + a) + F.col("n" + b)) + 1e-6) & sizes(F.col("n" + a), F.col("n" + b))

    def alike(pairs: DataFrame, checked: bool = False) -> DataFrame:
        if not checked:
            a, b = (texts.select(F.col("t").alias(c), F.col("n").alias(f"n{c}"), *(F.col(p).alias(p + c) for p in PARITY)) for c in "ab")
            pairs = pairs.join(a, "a").join(b, "b").where(close("a", "b")).select("a", "b")
        pairs = common.checkpoint(pairs)
        wanted = pairs.select(F.col("a").alias("t")).union(pairs.select("b")).distinct()
        sets = _sets(once, id_col, text_col, texts.join(wanted, "t", "left_semi").select("id").distinct())
        return _in_rounds(pairs, sets, texts, likeness)

    before = Window.partitionBy("h", F.pmod(F.xxhash64("t", "h"), F.col("blocks"))).orderBy("t").rowsBetween(-REACH, -1)
    after = shared.select("t", "n", F.collect_list(F.struct("t", "n")).over(before).alias("others"))
    after = after.select(F.col("t").alias("b"), F.explode(F.filter("others", lambda x: (x["t"] < F.col("t")) & sizes(x["n"], F.col("n")))).alias("x"))
    links = alike(_met_by_fingerprint(texts).unionByName(after.select(F.col("x.t").alias("a"), "b")).distinct())
    roots = components(links).withColumnRenamed("node", "t")
    rooted = common.checkpoint(shared.drop("blocks").join(roots, "t", "left").withColumn("root", F.coalesce("root", "t")))
    tally = rooted.groupBy("h", "root").agg(F.count("*").alias("m")).groupBy("h").agg(F.max(F.struct("m", "root")).alias("top"), F.count("*").alias("parts"))
    mixed = rooted.join(tally.where("parts > 1").select("h", F.col("top.root").alias("main")), "h")
    mixed = common.checkpoint(mixed.join(texts.select("t", *PARITY), "t"))
    # a pair from different groups has one text at least outside the shingle's largest group
    x, y = (mixed.select("h", *(F.col(c).alias(c + side) for c in ("t", "n", "at", "root", "main", *PARITY))) for side in "xy")
    room = F.least(F.col("nx") - F.col("atx"), F.col("ny") - F.col("aty")) >= (1 - most) / 2 * (F.col("nx") + F.col("ny")) - 1e-6
    cross = x.where("rootx <> mainx").join(y, "h").where(F.expr("rootx <> rooty and (rooty = mainy or tx < ty)") & room & close("x", "y"))
    links = links.unionByName(alike(cross.select(F.least("tx", "ty").alias("a"), F.greatest("tx", "ty").alias("b")).distinct(), checked=True))
    # texts under one id belong together
    versions = common.checkpoint(rows.select("id", "t").distinct())
    least = versions.groupBy("id").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b")
    links = links.unionByName(versions.join(least.select("id", "a"), "id").where("t <> a").select("a", F.col("t").alias("b")))
    rooted = versions.join(components(links).withColumnRenamed("node", "t"), "t", "left").withColumn("root", F.coalesce("root", "t"))
    # written, so that the join below shuffles both sides and Spark can split a group that holds a third of all ids
    rooted = common.checkpoint(rooted)
    smallest = common.checkpoint(rooted.groupBy("root").agg(F.min("id").alias("group_id")))
    return rooted.join(smallest, "root").groupBy("id").agg(F.min("group_id").alias("group_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", likeness: float = LIKENESS) -> DataFrame:
    """The frame's rows, with one document of each group of near copies: that of the smallest id.

    Rows with a null id stay. Equal rows of one id are one; other columns and their order stay.
    """
    found = common.checkpoint(groups(df, id_col, text_col, likeness))
    gone, again = common.fresh(df, "gone"), common.fresh(df, "again")
    drop = found.where("id <> group_id").select(F.col("id").alias(gone))
    if drop.count() <= BROADCAST_IDS:
        drop = F.broadcast(drop)
    kept = df.join(drop, F.col(id_col).cast("long") == F.col(gone), "left_anti")
    twice = df.groupBy(F.col(id_col).alias(again)).agg(F.count("*").alias("rows")).where(F.col("rows") > 1).where(F.col(again).isNotNull()).select(again)
    if twice.isEmpty():
        return kept
    once = kept.join(twice, F.col(id_col) == F.col(again), "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(twice, F.col(id_col) == F.col(again), "left_anti").unionByName(once)
