"""Approximate nearest neighbours (operator 7): multiprobe p-stable hashing.

Each of `tables` hash tables cuts `functions` Gaussian projections into cells of one width. A query
visits its own bucket and those that differ by a step up or down in some projections, in the order of
their estimated success: the sum of squared distances to the cell borders that the step crosses (least
first, from a heap). Candidates of all tables are merged and ranked by exact distances in doubles.

The number of functions follows the logarithm of the number of vectors; projections' centre and spread
and the number of probes are fitted on a bounded sample of vectors (`SAMPLE`), so that `target` of the
sample's true neighbours would be visited (with fewer functions, if MAX_PROBES don't reach it); every
vector is indexed. Buckets of more than `BLOCK` vectors are split into blocks, and visits of a bucket
into shares of about `VISITS`; every share meets every block: no cap, and no bucket is gathered as one.

A query with fewer than k hits, or whose k-th is further off than that of every query of the sample, is
unlike what the probes were fitted on, and is compared with all vectors, in blocks; so are all queries
if no number of probes reaches the target. Within a block all vectors that may be among the k + 1
nearest, by a bound of the error of the fast distances, are ranked by exact ones, so that ties go to the
smaller id however many there are.

Equal vectors are one entry that keeps its k + 1 smallest ids: more can't be among anyone's k nearest,
so a vector that a third of all rows share costs as one, with the same results.

Vectors that are null, empty, all zero, of another length than most, or hold null or non-finite
components take no part, nor do null ids. Floats are compared as floats, other numbers as doubles. Repeated rows (same id, same vector) count once. If fewer
candidates exist than k, all that are found come back. Empty tables give empty results; other columns
are neither read nor returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K, QUERY_EVERY = 10, 100
TABLES, SAMPLE, SAMPLE_QUERIES, BLOCK, VISITS, TARGET, MAX_PROBES = 6, 4096, 64, 2048, 1024, 0.97, 4096
#: Vectors that a bucket holds on average, and the width of cells in standard deviations of projections.
OCCUPANCY, WIDTH = 256, 1.6
SEED = 7


class Tables:
    """Hash functions; small enough to travel with tasks."""

    def __init__(self, sample: np.ndarray, functions: int, tables: int = TABLES, seed: int = SEED):
        rng, dim = np.random.default_rng(seed), sample.shape[1]
        self.functions = functions
        self.tables = tables
        self.a = rng.standard_normal((tables * self.functions, dim))
        p = sample @ self.a.T
        self.width = np.maximum(p.std(0) * WIDTH, 1e-12)
        self.b = rng.random(tables * self.functions) * self.width - p.mean(0)
        self.mix = rng.integers(1, 1 << 62, (tables, self.functions)) * 2 + 1
        self.probes = 1
        self.far = np.inf

    def places(self, x: np.ndarray) -> np.ndarray:
        """Projections in cells, (rows, tables, functions)."""
        return ((x @ self.a.T + self.b) / self.width).reshape(len(x), self.tables, self.functions)

    def keys(self, cells: np.ndarray, table: int) -> np.ndarray:
        """Bucket numbers of cells, (rows, functions)."""
        with np.errstate(over="ignore"):
            h = (cells.astype(np.int64) * self.mix[table]).sum(1) + table * 0x9E3779B9
            h = (h ^ (h >> 29)) * np.int64(0x3F58476D1CE4E5B9)
            return h ^ (h >> 32)

    def fit_probes(self, sample: np.ndarray, k: int, target: float) -> bool:
        """The least number of probes, in steps of a half, that reach `target` of the sample's neighbours; whether they do."""
        queries = sample[:SAMPLE_QUERIES]
        near = np.argsort(squared(queries, sample), axis=1, kind="stable")[:, 1 : k + 1]
        if near.size:  # the k-th neighbour of a query like these is no further among all vectors than in the sample
            self.far = float(np.sqrt(((queries - sample[near[:, -1]]) ** 2).sum(1)).max()) * (1 + 1e-9)
        cells = np.floor(places := self.places(sample)).astype(np.int64)
        wanted = [(places[q, t] - cells[q, t], [tuple((j, int(s)) for j, s in enumerate(row) if s) for row in cells[near[q], t] - cells[q, t]]) for q in range(len(queries)) for t in range(self.tables)]
        self.probes, reached = 1, not near.size
        while not reached and self.probes < MAX_PROBES:
            hits = np.zeros((len(queries), self.tables, near.shape[1]), bool)
            for n, (rest, steps) in enumerate(wanted):
                visited = set(perturbations(rest, self.probes))
                hits[n // self.tables, n % self.tables] = [s in visited for s in steps]
            reached = hits.any(1).mean() >= target
            if not reached:
                self.probes += 1 + self.probes // 2
        return reached


def tables_for(sample: np.ndarray, count: int, k: int, target: float, tables: int = TABLES) -> Tables:
    """Hash tables whose probes reach the target, with as many functions as they may; if none do, `far` sends all queries to the exact way."""
    # a cell of width 1.6 deviations keeps about 1.4 bits of a Gaussian
    functions = int(np.clip(round(np.log2(max(2.0, count / OCCUPANCY)) / 1.4), 1, 24))
    while True:
        made = Tables(sample, functions, tables)
        if made.fit_probes(sample, k, target):
            return made
        if functions == 1:
            made.far = -1.0
            return made
        functions = max(1, functions - 2)


def perturbations(rest: np.ndarray, most: int) -> Iterator[tuple[tuple[int, int], ...]]:
    """Sets of (function, step) in order of their scores, the empty one first; rest: places within cells, 0 to 1."""
    moves = sorted([(r * r, j, -1) for j, r in enumerate(rest.tolist())] + [((1 - r) ** 2, j, 1) for j, r in enumerate(rest.tolist())])
    yield ()
    heap, given = [(moves[0][0], (0,))], 1
    while heap and given < most:
        score, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < len(moves):
            heapq.heappush(heap, (score - moves[last][0] + moves[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (score + moves[last + 1][0], (*chosen, last + 1)))
        steps = sorted((moves[m][1], moves[m][2]) for m in chosen)
        if all(a[0] != b[0] for a, b in zip(steps, steps[1:], strict=False)):
            given += 1
            yield tuple(steps)


def squared(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T


def nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, exact distance) of the `most` nearest of x for each row of q, ties to smaller ids."""
    near = squared(q, x)
    rows, at = np.divmod(np.arange(near.size), len(x))
    if most < len(x):
        # a sum of n products errs by less than n + 2 units in the last place of the sum of their sizes, which is at most (|q| + |x|) ** 2
        size = np.sqrt((q * q).sum(1)) + np.sqrt((x * x).sum(1).max())
        error = 2 * (q.shape[1] + 4) * np.finfo(np.float64).eps * size * size
        rows, at = np.nonzero(near <= (np.partition(near, most - 1, axis=1)[:, most - 1] + 2 * error)[:, None])
    exact = np.concatenate([np.sqrt(((x[at[k : k + 65536]] - q[rows[k : k + 65536]]) ** 2).sum(1)) for k in range(0, len(rows), 65536)])
    order = np.lexsort((ids[at], exact, rows))
    rows, at, exact = rows[order], at[order], exact[order]
    starts = np.searchsorted(rows, np.arange(len(q)))
    keep = np.arange(len(rows)) - starts[rows] < most
    return rows[keep], ids[at[keep]], exact[keep]


def taking_part(vec: Column) -> Column:
    inf = F.lit(float("inf"))
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return vec.isNotNull() & (F.size(vec) > 0) & fine & F.exists(vec, lambda x: x != 0)


def kind_of(df: DataFrame, vec_col: str) -> str:
    return "array<float>" if df.select(vec_col).dtypes[0][1] == "array<float>" else "array<double>"


def classes(df: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """(vec, ids, least): distinct vectors that take part with their k + 1 smallest ids."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind_of(df, vec_col)).alias("vec")).where(taking_part(F.col("vec")) & F.col("id").isNotNull())
    usual = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("vec") == (usual.n if usual else 0))
    first = rows.distinct().withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("r") <= k + 1)
    return first.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("least", F.element_at("ids", 1))


def search(df: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, tables: int = TABLES, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest that are found of every row whose id meets `queries` (a condition on a column `id`)."""
    import pyarrow as pa

    spark = df.sparkSession
    known = common.checkpoint(classes(df, id_col, vec_col, k))
    count = known.count()
    kind = kind_of(df, vec_col)
    raw_type = "<f4" if kind == "array<float>" else "<f8"
    asked = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("vec")).where(queries & F.col("id").isNotNull() & taking_part(F.col("vec"))).distinct()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = np.array([r.vec for r in known.orderBy(F.xxhash64("least", F.lit(SEED)), "least").select("vec").limit(SAMPLE).collect()], np.float64)
    hashes = tables_for(sample, count, k, target, tables)
    asking = known.join(asked.select("vec").distinct(), "vec", "left_semi").select("least", "vec")

    def matrix(column) -> np.ndarray:
        flat = column.flatten() if hasattr(column, "flatten") else column
        return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = matrix(part.column(1))
                cells = np.floor(hashes.places(x.astype(np.float64))).astype(np.int64)
                raw = pa.array([r.tobytes() for r in np.ascontiguousarray(x, raw_type)], pa.binary())
                for t in range(hashes.tables):
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.keys(cells[:, t], t)), part.column(0), raw], ["bucket", "id", "raw"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                x = matrix(part.column(1))
                places = hashes.places(x.astype(np.float64))
                cells = np.floor(places).astype(np.int64)
                for row, id_ in enumerate(part.column(0).to_pylist()):
                    for t in range(hashes.tables):
                        every = list(perturbations(places[row, t] - cells[row, t], hashes.probes))
                        steps = np.zeros((len(every), hashes.functions), np.int64)
                        for n, some in enumerate(every):
                            for j, s in some:
                                steps[n, j] = s
                        keys = np.unique(hashes.keys(cells[row, t] + steps, t))
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), id_))], ["bucket", "id"])

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                raw = pa.array([r.tobytes() for r in np.ascontiguousarray(matrix(part.column(1)), raw_type)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), raw], ["id", "raw"])

    shape = "bucket long, id long, raw binary"
    indexed = known.select("least", "vec").mapInArrow(index, shape)
    # written, so that the joins shuffle both sides and Spark can split a bucket that holds a third of all vectors
    sizes = indexed.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    probed = common.checkpoint(asking.mapInArrow(probe, "bucket long, id long"))
    shares = probed.groupBy("bucket").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("shares"))
    sizes = common.checkpoint(sizes.join(shares, "bucket"))  # buckets that nobody visits need no entries
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda c: F.pmod(F.xxhash64("id", "bucket"), F.col(c)).cast("int")
    entries = indexed.join(sizes, "bucket").select("bucket", dealt("blocks").alias("block"), upto("shares").alias("share"), F.lit(0).alias("kind"), "id", "raw")
    visits = probed.join(sizes, "bucket").select("bucket", dealt("shares").alias("share"), upto("blocks").alias("block"), "id")
    visits = visits.join(asking.mapInArrow(plain, "id long, raw binary"), "id").select("bucket", "block", "share", F.lit(1).alias("kind"), "id", "raw")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries of a block come before its visits; the nearest of each query in this partition are kept."""
        now, ids, raws, block = None, [], [], None
        asked_ids: list[int] = []
        asked_raws: list[bytes] = []
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def ranked() -> None:
            nonlocal block, held
            if asked_ids and ids:
                if block is None:
                    block = np.frombuffer(b"".join(raws), raw_type).reshape(len(ids), -1).astype(np.float64)
                q = np.frombuffer(b"".join(asked_raws), raw_type).reshape(len(asked_ids), -1).astype(np.float64)
                rows, found, exact = nearest(q, block, np.array(ids), k + 1)
                best.append((np.array(asked_ids)[rows], found, exact))
                held += len(rows)
            asked_ids.clear()
            asked_raws.clear()

        def reduced() -> None:
            nonlocal held
            q, x, d = (np.concatenate(c) for c in zip(*best, strict=True))
            order = np.lexsort((x, d, q))
            q, x, d = q[order], x[order], d[order]
            fresh = np.ones(len(q), bool)
            fresh[1:] = (q[1:] != q[:-1]) | (x[1:] != x[:-1])  # one distance for a pair, whichever table it is from
            q, x, d = q[fresh], x[fresh], d[fresh]
            starts = np.flatnonzero(np.diff(q, prepend=q[0] - 1))
            place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
            keep = place < k + 1
            best[:] = [(q[keep], x[keep], d[keep])]
            held = int(keep.sum())

        for batch in batches:
            for bucket, part, share, kind, id_, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, part, share) != now:
                    ranked()
                    now, block = (bucket, part, share), None
                    ids, raws = [], []
                if kind == 0:
                    ids.append(id_)
                    raws.append(raw)
                    continue
                asked_ids.append(id_)
                asked_raws.append(raw)
                if len(asked_ids) >= 64:
                    ranked()
            if held > 500_000:
                reduced()
                if held > 250_000:  # more queries than this many results: hand them on
                    yield made(best)
                    best.clear()
                    held = 0
        ranked()
        if best:
            reduced()
            yield made(best)

    def made(best) -> pa.RecordBatch:
        q, x, d = best[0]
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(x), pa.array(d)], ["q", "x", "d"])

    def met(entries: DataFrame, visits: DataFrame) -> DataFrame:
        both = entries.unionByName(visits).select("bucket", "block", "share", "kind", "id", "raw")
        both = both.repartition(common.partitions(spark), "bucket", "block", "share").sortWithinPartitions("bucket", "block", "share", "kind", "id")
        pairs = both.mapInArrow(rank, "q long, x long, d double").distinct()
        nearest = Window.partitionBy("q").orderBy("d", "x")
        return pairs.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k + 1).select("q", "x", "d")

    pairs = common.checkpoint(met(entries, visits))
    # queries with too few hits, or whose k-th is further off than any of the sample's, meet every vector
    hits = pairs.join(known.select(F.col("least").alias("x"), F.least(F.size("ids"), F.lit(k + 1)).alias("n")), "x")
    within = hits.where(F.col("d") <= hashes.far).groupBy("q").agg(F.sum("n").alias("n")).where(F.col("n") > k)
    short = common.checkpoint(asking.join(within, F.col("least") == F.col("q"), "left_anti").select("least", "vec"))
    if not short.isEmpty():
        blocks, shares = -(-count // BLOCK), -(-short.count() // VISITS)
        one = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        every = known.select("least", "vec").mapInArrow(plain, "id long, raw binary").select(F.lit(0).cast("long").alias("bucket"), dealt(blocks).alias("block"), one(shares).alias("share"), F.lit(0).alias("kind"), "id", "raw")
        again = short.mapInArrow(plain, "id long, raw binary").select(F.lit(0).cast("long").alias("bucket"), one(blocks).alias("block"), dealt(shares).alias("share"), F.lit(1).alias("kind"), "id", "raw")
        pairs = pairs.join(short, F.col("q") == F.col("least"), "left_anti").unionByName(met(every, again))
    # from classes back to ids: every query of a class, every kept id of a neighbour's class, but the query itself
    members = asked.join(known.select("vec", F.col("least").alias("q")), "vec").select("q", F.col("id").alias("query_id"))
    found = pairs.join(known.select(F.col("least").alias("x"), "ids"), "x").select("q", "d", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    few = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "vec_id"))).where(F.col("r") <= k + 1)
    every = members.join(few, "q").where("vec_id <> query_id").select("query_id", "vec_id", F.col("d").alias("score"))
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"), F.col("id") % QUERY_EVERY == 0)


QUERIES = {"op7_ann": op7_ann}
SQL: dict[str, str] = {}
