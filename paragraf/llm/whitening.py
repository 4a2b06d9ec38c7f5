"""Embedding whitening (operator 13): two passes over a list of distinct vectors, then one projection.

An entry c becomes the integer x = floor(256 c), so that vectors that are alike can be grouped and sums are
exact. The fit list holds each distinct x vector once. Pass one adds it up in integers, which gives the mean
S / n; pass two adds up outer products of centred vectors, a NumPy product a batch and a matrix a partition,
which treeAggregate merges. LAPACK's symmetric solver gives eigenvectors on the driver (a matrix of
dimensions by dimensions), and the projection goes out to the tasks with the plan. A third pass takes the
covariance of what was whitened, by centred blocks, as a check.

Centring is exact: S is n q + r in whole numbers, so x - S / n is (x - q) - r / n with one rounding. The
squared deviation, the sum of (n x - S) ** 2, is taken in whole numbers of any size.

Vectors that are null or empty, or hold null, NaN or infinite entries, take no part. Nor do those of another
length than most distinct vectors have (of lengths as frequent, the longer one). Repeated vectors, be they a
third of all rows, count once in the fit and come back each; so do repeated rows and null ids. Entries whose
x is beyond 64 bits are taken as the largest or smallest number of 64 bits. A component without variance
(too few distinct vectors, or dimensions that depend on others) has a null `whitened` and takes no part in
`identity_error`, which is null if none has variance; `explained` is null if nothing varies at all. With
fewer dimensions than components there are as many components as dimensions. An empty table gives an empty
result. Columns other than id and vector are neither read nor returned, so none can clash.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCALE, COMPONENTS = 256.0, 4
#: Values from here on are added as Python's whole numbers.
SAFE = 1 << 62
#: Rows that are centred and multiplied at a time.
BLOCK = 4096


@dataclass(frozen=True)
class Whitening:
    """What was learned: n distinct vectors with sums S, components as columns, their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def varies(self) -> np.ndarray:
        return self.values > len(self.sums) * np.finfo(float).eps * max(self.values.max(initial=0.0), 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows by components; NaN where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.varies, self.centred(x) @ self.components / np.sqrt(self.values), np.nan)


def entries(vector: Column, scale: float = SCALE) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale))


def usable(vector: Column) -> Column:
    """Whether a vector has entries, all of them finite numbers."""
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def matrix(column, width: int) -> np.ndarray:
    """An Arrow column of lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def blocks(batches: Iterator, width: int) -> Iterator[np.ndarray]:
    """The first columns of batches as matrices of at most BLOCK rows."""
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            yield matrix(batch.column(0).slice(k, BLOCK), width)


def largest(x: np.ndarray) -> int:
    """The largest absolute value, as a whole number that can't overflow."""
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def exact_sums(x: np.ndarray) -> list[int]:
    return (x if largest(x) * max(1, len(x)) < SAFE else x.astype(object)).sum(axis=0).tolist()


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - S / n, rounded once."""
    whole, rest = zip(*(divmod(s, n) for s in sums), strict=True)
    safe = largest(x) < SAFE and max(map(abs, whole)) < SAFE
    apart = x - np.array(whole, np.int64) if safe else x.astype(object) - np.array(whole, object)
    return apart.astype(float) - np.array([r / n for r in rest])


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """Of each row, the sum of (n x - S) ** 2, as whole numbers."""
    whole, rest = zip(*(divmod(s, n) for s in sums), strict=True)
    width, most = x.shape[1], largest(x) + max(map(abs, whole))
    if most < 1 << 31 and width * most * most < SAFE and width * most << 31 < SAFE:
        apart = x - np.array(whole, np.int64)
        high, low = (np.array(y, np.int64) for y in zip(*(divmod(r, 1 << 31) for r in rest), strict=True))
        squares, mixed_low = (apart * apart).sum(axis=1).tolist(), (apart @ low).tolist()
        mixed_high = (apart @ high).tolist() if int(high.max()) < 1 << 31 else [sum(a * b for a, b in zip(row, high.tolist(), strict=True)) for row in apart.tolist()]
        square = sum(r * r for r in rest)
        return [n * n * a - 2 * n * ((h << 31) + m) + square for a, h, m in zip(squares, mixed_high, mixed_low, strict=True)]
    return [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]


def partials(df: DataFrame, make, merge):
    """One pickled value a partition, made of its batches, merged as a tree; None if there is no row."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = make(batches)
        if made is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["made"])

    def both(a, b):
        return b if a is None else a if b is None else merge(a, b)

    return df.mapInArrow(run, "made binary").rdd.map(lambda row: pickle.loads(row[0])).treeAggregate(None, both, both)


def join_moments(a: tuple, b: tuple) -> tuple:
    """(count, mean, centred products) of two blocks as of one."""
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def fit(x: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """Learn from distinct vectors of whole numbers, `width` each, in the first column; read three times."""

    def added(batches):
        n, total = 0, [0] * width
        for rows in blocks(batches, width):
            n, total = n + len(rows), [a + b for a, b in zip(total, exact_sums(rows), strict=True)]
        return (n, total) if n else None

    n, sums = partials(x, added, lambda a, b: (a[0] + b[0], [p + q for p, q in zip(a[1], b[1], strict=True)]))

    def products(batches):
        total = None
        for rows in blocks(batches, width):
            apart = centred(rows, n, sums)
            total = apart.T @ apart if total is None else total + apart.T @ apart
        return total

    covariance = partials(x, products, lambda a, b: a + b) / n
    values, vectors = np.linalg.eigh(covariance)
    best = np.argsort(values)[::-1][:components]
    learned = Whitening(n, tuple(sums), vectors[:, best], values[best], float(np.trace(covariance)))

    def moments(batches):
        total = None
        for rows in blocks(batches, width):
            y = learned.whitened(rows)[:, learned.varies]
            mean = y.mean(axis=0)
            part = (len(y), mean, (y - mean).T @ (y - mean))
            total = part if total is None else join_moments(total, part)
        return total

    if not learned.varies.any():
        return learned
    _, _, spread = partials(x, moments, join_moments)
    error = float(np.abs(spread / n - np.eye(len(spread))).max())
    return Whitening(n, learned.sums, learned.components, learned.values, learned.trace, error)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: float = SCALE) -> DataFrame:
    """(id, component, n, deviation decimal(38, 0), whitened, explained, identity_error) per row and component.

    A deviation beyond 38 digits is null.
    """
    import pyarrow as pa

    shape = "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where(usable(F.col("vector"))).select("id", entries(F.col("vector"), scale).alias("x"))
    distinct = common.checkpoint(rows.select("x").distinct())
    lengths = distinct.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if lengths is None:
        return df.sparkSession.createDataFrame([], shape)
    width = lengths.width
    learned = fit(distinct.where(F.size("x") == width), width, components)
    most = 10**38

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                part = batch.slice(k, BLOCK)
                x = matrix(part.column(1), width)
                far = [Decimal(d) if d < most else None for d in deviations(x, learned.n, learned.sums)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(far, pa.decimal128(38, 0)), pa.array(learned.whitened(x).tolist(), pa.list_(pa.float64()))], ["id", "deviation", "made"])

    made = rows.where(F.size("x") == width).mapInArrow(project, "id long, deviation decimal(38,0), made array<double>")
    shares = [float(v / learned.trace) if learned.trace > 0 else None for v in learned.values]
    made = made.select("id", "deviation", F.posexplode("made").alias("at", "whitened"))
    return made.select(
        "id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(learned.n).cast("long").alias("n"),
        "deviation",
        F.when(~F.isnan("whitened"), F.col("whitened")).alias("whitened"),
        F.get(F.array(*(F.lit(s).cast("double") for s in shares)), F.col("at")).alias("explained"),
        F.lit(learned.identity_error).cast("double").alias("identity_error"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviations beyond 64 bits, from some ten million distinct vectors on, are null; `whiten` gives them as decimals."""
    found = whiten(common.table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "component", "n", F.expr("try_cast(deviation as long)").alias("deviation"), "whitened", "explained", "identity_error")


QUERIES = {"op13_whitening": op13_whitening}
SQL: dict[str, str] = {}
