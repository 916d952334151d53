"""Embedding whitening by a polarised covariance (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
#: Sums over all pairs of dimensions go to the driver, so vectors of more entries are refused.
MOST_DIMENSIONS = 1024
SCALE, SHIFT = 64, 1_000_000
#: An eigenvalue below this share of the largest is taken to be 0: a direction without spread.
FLAT = 1e-12
WIDE = pa.decimal128(38, 0)


def usable(vector: Column) -> Column:
    """Neither null nor with null, NaN or infinite entries."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))


def whole(column: pa.Array, d: int) -> np.ndarray:
    """A row of longs floor(64 c) + 1000000 for each vector."""
    scaled = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if np.abs(scaled).max(initial=0) >= 2.0**62:
        raise ValueError("an entry does not fit into a long")
    return scaled.astype(np.int64).reshape(-1, d) + SHIFT


def exact_sum(values: np.ndarray) -> list[int]:
    """Column sums, in whole numbers without a bound."""
    if int(np.abs(values).max(initial=0)) * len(values) >= 2**62:
        values = values.astype(object)
    return [int(x) for x in values.sum(0)]


def exact_squares(values: np.ndarray) -> list[int]:
    """Column sums of the squares, in whole numbers without a bound."""
    if int(np.abs(values).max(initial=0)) ** 2 * len(values) >= 2**62:
        values = values.astype(object)
    return [int(x) for x in (values * values).sum(0)]


def _decimals(values: list[int]) -> pa.Array:
    return pa.array([Decimal(v) for v in values], WIDE)


def _summer(d: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * d, 0
        for b in batches:
            x = whole(b.column(0), d)
            total, n = [t + s for t, s in zip(total, exact_sum(x))], n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), _decimals([n, *total])], names=["i", "total"])

    return add


def _squarer(d: int, middle: list[int]):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = [[0] * (d - i) for i in range(d)], False
        for b in batches:
            z = whole(b.column(0), d) - np.array(middle)
            for i in range(d):
                total[i] = [t + s for t, s in zip(total[i], exact_squares(z[:, i:] + z[:, i:i + 1]))]
            some = some or len(z) > 0
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([i for i in range(d) for _ in range(i, d)], pa.int32()),
                                              pa.array([j for i in range(d) for j in range(i, d)], pa.int32()),
                                              _decimals([s for row in total for s in row])], names=["i", "j", "total"])

    return add


@dataclass
class Whitening:
    """``sums``: S. ``values`` and ``vectors``: eigenvalues, falling, and unit eigenvectors as columns. ``covariance``: V."""

    d: int
    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def middle(self) -> list[int]:
        return [s // self.n for s in self.sums]

    @property
    def rest(self) -> list[int]:
        """n times the mean's distance from ``middle``."""
        return [s % self.n for s in self.sums]

    def flat(self) -> np.ndarray:
        return self.values <= FLAT * max(self.values[0], 0)

    def projection(self) -> np.ndarray:
        """Columns that centred vectors are multiplied with; 0 for directions without spread."""
        return np.where(self.flat(), 0, self.vectors / np.sqrt(np.where(self.flat(), 1, self.values)))

    def centred(self, z: np.ndarray) -> np.ndarray:
        """x - S / n of rows x - middle."""
        return z - np.array([r / self.n for r in self.rest])


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all rows of ``vectors`` (one column of usable vectors of one length); None for an empty table.

    Over all rows, exact squares are summed of every dimension and of every sum of two dimensions, centred; the
    difference between the variance of a sum and those of its two dimensions is twice their covariance. Squares are
    taken of x less the whole part of its mean and corrected by what is left of the mean, so all numbers are whole.
    """
    first = vectors.toDF("v").limit(1).select(F.size("v")).collect()
    if not first or not first[0][0]:
        return None
    d = first[0][0]
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of more than {MOST_DIMENSIONS} entries")
    rows = vectors.toDF("v")
    added = rows.mapInArrow(_summer(d), "i int, total decimal(38,0)").groupBy("i").agg(F.sum("total").alias("total")).collect()
    n, *sums = [int(r.total) for r in sorted(added, key=lambda r: r.i)]
    middle, rest = [s // n for s in sums], [s % n for s in sums]
    squares = rows.mapInArrow(_squarer(d, middle), "i int, j int, total decimal(38,0)").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    # n^2 times the variance of a dimension doubled (i = j) or of a sum of two, as whole numbers
    spread = {(r.i, r.j): n * int(r.total) - (rest[r.i] + rest[r.j]) ** 2 for r in squares}
    covariance = np.zeros((d, d))
    for (i, j), both in spread.items():
        # the pair (i, i) is the dimension doubled, with four times its variance
        covariance[i, j] = covariance[j, i] = (4 * both - spread[i, i] - spread[j, j]) / (8 * n * n) if i != j else both / (4 * n * n)
    values, vectors_ = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    return Whitening(d, n, sums, covariance, values[order], vectors_[:, order])


def _crosser(w: Whitening):
    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, some = len(w.values), False
        sums, products = np.zeros(c), np.zeros((c, c))
        for b in batches:
            y = w.centred(whole(b.column(0), w.d) - np.array(w.middle)) @ w.projection()
            sums, products, some = sums + y.sum(0), products + y.T @ y, some or len(y) > 0
        if some:
            i, j = np.triu_indices(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(c, -1), i]), pa.int32()), pa.array(np.concatenate([np.arange(c), j]), pa.int32()),
                                              pa.array(np.concatenate([sums, products[i, j]]))], names=["i", "j", "total"])

    return cross


def identity_error(vectors: DataFrame, w: Whitening) -> float:
    """The largest entry of the covariance of all whitened rows less the identity; directions without spread are left out."""
    rows = vectors.toDF("v").mapInArrow(_crosser(w), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    found = {(r.i, r.j): r.total / w.n for r in rows}
    flat = w.flat()
    return max((abs(v - found[-1, i] * found[-1, j] - (i == j)) for (i, j), v in found.items() if i >= 0 and not flat[i] and not flat[j]), default=0.0)


def _applier(w: Whitening, error: float):
    def deviations(z: np.ndarray) -> pa.Array:
        rest = np.array(w.rest)
        if (int(np.abs(z).max(initial=0)) + 1) ** 2 * w.n**2 * w.d < 2**63:
            y = w.n * z - rest
            return pa.array((y * y).sum(1)).cast(WIDE)
        y = w.n * z.astype(object) - rest
        return _decimals([int(v) for v in (y * y).sum(1)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = len(w.values)
        trace = float(np.trace(w.covariance))
        share = w.values / trace if trace > 0 else np.zeros(c)
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                b = batch.slice(start, 2000)
                z = whole(b.column(1), w.d) - np.array(w.middle)
                y, m = w.centred(z) @ w.projection(), len(z)
                at = pa.array(np.repeat(np.arange(m), c))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(at), pa.array(np.tile(np.arange(1, c + 1), m), pa.int32()), pa.array(np.full(m * c, w.n)),
                    deviations(z).take(at), pa.array(y.ravel(), pa.float64(), mask=np.tile(w.flat(), m)),
                    pa.array(np.tile(share, m)), pa.array(np.full(m * c, error))], names=OUT)

    return apply


OUT = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
SCHEMA = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(table: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """A row for each usable vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Entries become the whole numbers x = floor(64 c) + 1000000. All usable vectors are fitted (``fit``); deviation is the exact sum
    over dimensions of (n x - S)^2, whitened the projection of x - S / n on a unit eigenvector over the root of its
    eigenvalue, explained the eigenvalue's share of the trace, identity_error one measured value for all rows.

    Vectors that are null or have null, NaN or infinite entries are dropped, and so are vectors of another length than
    most have (on a tie, the greater length). Null and repeated vec_ids keep a row each; other columns are ignored. In a
    direction without spread (an eigenvalue below 1e-12 of the largest; all directions for a single row) whitened is null. An empty
    table, or vectors without entries, give no rows. An entry beyond 2^62 / 64, or more than 1024 entries, is an error.
    """
    rows = table.select("vec_id", F.col(vector).alias("v")).where(usable(F.col("v")))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    rows = rows.where(F.size("v") == (most[0].d if most else 0))
    w = fit(rows.select("v"), components)
    if w is None:
        return table.sparkSession.createDataFrame([], SCHEMA)
    return rows.mapInArrow(_applier(w, identity_error(rows.select("v"), w)), SCHEMA)
