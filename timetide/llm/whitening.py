"""Whitening of embeddings by their principal components (operator 13).

Each task reads its vectors as a stream and keeps three things: their number, their mean and the sum of the outer products
of deviations, which every vector changes by a matrix of rank one (Welford). The tasks' moments are merged pairwise by the
parallel update formula, FAN of them in one task at a time, so that the driver gets FAN at most, each of a size set by the
dimensions. Sums are kept beside as integers, exactly. The covariance is solved on the driver (dimensions squared) by
Householder reflections to a tridiagonal matrix and implicit symmetric QR steps. A second pass takes the moments of the
whitened values, which tell how far they are from uncorrelated values of variance 1.

Cases: vectors that are null or hold a null, NaN or infinite entry are left out of the fit and of the result; repeated rows
count and come back as often as they are there, ids may be null or repeated; an empty table (or one without a usable
vector) gives no rows; a component without variance (one vector, equal vectors) is 0 everywhere, with 0 explained, and
counts as far from the identity by 1; vectors of several lengths raise an error, as do deviations beyond 64 bits; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Moments that one task merges.
FAN = 64
#: Components of the result.
COMPONENTS = 8
#: Entries become floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000

MOMENTS = "slot long, n long, sums array<long>, mean array<double>, products array<double>"


def vectors_of(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """id and x (integers) of the rows whose vector has finite entries only."""
    sound = F.forall(vector_column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    x = F.transform(vector_column, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(OFFSET).cast("long"))
    return rows.filter(F.col(vector_column).isNotNull() & sound).select(F.col(id_column).alias("id"), x.alias("x"))


def matrix_of(column: pa.ListArray) -> np.ndarray:
    """The lists of a column side by side; they have one length."""
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("the vectors have several lengths")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1)


@dataclass
class Moments:
    """Number, sums (integers where the values are), mean and products of deviations of some vectors."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    products: np.ndarray

    @classmethod
    def none(cls, dims: int, integers: bool) -> Moments:
        return cls(0, np.zeros(dims, np.int64 if integers else np.float64), np.zeros(dims), np.zeros((dims, dims)))

    def add(self, rows: np.ndarray) -> None:
        """Welford's step for each row."""
        self.sums += rows.sum(axis=0)
        n, mean, products = self.n, self.mean, self.products
        for x in rows.astype(np.float64):
            n += 1
            before = x - mean
            mean += before / n
            products += np.multiply.outer(before, x - mean)
        self.n = n

    def merged(self, other: Moments) -> Moments:
        """Both parts together, by the parallel update formula."""
        if len(self.mean) != len(other.mean):
            raise ValueError("the vectors have several lengths")
        n = self.n + other.n
        apart = other.mean - self.mean
        products = self.products + other.products + np.multiply.outer(apart, apart) * (self.n * other.n / n)
        return Moments(n, self.sums + other.sums, self.mean + apart * (other.n / n), (products + products.T) / 2)

    def row(self, slot: int, integers: bool) -> pa.RecordBatch:
        kind = pa.int64() if integers else pa.float64()
        columns = [pa.array([slot], pa.int64()), pa.array([self.n], pa.int64()), pa.array([self.sums], pa.list_(kind)), pa.array([self.mean], pa.list_(pa.float64())), pa.array([self.products.ravel()], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, ["slot", "n", "sums", "mean", "products"])

    @classmethod
    def of(cls, table: pa.Table) -> Moments | None:
        """The rows of a table of moments, merged in the order of their slots."""
        found = None
        for r in table.sort_by("slot").to_pylist():
            mean = np.array(r["mean"])
            part = cls(r["n"], np.array(r["sums"]), mean, np.array(r["products"]).reshape(len(mean), -1))
            found = part if found is None else found.merged(part)
        return found


def moments(vectors: DataFrame, column: str, integers: bool) -> Moments | None:
    """The moments of a column of vectors; None without any row."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            if batch.num_rows:
                rows = matrix_of(batch.column(column))
                own = own or Moments.none(rows.shape[1], integers)
                if rows.shape[1] != len(own.mean):
                    raise ValueError("the vectors have several lengths")
                own.add(rows)
        if own:
            yield own.row(TaskContext.get().partitionId(), integers)

    schema = MOMENTS if integers else MOMENTS.replace("sums array<long>", "sums array<double>")

    def merge(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([Moments.of(table).row(table.column("slot")[0].as_py() // FAN, integers)])

    parts = vectors.select(column)
    many = parts.rdd.getNumPartitions()
    found = parts.mapInArrow(stream, schema)
    while many > FAN:
        found = found.groupBy(F.expr(f"slot div {FAN}")).applyInArrow(merge, schema)
        many = -(-many // FAN)
    rows = found.toArrow()
    return Moments.of(rows)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and orthogonal q of a symmetric matrix = q t q', by Householder reflections."""
    a, n = matrix.copy(), len(matrix)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if not np.any(v[1:]):
            continue
        v[0] += size if v[0] >= 0 else -size
        v /= np.linalg.norm(v)
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return a.diagonal().copy(), a.diagonal(1).copy(), q


def symmetric_qr(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns; the entry of greatest size is positive) of a symmetric matrix."""
    d, e, q = tridiagonal(matrix)
    small = np.finfo(float).eps
    high = len(d) - 1
    while high > 0:
        # Parts of the matrix that nothing connects any more stand alone.
        if abs(e[high - 1]) <= small * (abs(d[high - 1]) + abs(d[high])):
            e[high - 1] = 0.0
            high -= 1
            continue
        low = high - 1
        while low > 0 and abs(e[low - 1]) > small * (abs(d[low - 1]) + abs(d[low])):
            low -= 1
        # Wilkinson's shift: the eigenvalue of the last two by two block that is nearer to its last entry.
        half = (d[high - 1] - d[high]) / 2
        shift = d[high] - e[high - 1] ** 2 / (half + np.copysign(np.hypot(half, e[high - 1]), half))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            a, b, f = d[k], d[k + 1], e[k]
            d[k] = c * c * a + 2 * c * s * f + s * s * b
            d[k + 1] = s * s * a - 2 * c * s * f + c * c * b
            e[k] = c * s * (b - a) + (c * c - s * s) * f
            if k + 1 < high:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            left = q[:, k].copy()
            q[:, k] = c * left + s * q[:, k + 1]
            q[:, k + 1] = c * q[:, k + 1] - s * left
    order = np.argsort(-d, kind="stable")
    d, q = d[order], q[:, order]
    if not len(d):
        return d, q
    at = np.abs(q).argmax(axis=0)
    return d, q * np.where(q[at, np.arange(len(d))] < 0, -1.0, 1.0)


@dataclass
class Whitening:
    """n vectors with their sums per dimension; components (rows, each divided by the root of its eigenvalue) and their shares."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    explained: np.ndarray

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whitened values (a row a vector), and exact sums of (n * x - sums)^2."""
        apart = x * np.int64(self.n) - self.sums
        most = int(np.abs(apart).max(initial=0))
        if most * most * max(x.shape[1], 1) < 1 << 63:
            deviation = (apart * apart).sum(axis=1)
        else:
            deviation = np.array([sum(v * v for v in row) for row in apart.tolist()], object)
        return (apart / self.n) @ self.components.T, deviation


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the vectors of `vectors_of`; None without any."""
    told = moments(vectors, "x", True)
    if told is None:
        return None
    values, q = symmetric_qr(told.products / told.n)
    trace, k = float(np.trace(told.products)) / told.n, min(components, len(values))
    values = np.where(values > len(values) * np.finfo(float).eps * max(trace, 0.0), values, 0.0)[:k]
    scaled = np.where(values > 0, q[:, :k] / np.sqrt(np.where(values > 0, values, 1.0)), 0.0).T
    return Whitening(told.n, told.sums, scaled, values / trace if trace > 0 else np.zeros(k))


def projected(vectors: DataFrame, model: Whitening) -> DataFrame:
    """id, deviation and whitened (array, a component an entry) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                whitened, deviation = model.apply(matrix_of(batch.column("x")))
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(whitened) + 1) * whitened.shape[1], pa.int32()), pa.array(whitened.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(deviation.tolist(), pa.int64()), values], ["id", "deviation", "whitened"])

    return vectors.mapInArrow(run, f"id {vectors.schema['id'].dataType.simpleString()}, deviation long, whitened array<double>")


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest entry, by size, of the covariance of the whitened values minus the identity, measured over all rows."""
    told = moments(rows, "whitened", False)
    return float(np.abs(told.products / told.n - np.eye(len(model.components))).max(initial=0.0))


def whiten(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: id, component (from 1 on), n, deviation, whitened, explained, identity_error."""
    vectors = vectors_of(rows, id_column, vector_column)
    model = fit(vectors, components)
    kind = vectors.schema["id"].dataType.simpleString()
    if model is None:
        return rows.sparkSession.createDataFrame([], f"{id_column} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    out = projected(vectors, model)
    error = identity_error(out, model)
    one = out.select("id", "deviation", F.posexplode("whitened").alias("at", "value"))
    share = F.get(F.array(*[F.lit(float(v)) for v in model.explained]), F.col("at"))
    return one.select(F.col("id").alias(id_column), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("value").alias("whitened"), share.alias("explained"), F.lit(error).alias("identity_error"))
