"""Whitening of embedding vectors: leading components by spectrum slicing of an exact covariance.

The project's records hold no vectors, so the operator is general: any table with a key and
a column of number arrays.

Spark makes the fit list (distinct vectors), its sums and its centred products; these are
exact integers, so the result does not depend on how the rows were dealt.  The driver holds
one dims x dims matrix.  Counts of positive pivots of LDL' factors of shifted covariances
isolate each leading eigenvalue, Rayleigh quotient iteration finds it, and two more counts
on either side certify its number.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from fairlead.llm.common import column, field, map_batches
from fairlead.session import stage

# Vectors of a batch are multiplied in runs of this many, whose sums of products stay exact in doubles.
RUN = 4096
_EXACT = 1 << 20
# Components below this share of the trace are numerically no components: they are left out.
LEAST_SHARE = 1e-11
_ALPHA = (1 + 17 ** 0.5) / 8  # fixed value: the bound of growth of 1x1 and 2x2 pivots


# --- spectrum -----------------------------------------------------------------------------------


def positive_pivots(matrix: np.ndarray) -> int:
    """Number of positive eigenvalues, by the inertia of an LDL' factorization with 1x1 and 2x2 pivots."""
    a = np.array(matrix, float)
    positive, n = 0, len(a)
    while n:
        diagonal = np.abs(np.diagonal(a))
        size = np.abs(a)
        largest = size.max()
        if largest == 0:
            break
        r = int(diagonal.argmax())
        if diagonal[r] >= _ALPHA * largest:
            positive += a[r, r] > 0
            keep = np.delete(np.arange(n), r)
            a = a[np.ix_(keep, keep)] - np.outer(a[keep, r], a[r, keep] / a[r, r])
        else:  # such a pivot block is indefinite: one positive, one negative eigenvalue
            np.fill_diagonal(size, 0)
            r, s = np.unravel_index(int(size.argmax()), size.shape)
            positive += 1
            keep = np.delete(np.arange(n), [r, s])
            block = a[np.ix_([r, s], [r, s])]
            a = a[np.ix_(keep, keep)] - a[np.ix_(keep, [r, s])] @ np.linalg.solve(block, a[np.ix_([r, s], keep)])
        n = len(a)
    return positive


class _Slices:
    """Counts of eigenvalues above shifts, kept and used again for every component."""

    def __init__(self, matrix: np.ndarray, bound: float):
        self.matrix, self.eye = matrix, np.eye(len(matrix))
        self.counts = {-bound: len(matrix), bound: 0}

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = positive_pivots(self.matrix - shift * self.eye)
        return self.counts[shift]

    def bracket(self, number: int) -> tuple[float, float]:
        low = max(s for s, c in self.counts.items() if c >= number)
        return low, min(s for s, c in self.counts.items() if c < number and s > low)


def _improve(matrix: np.ndarray, start: np.ndarray, shift: float, known: list[np.ndarray], small: float, fixed: int) -> tuple[float, np.ndarray, float]:
    """Inverse iteration at ``shift``, then with the Rayleigh quotient as the shift: value, vector, residual."""
    eye, v, best = np.eye(len(matrix)), start, None
    for turn in range(fixed + 12):
        try:
            w = np.linalg.solve(matrix - shift * eye, v)
        except np.linalg.LinAlgError:
            w = np.linalg.solve(matrix - (shift + small) * eye, v)
        for _ in range(2):
            for u in known:
                w = w - (u @ w) * u
        v = w / np.linalg.norm(w)
        value = float(v @ matrix @ v)
        residual = float(np.linalg.norm(matrix @ v - value * v))
        if turn >= fixed:
            if best is None or residual < best[2]:
                best = value, v, residual
            elif best[2] <= 16 * small:
                break
        if turn + 1 >= fixed:
            shift = value
    return best


def leading_components(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues, falling, and unit eigenvectors (columns) of a covariance matrix.

    Equal eigenvalues get an orthonormal basis of their space.  Raises ArithmeticError if a
    number cannot be certified.
    """
    d, trace = len(matrix), float(np.trace(matrix))
    if not d or trace <= 0:
        return np.zeros(0), np.zeros((d, 0))
    small = np.finfo(float).eps * trace
    slices, values, vectors = _Slices(matrix, 1.01 * trace), [], []
    draw = np.random.default_rng(0)
    for number in range(1, min(most, d) + 1):
        width = 0.05
        while True:
            low, high = slices.bracket(number)
            isolated = slices.above(low) == number and slices.above(high) == number - 1
            if high - low > 4 * small and not (isolated and high - low <= width * max(high, small)):
                slices.above((low + high) / 2)
                continue
            value, vector, residual = _improve(matrix, draw.standard_normal(d), (low + high) / 2, vectors, small, 3)
            if low - 8 * small <= value <= high + 8 * small or high - low <= 4 * small:
                break
            width /= 16
        if value <= LEAST_SHARE * trace:
            break
        reach = max(2 * residual, 8 * d * small)
        if slices.above(value + reach) >= number or slices.above(value - reach) < number:
            raise ArithmeticError(f"component {number} could not be certified")
        values.append(value)
        vectors.append(vector)
    return np.array(values), np.array(vectors).reshape(len(values), d).T


# --- vectors on Spark ------------------------------------------------------------------------------


def _quantised(rows: DataFrame, scale: int, offset: int) -> DataFrame:
    """key, dims, x of the rows whose vectors hold finite numbers only.

    x is the integer vector as bytes, 4 a number where all fit, else 8: equal vectors have
    equal bytes.
    """
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), field("dims", "int"), field("x", "binary")])

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            numbers = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            with np.errstate(invalid="ignore", over="ignore"):
                scaled = numbers * scale
                bad = ~(np.abs(scaled) < float(1 << 53))
            of = np.repeat(np.arange(len(lengths)), lengths)
            usable = (np.bincount(of[bad], minlength=len(lengths)) == 0) & lists.is_valid().to_numpy(zero_copy_only=False)
            x = np.floor(np.where(bad, 0, scaled)).astype(np.int64) + offset
            wide = np.bincount(of[(x >= 1 << 31) | (x < -(1 << 31))], minlength=len(lengths)) > 0
            ends = np.cumsum(lengths)
            narrow = x.astype("<i4")
            rows_kept = np.flatnonzero(usable)
            data = [(x if wide[i] else narrow)[ends[i] - lengths[i]:ends[i]].tobytes() for i in rows_kept]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows_kept)), pa.array(lengths[rows_kept].astype(np.int32)), pa.array(data, pa.binary()),
            ], names=["key", "dims", "x"])

    return map_batches(rows, run, schema)


def _vectors(data: pa.Array, dims: int) -> np.ndarray:
    """Integer vectors of a batch, a row each."""
    values = data.to_pylist()
    if all(len(v) == 4 * dims for v in values):
        return np.frombuffer(b"".join(values), "<i4").reshape(len(values), dims).astype(np.int64)
    return np.array([np.frombuffer(v, "<i4" if len(v) == 4 * dims else "<i8") for v in values], np.int64).reshape(len(values), dims)


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension."""
    schema = T.StructType([field("place", "int"), field("total", "decimal(38,0)")])

    def run(batches):
        count, sums = 0, np.zeros(dims, object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column(0), dims)
            count += len(x)
            sums = sums + (x.sum(axis=0) if abs(x).max(initial=0) < 1 << 40 else x.astype(object).sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dims, dtype=np.int32)), _decimals([count, *sums])], names=["place", "total"])

    found = dict(map(tuple, map_batches(fit.select("x"), run, schema).groupBy("place").agg(F.sum("total")).collect()))
    return int(found.get(-1, 0)), [int(found.get(i, 0)) for i in range(dims)]


def _products(fit: DataFrame, centre: list[int], dims: int) -> np.ndarray:
    """Exact sums of products of the vectors less an integer centre; the upper triangle is summed by Spark."""
    middle = np.array(centre, np.int64)
    upper = np.triu_indices(dims)
    schema = T.StructType([field("i", "int"), field("j", "int"), field("total", "decimal(38,0)")])

    def run(batches):
        sums = np.zeros((dims, dims), object)
        for batch in batches:
            for at in range(0, batch.num_rows, RUN):
                d = _vectors(batch.column(0).slice(at, RUN), dims) - middle
                if abs(d).max(initial=0) <= _EXACT:
                    d = d.astype(float)
                    sums = sums + (d.T @ d).astype(np.int64)
                else:
                    d = d.astype(object)
                    sums = sums + d.T @ d
        yield pa.RecordBatch.from_arrays([
            pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), _decimals(sums[upper]),
        ], names=["i", "j", "total"])

    out = np.zeros((dims, dims), object)
    for i, j, total in map_batches(fit.select("x"), run, schema).groupBy("i", "j").agg(F.sum("total")).collect():
        out[i, j] = out[j, i] = int(total)
    return out


def whitened_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16, scale: int = 64, offset: int = 1_000_000
) -> DataFrame:
    """Each vector's coordinates along the leading components, scaled to unit variance.

    An entry c counts as the integer floor(scale * c) + offset.  The fit list is each
    distinct integer vector once; mean and covariance (divisor n, centred first) are its.
    One row per vector and component: key, component (from 1, by falling eigenvalue), n
    (length of the fit list), deviation (sum over dimensions of (n * x - S)^2; null beyond a
    long), whitened, explained (the eigenvalue's share of the trace), identity_error (largest
    absolute entry of the covariance of whitened over the fit list, less the identity).

    A null vector, or one with a null, non-finite or too large entry (2^53 / scale), gives no
    rows; nor do vectors of another length than most have (the longer one if two are as
    frequent).  Components below LEAST_SHARE of the trace are left out, so equal vectors
    alone, or an empty table, give no rows.  Null keys, repeated keys and repeated rows
    are kept; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(column(key).alias("key"), column(vector).cast("array<double>").alias("v"))
    kept = stage(_quantised(rows, scale, offset), "integer-vectors")
    schema = T.StructType([
        T.StructField(key, kept.schema["key"].dataType), field("component", "int"), field("n", "bigint"), field("deviation", "bigint"),
        field("whitened", "double"), field("explained", "double"), field("identity_error", "double"),
    ])
    most = kept.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = most["dims"] if most else 0
    kept = kept.filter(F.col("dims") == dims).select("key", "x")
    fit = stage(kept.select("x").distinct(), "fit-vectors")
    n, sums = _sums(fit, dims)
    if not n or not dims:
        return spark.createDataFrame([], schema)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, centre)]  # n times what the integer centre leaves of the mean
    products = _products(fit, centre, dims)
    # int / int is correctly rounded: the covariance is exact up to its last bit.
    covariance = np.array([[(n * products[i, j] - rest[i] * rest[j]) / (n * n) for j in range(dims)] for i in range(dims)])
    values, axes = leading_components(covariance, components)
    if not len(values):
        return spark.createDataFrame([], schema)
    middle, remainder = np.array(centre, np.int64), np.array([r / n for r in rest])
    turn = axes / np.sqrt(values)
    found = len(values)
    explained = values / sum(covariance[i, i] for i in range(dims))

    def project(d: np.ndarray) -> np.ndarray:
        return (d - remainder) @ turn

    def squares(batches):
        total = np.zeros((found, found))
        for batch in batches:
            if batch.num_rows:
                z = project(_vectors(batch.column(0), dims) - middle)
                total += z.T @ z
        i, j = np.divmod(np.arange(found * found, dtype=np.int32), np.int32(found))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "total"])

    measured = np.zeros((found, found))
    square = T.StructType([field("i", "int"), field("j", "int"), field("total", "double")])
    for i, j, total in map_batches(fit.select("x"), squares, square).groupBy("i", "j").agg(F.sum("total")).collect():
        measured[i, j] = total / n
    error = float(np.abs(measured - np.eye(found)).max())

    def deviations(d: np.ndarray) -> pa.Array:
        if dims * (n * (int(abs(d).max(initial=0)) + 1)) ** 2 < 1 << 63:
            return pa.array(((n * d - np.array(rest, np.int64)) ** 2).sum(axis=1))
        exact = ((n * d.astype(object) - np.array(rest, object)) ** 2).sum(axis=1)
        return pa.array([int(v) if v < 1 << 63 else None for v in exact], pa.int64())

    def whiten(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, RUN):
                part = batch.slice(at, RUN)
                d = _vectors(part.column(1), dims) - middle
                each = pa.array(np.repeat(np.arange(len(d)), found))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(each), pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), len(d))),
                    pa.array(np.full(len(each), n)), deviations(d).take(each), pa.array(project(d).ravel()),
                    pa.array(np.tile(explained, len(d))), pa.array(np.full(len(each), error)),
                ], names=schema.names)

    return map_batches(kept, whiten, schema)
