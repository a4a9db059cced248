"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

1. Entries are put on an integer grid, ``floor(scale * c) + offset``. Tasks count rows and sum
   the grid's numbers and their products exactly: a block of rows is multiplied in floating
   point only while no sum can pass 2^53. So the scatter matrix does not depend on
   how rows are dealt to tasks, and centring it loses nothing: n * sum(x y) - sum(x) * sum(y) are
   whole numbers. Spark adds the parts of all tasks, one key per pair of dimensions.
2. The driver, which sees one number per pair of dimensions and nothing that grows with the
   rows, factors the centred scatter by Cholesky with pivoting and applies Jacobi rotations to
   the columns of the triangular factor, until all are orthogonal. Their squared norms are the eigenvalues,
   the normalised columns the components; a rank below the dimension shows as pivots that are zero.
3. Tasks project the centred rows. A second pass over the rows measures the covariance of
   what they give, a third one returns it.

Defined results: rows whose vector is null, empty, or holds a null, a non-finite entry or one
whose grid number needs more than 52 bits are dropped, as are vectors of another length than
most (of two lengths equally frequent, the greater counts). Repeated rows are rows of their own.
Components with no variance cannot be whitened and are not returned, so one row alone or an empty
table gives an empty result. A deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curveframe.llm.common import neutral, without

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
BLOCK_ROWS = 4096
EXACT = 1 << 53  # whole numbers up to here are exact in floating point
GRID = 1 << 52  # grid numbers stay below, so that their halves have exact products
HALF = 26
MOST_SWEEPS = 60
RESULT = "n bigint, deviation bigint, whitened array<double>"


def on_grid(vectors: Column, scale: int = SCALE) -> Column:
    """Grid numbers without the offset; null where the vector has none."""
    numbers = F.transform(vectors, lambda c: F.floor(c.cast("double") * scale))
    fits = F.forall(vectors, lambda c: F.coalesce(F.abs(c.cast("double") * scale) < float(GRID), F.lit(False)))
    return F.when(fits & (F.size(vectors) > 0), numbers)


@dataclass
class Whitening:
    """Sums of a fit list and the projection made from them; ``sums`` are without the offset."""

    count: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(value) / self.trace for value in self.eigenvalues]


def _blocks(batches: Iterator[pa.RecordBatch], column: str, dimensions: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(start, BLOCK_ROWS)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def exact_products(grid: np.ndarray) -> np.ndarray:
    """The products of all pairs of columns, summed over rows, as Python integers."""
    most = int(np.abs(grid).max(initial=0))
    if most * most >= EXACT:
        # High and low halves of each number: their products are exact one row at a time, or in short blocks.
        high = grid >> HALF
        low = grid - (high << HALF)
        cross = _product(high, low)
        return (_product(high, high) << 2 * HALF) + ((cross + cross.T) << HALF) + _product(low, low)
    return _product(grid, grid)


def _product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    most = int(np.abs(left).max(initial=0)) * int(np.abs(right).max(initial=0))
    rows = max(1, min(len(left), (EXACT - 1) // max(most, 1)))
    total = np.zeros((left.shape[1], right.shape[1]), dtype=object)
    held = np.zeros(total.shape, dtype=np.int64)
    for number, start in enumerate(range(0, len(left), rows)):
        part = left[start : start + rows].astype(np.float64).T @ right[start : start + rows].astype(np.float64)
        held += part.astype(np.int64)
        if number % 512 == 511:
            total, held = total + held, np.zeros_like(held)
    return total + held


def _sum_up(column: str, dimensions: int):
    """Rows (i, j, value) of a task: products of dimensions i <= j, their sums under i = -1, the count under -1, -1."""
    upper = np.triu_indices(dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, products = 0, np.zeros((dimensions, dimensions), dtype=object)
        sums = np.zeros(dimensions, dtype=object)
        for _, grid in _blocks(batches, column, dimensions):
            count += len(grid)
            high = grid >> HALF
            sums = sums + (high.sum(axis=0).astype(object) << HALF) + (grid - (high << HALF)).sum(axis=0).astype(object)
            products = products + exact_products(grid)
        if count:
            first = [-1, *[-1] * dimensions, *upper[0].tolist()]
            second = [-1, *range(dimensions), *upper[1].tolist()]
            values = [count, *sums.tolist(), *products[upper].tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array([str(value) for value in values])], ["i", "j", "value"]
            )

    return run


def pivoted_cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factor L (rank columns) and order of pivots with ``matrix[order][:, order] = L @ L.T``."""
    rest = matrix.copy()
    size = len(rest)
    order = np.arange(size)
    factor = np.zeros((size, size))
    # Of a pivot below this, rounding has left no digit.
    least = size * np.finfo(float).eps * float(rest.diagonal().max(initial=0.0))
    for step in range(size):
        pivot = step + int(np.argmax(rest.diagonal()[step:]))
        if rest[pivot, pivot] <= least:
            return factor[:, :step], order
        for rows in (rest, factor):
            rows[[step, pivot]] = rows[[pivot, step]]
        rest[:, [step, pivot]] = rest[:, [pivot, step]]
        order[[step, pivot]] = order[[pivot, step]]
        factor[step, step] = np.sqrt(rest[step, step])
        factor[step + 1 :, step] = rest[step + 1 :, step] / factor[step, step]
        rest[step + 1 :, step + 1 :] -= np.outer(factor[step + 1 :, step], factor[step + 1 :, step])
    return factor, order


def _rounds(size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of columns, in rounds of pairs that share no column (a round-robin tournament)."""
    players = list(range(size + size % 2))
    out = []
    for _ in range(max(len(players) - 1, 0)):
        half = len(players) // 2
        pairs = [(min(a, b), max(a, b)) for a, b in zip(players[:half], reversed(players[half:]), strict=True) if max(a, b) < size]
        out.append((np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int)))
        players = [players[0], players[-1], *players[1:-1]]
    return out


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """``factor`` times a rotation that makes its columns orthogonal to working precision."""
    columns = factor.copy()
    rounds = _rounds(columns.shape[1])
    for _ in range(MOST_SWEEPS):
        turned = False
        for first, second in rounds:
            a, b = columns[:, first], columns[:, second]
            aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            skew = np.abs(ab) > np.finfo(float).eps * np.sqrt(aa * bb)
            if not skew.any():
                continue
            turned = True
            a, b, aa, bb, ab = a[:, skew], b[:, skew], aa[skew], bb[skew], ab[skew]
            zeta = (bb - aa) / (2.0 * ab)
            tangent = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cosine = 1.0 / np.hypot(1.0, tangent)
            sine = cosine * tangent
            columns[:, first[skew]], columns[:, second[skew]] = cosine * a - sine * b, sine * a + cosine * b
        if not turned:
            break
    return columns


def eigen(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a covariance above zero, falling, and their unit eigenvectors as columns."""
    factor, order = pivoted_cholesky(covariance)
    columns = np.zeros_like(factor)
    columns[order] = one_sided_jacobi(factor)
    values = (columns * columns).sum(axis=0)
    rank = np.argsort(-values, kind="stable")
    return values[rank], columns[:, rank] / np.sqrt(values[rank])


def fit(vectors: DataFrame, column: str, dimensions: int, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of grid vectors of one length; None where nothing varies."""
    parts = vectors.select(column).mapInArrow(_sum_up(column, dimensions), "i int, j int, value string")
    sums = parts.groupBy("i", "j").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    found = {(row["i"], row["j"]): int(row["value"]) for row in sums.collect()}
    count = found.get((-1, -1), 0)
    if not count:
        return None
    total = [found[-1, j] for j in range(dimensions)]
    covariance = np.empty((dimensions, dimensions))
    for i in range(dimensions):
        for j in range(i, dimensions):
            covariance[i, j] = covariance[j, i] = (count * found[i, j] - total[i] * total[j]) / (count * count)
    values, axes = eigen(covariance)
    if not len(values):
        return None
    return Whitening(count, total, axes[:, :components], values[:components], float(np.trace(covariance)))


def _centred(grid: np.ndarray, model: Whitening) -> np.ndarray:
    """n * x - S, in 64 bits if that holds all of them, else as Python integers."""
    bound = model.count * int(np.abs(grid).max(initial=0)) + max(map(abs, model.sums))
    kind = np.int64 if bound < 1 << 62 else object
    return grid.astype(kind) * model.count - np.array(model.sums, dtype=kind)


def _projected(centred: np.ndarray, model: Whitening) -> np.ndarray:
    return (centred / model.count).astype(np.float64) @ (model.components / np.sqrt(model.eigenvalues))


def _deviations(centred: np.ndarray) -> list[int | None]:
    if centred.dtype != object and int(np.abs(centred).max(initial=0)) ** 2 * centred.shape[1] < 1 << 62:
        return (centred * centred).sum(axis=1).tolist()
    sums = [sum(value * value for value in row) for row in centred.astype(object).tolist()]
    return [value if value < 1 << 63 else None for value in sums]


def _covary(column: str, dimensions: int, model: Whitening):
    """Rows (i, j, value) of a task: sums of products of whitened components i <= j, and their sums under i = -1."""
    size = len(model.eigenvalues)
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((size, size)), np.zeros(size)
        for _, grid in _blocks(batches, column, dimensions):
            found = _projected(_centred(grid, model), model)
            products += found.T @ found
            sums += found.sum(axis=0)
        first, second = [*[-1] * size, *upper[0].tolist()], [*range(size), *upper[1].tolist()]
        values = [*sums.tolist(), *products[upper].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array(values)], ["i", "j", "value"])

    return run


def identity_error(vectors: DataFrame, column: str, dimensions: int, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity, as they come out."""
    parts = vectors.select(column).mapInArrow(_covary(column, dimensions, model), "i int, j int, value double")
    sums = parts.groupBy("i", "j").agg(F.sum(F.col("value").cast("decimal(38,15)")).cast("double").alias("value"))
    found = {(row["i"], row["j"]): row["value"] / model.count for row in sums.collect()}
    pairs = [(i, j) for i, j in found if i >= 0]
    # Rows were centred before they were projected, so the means are rounding errors.
    return max(abs(found[i, j] - found[-1, i] * found[-1, j] - (i == j)) for i, j in pairs)


def _project(column: str, keep: list[str], dimensions: int, model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, grid in _blocks(batches, column, dimensions):
            centred = _centred(grid, model)
            found = _projected(centred, model)
            ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
            added = [
                pa.array(np.full(len(found), model.count), pa.int64()),
                pa.array(_deviations(centred), pa.int64()),
                pa.ListArray.from_arrays(ends, pa.array(found.reshape(-1))),
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(name) for name in keep], *added], [*keep, "n", "deviation", "whitened"])

    return run


def whiten(
    rows: DataFrame,
    vector_column: str = "embedding",
    components: int = COMPONENTS,
    scale: int = SCALE,
) -> tuple[DataFrame, Whitening | None, float]:
    """Rows with n, deviation and ``whitened`` (one number per component) in place of the vector; the fit; its identity error.

    The offset of the grid cancels in all of these, so sums and products are taken without it.
    """
    own = T.StructType.fromDDL(RESULT)
    named, names = neutral(without(rows, own.names))
    vectors = names[vector_column]
    keep = [new for new in names.values() if new != vectors]
    kept = {old: new for old, new in names.items() if new != vectors}
    grid = named.withColumn(vectors, on_grid(F.col(vectors), scale)).where(F.col(vectors).isNotNull())
    size = F.size(vectors)
    lengths = grid.groupBy(size.alias("length")).count().orderBy(F.desc("count"), F.desc("length"))
    usual = lengths.first()
    dimensions = usual["length"] if usual else 1
    grid = grid.where(size == dimensions)
    model = fit(grid, vectors, dimensions, components) if usual else None
    schema = T.StructType([*[named.schema[new] for new in keep], *own.fields])
    if model is None:
        empty = grid.where(F.lit(False)).select(*keep, *[F.lit(None).cast(field.dataType).alias(field.name) for field in own.fields])
        return empty.toDF(*kept, *own.names), None, 0.0
    error = identity_error(grid, vectors, dimensions, model)
    found = grid.select(*keep, vectors).mapInArrow(_project(vectors, keep, dimensions, model), schema)
    return found.toDF(*kept, *own.names), model, error
