"""Singular value decompositions and proper orthogonal decomposition of snapshot tables (one array per snapshot).

Work over the rows runs in Spark (Gram sums, local QR factors, projections); the driver only sees matrices as
wide as a row. Where snapshots are wider than there are snapshots, take the states as rows (one array over all snapshots
for each state, see ``matrix.rows_of``): ``svd_dual`` then works on a table as wide as the number of snapshots.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapforge.functions.matrix import as_matrix, dense, fix_signs, gram, matmul, rows_of, table_of, to_long
from snapforge.sources.folders import write_table


#: Sparse rows that are multiplied together: each of their cells is a row of numbers then.
ROWS = 512


@dataclass(frozen=True)
class Decomposition:
    """Singular values in descending order and the basis, one column per value."""

    sigma: np.ndarray
    basis: np.ndarray
    mean: np.ndarray | None = None

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, float(s)) for k, s in enumerate(self.sigma)], "k int, sigma double")

    def basis_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, k, float(v)) for (i, k), v in np.ndenumerate(self.basis)], "i int, k int, v double")


def truncation_rank(sigma: np.ndarray, rank: int | None = None, tol: float | None = None) -> int:
    """``rank`` if given; else the fewest values whose energy reaches 1 - tol; else all."""
    if rank is not None:
        return min(rank, len(sigma))
    if tol is None or not len(sigma) or not (sigma**2).sum():
        return len(sigma)
    reached = np.flatnonzero(np.cumsum(sigma**2) / (sigma**2).sum() >= 1 - tol)
    return int(reached[0]) + 1 if len(reached) else len(sigma)


def truncate(spectrum: DataFrame, tol: float, sigma: str = "sigma", tie: str = "k") -> DataFrame:
    """The spectrum's leading part that holds 1 - tol of the energy, with the cumulative share."""
    down = Window.orderBy(F.desc(sigma), tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    square = F.col(sigma) * F.col(sigma)
    energy = spectrum.withColumn("energy", F.sum(square).over(down) / F.sum(square).over(whole))
    before = F.coalesce(F.lag("energy").over(Window.orderBy(F.desc(sigma), tie)), F.lit(0.0))
    return energy.withColumn("_before", before).filter(F.col("_before") < 1 - tol).drop("_before")


def svd_gram(rows: DataFrame, vec: str, rank: int | None = None, tol: float | None = None, center: bool = False) -> Decomposition:
    """Method of snapshots: eigenvalues of the Gram matrix. Values under about 1e-8 of the largest are noise; see svd_tsqr.

    Centring takes two passes, the mean first, so spreads far below the mean's size are kept.
    """
    mean = column_mean(rows, vec)[1] if center else None
    g = dense(gram(rows, vec, centre=mean))
    values, vectors = np.linalg.eigh(g)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    keep = values > values.max(initial=0) * len(values) * np.finfo(float).eps
    sigma = np.sqrt(values[keep])
    r = truncation_rank(sigma, rank, tol)
    return Decomposition(sigma[:r], fix_signs(vectors[:, keep][:, :r]), mean)


def column_mean(rows: DataFrame, vec: str) -> tuple[int, np.ndarray]:
    parts = rows.select(F.posexplode(vec).alias("j", "v")).groupBy("j").agg(F.avg(F.col("v").cast("double")).alias("m"), F.count(F.lit(1)).alias("n")).orderBy("j").collect()
    return (parts[0]["n"] if parts else 0), np.array([p["m"] for p in parts])


def _local_qr(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    r = None
    for batch in batches:
        column = batch.column(0)
        if len(column):
            x = as_matrix(column)
            r = np.linalg.qr(x if r is None else np.vstack([r, x]), mode="r")
    if r is not None:
        yield pa.RecordBatch.from_arrays([pa.array(list(r), pa.list_(pa.float64()))], ["vec"])


def triangle(rows: DataFrame, vec: str, fan_in: int = 16) -> np.ndarray:
    """R of the rows' QR decomposition: each task reduces its rows to a triangle, and triangles are stacked in rounds."""
    triangles = rows.filter(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("vec")).mapInArrow(_local_qr, "vec array<double>")
    parts = triangles.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // fan_in)
        triangles = triangles.repartition(parts).mapInArrow(_local_qr, "vec array<double>")
    found = [row["vec"] for row in triangles.collect()]  # at most as many rows as columns
    return np.array(found) if found else np.zeros((0, 0))


def svd_tsqr(rows: DataFrame, vec: str, rank: int | None = None, tol: float | None = None, fan_in: int = 16) -> Decomposition:
    """Tall-skinny QR, then the decomposition of the triangle.

    Small singular values keep their accuracy, as no Gram matrix squares them.
    """
    r = triangle(rows, vec, fan_in)
    if not r.size:
        return Decomposition(np.zeros(0), np.zeros((0, 0)))
    _, sigma, vt = np.linalg.svd(r, full_matrices=False)
    k = truncation_rank(sigma, rank, tol)
    return Decomposition(sigma[:k], fix_signs(vt[:k].T))


def orthogonalise(rows: DataFrame, row_id: str, vec: str) -> DataFrame:
    """(id, vec) of Q in X = Q R, for rows that together have full column rank; others are an error."""
    r = triangle(rows, vec)
    if not r.size:
        return rows.filter(F.col(vec).isNotNull()).select(row_id, F.col(vec).cast("array<double>").alias(vec))
    r = r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]
    if r.shape[0] < r.shape[1] or np.abs(np.diag(r)).min() <= np.abs(np.diag(r)).max() * len(r) * np.finfo(float).eps:
        raise ValueError("the columns are linearly dependent")
    return times(rows, row_id, vec, np.linalg.inv(r))


def times(rows: DataFrame, row_id: str, vec: str, right: np.ndarray) -> DataFrame:
    """(id, vec): each row times a small matrix, which is sent along with the task. Null vectors are left out."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch.column(1)):
                product = as_matrix(batch.column(1)) @ right
                offsets = np.arange(0, product.size + 1, max(product.shape[1], 1))[: len(product) + 1]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(product.ravel()))], [row_id, vec])

    wanted = rows.filter(F.col(vec).isNotNull()).select(row_id, F.col(vec).cast("array<double>").alias(vec))
    return wanted.mapInArrow(apply, wanted.schema)


def left_factor(rows: DataFrame, row_id: str, vec: str, found: Decomposition) -> DataFrame:
    """(id, vec): the rows of U, so that X - mean = U S V^T up to what was truncated."""
    shift = np.zeros(len(found.basis)) if found.mean is None else found.mean
    centred = rows if found.mean is None else rows.withColumn(vec, F.zip_with(vec, F.array(*[F.lit(float(m)) for m in shift]), lambda x, m: x.cast("double") - m))
    return times(centred, row_id, vec, found.basis / found.sigma)


def reconstruct(coefficients: DataFrame, row_id: str, vec: str, found: Decomposition, scaled: bool = True, add_mean: bool = False) -> DataFrame:
    """(id, vec) from the rows of U (``scaled``: to be multiplied by the singular values first) or of coefficients."""
    weights = found.sigma if scaled else np.ones(len(found.sigma))
    out = times(coefficients, row_id, vec, weights[:, None] * found.basis.T)
    if add_mean and found.mean is not None:
        out = out.withColumn(vec, F.zip_with(vec, F.array(*[F.lit(float(m)) for m in found.mean]), lambda x, m: x + m))
    return out


def svd_dual(states: DataFrame, row_id: str, vec: str, rank: int | None = None, tol: float | None = None, product: DataFrame | None = None) -> tuple[Decomposition, DataFrame]:
    """Method of snapshots for wide states: sigma and V (on the driver, as many rows as snapshots), and (id, vec) of U.

    ``states`` holds one array over all snapshots for each state, any number of them. ``product`` (i, j, v) is a
    symmetric positive inner product of states: then U is orthonormal in it (U^T M U = I), with X = U S V^T.
    """
    if product is None:
        k = dense(gram(states, vec))
    else:
        width = states.select(F.max(F.size(vec)).alias("n")).first()["n"] or 0
        moved = rows_of(matmul(product, to_long(states, row_id, vec)), width).select(F.col("i").alias("_i"), F.col("vec").alias("_moved"))
        k = dense(gram(states.select(row_id, F.col(vec)).join(moved, F.col(row_id).cast("long") == F.col("_i")), vec, "_moved"))
    values, vectors = np.linalg.eigh((k + k.T) / 2)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    keep = values > values.max(initial=0) * max(len(values), 1) * np.finfo(float).eps
    sigma = np.sqrt(values[keep])
    r = truncation_rank(sigma, rank, tol)
    found = Decomposition(sigma[:r], fix_signs(vectors[:, keep][:, :r]))
    return found, left_factor(states, row_id, vec, found)


def fold(found: Decomposition | None, more: np.ndarray, rank: int | None = None, variant: str = "standard") -> Decomposition:
    """The decomposition of all rows so far and of a batch, which comes as its triangle (see ``triangle``).

    ``standard`` decomposes S V^T and the batch together; ``brand`` splits the batch into its part in V and a residual
    with an orthonormal basis of its own, and decomposes the small core; ``fast`` drops the residual and leaves V as it
    is, so only sigma changes and drifts with every further batch. Without truncation, standard and brand are exact.
    """
    if found is None or not found.sigma.size:
        _, sigma, vt = np.linalg.svd(more, full_matrices=False) if more.size else (None, np.zeros(0), np.zeros((0, more.shape[1])))
        k = truncation_rank(sigma, rank)
        return Decomposition(sigma[:k], fix_signs(vt[:k].T))
    if not more.size:
        return found
    s, v = np.diag(found.sigma), found.basis
    inner = more @ v
    if variant == "fast":
        return Decomposition(np.linalg.svd(np.vstack([s, inner]), compute_uv=False)[: len(found.sigma)], v)
    if variant == "standard":
        core, outer = np.vstack([s @ v.T, more]), np.eye(len(v))
    elif variant == "brand":
        q, r = np.linalg.qr((more - inner @ v.T).T)
        core, outer = np.block([[s, np.zeros((len(s), r.shape[0]))], [inner, r.T]]), np.hstack([v, q])
    else:
        raise ValueError("variant must be standard, brand or fast")
    _, sigma, vt = np.linalg.svd(core, full_matrices=False)
    kept = min(truncation_rank(sigma, rank), len(v), int((sigma > sigma.max(initial=0) * len(v) * np.finfo(float).eps).sum()))
    return Decomposition(sigma[:kept], fix_signs(outer @ vt[:kept].T))


def svd_incremental(batches: Iterable[DataFrame], vec: str, rank: int | None = None, variant: str = "standard") -> Decomposition:
    """Batch after batch: each is reduced by Spark to a triangle, and only that is folded in."""
    found = None
    for batch in batches:
        found = fold(found, triangle(batch, vec), rank, variant)
    return found if found is not None else Decomposition(np.zeros(0), np.zeros((0, 0)))


def svd_randomized(rows: DataFrame, vec: str, rank: int, oversampling: int = 10, iterations: int = 2, seed: int = 0) -> Decomposition:
    """Randomised range finder on the row space: each power pass adds up X^T (X W) over the rows, in W's few columns."""
    vectors = rows.filter(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("vec"))
    first = vectors.select(F.size("vec").alias("n")).first()
    if first is None:
        return Decomposition(np.zeros(0), np.zeros((0, 0)))

    def apply_to(w: np.ndarray) -> np.ndarray:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(w.shape)
            for batch in batches:
                if len(batch.column(0)):
                    x = as_matrix(batch.column(0))
                    total += x.T @ (x @ w)
            yield table_of(total)

        return dense(vectors.mapInArrow(partial, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v")))

    return _power(apply_to, first["n"], rank, oversampling, iterations, seed)


def _power(apply_to: Callable[[np.ndarray], np.ndarray], n: int, rank: int, oversampling: int, iterations: int, seed: int) -> Decomposition:
    """Leading pairs of X^T X, given only its products with a few columns."""
    w = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, min(n, rank + oversampling))))[0]
    for _ in range(iterations):
        w = np.linalg.qr(apply_to(w))[0]
    values, inner = np.linalg.eigh(w.T @ apply_to(w))
    order = np.argsort(values)[::-1][:rank]
    return Decomposition(np.sqrt(np.maximum(values[order], 0)), fix_signs(w @ inner[:, order]))


def svd_sparse(cells: DataFrame, columns: int, rank: int, oversampling: int = 10, iterations: int = 12, seed: int = 0, limit: int = 1 << 20) -> Decomposition:
    """The ``rank`` leading values and right vectors of a sparse matrix (i, j, v) with any number of rows.

    Rows are gathered as lists of indices and values, and each power pass multiplies them in batches, so cells that are
    absent cost nothing. The driver holds ``columns`` x (``rank`` + ``oversampling``) numbers; more columns than ``limit`` are refused.
    """
    if columns > limit:
        raise ValueError(f"{columns} columns are too many for the driver")
    lists = write_table(cells.dropna(subset=["i", "j", "v"]).groupBy("i").agg(F.collect_list("j").alias("j"), F.collect_list(F.col("v").cast("double")).alias("v")).select("j", "v"), "sparse-rows")

    def apply_to(w: np.ndarray) -> np.ndarray:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(w.shape)
            for batch in (b.slice(first, ROWS) for b in batches for first in range(0, len(b), ROWS)):
                at, values = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (0, 1))
                lengths = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
                cells = values[:, None] * w[at]
                product = np.add.reduceat(cells, lengths.cumsum() - lengths)  # no row is without cells
                np.multiply(values[:, None], np.repeat(product, lengths, axis=0), out=cells)
                order = at.argsort(kind="stable")
                columns, first = np.unique(at[order], return_index=True)
                total[columns] += np.add.reduceat(cells[order], first)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))], ["i", "vec"])

        parts = lists.mapInArrow(partial, "i bigint, vec array<double>").select("i", F.posexplode("vec").alias("j", "v"))
        out = np.zeros(w.shape)
        for i, j, v in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
            out[i, j] = v
        return out

    return _power(apply_to, columns, rank, oversampling, iterations, seed)


def spectral_norm(rows: DataFrame, vec: str) -> float:
    """The largest singular value; 0 for an empty matrix."""
    sigma = svd_tsqr(rows, vec, rank=1).sigma
    return float(sigma[0]) if sigma.size else 0.0


def project(rows: DataFrame, row_id: str, vec: str, found: Decomposition) -> DataFrame:
    """(id, k, c): coefficients of each snapshot in the basis, which is literal in the plan. Null vectors are left out."""
    mean = np.zeros(len(found.basis)) if found.mean is None else found.mean
    coefficients = [F.lit(float(-(mean @ found.basis[:, k]))) + _literal_dot(F.col(vec), found.basis[:, k]) for k in range(found.basis.shape[1])]
    return rows.filter(F.col(vec).isNotNull()).select(row_id, F.posexplode(F.array(*coefficients)).alias("k", "c"))


def _literal_dot(vec: Column, weights: np.ndarray) -> Column:
    numbers = F.array(*[F.lit(float(w)) for w in weights])
    return F.aggregate(F.zip_with(vec, numbers, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def reconstruction_error(rows: DataFrame, vec: str, found: Decomposition) -> DataFrame:
    """Relative Frobenius error of the projection, to the size of what was decomposed: for a centred basis, of the centred snapshots.

    The error is what the coefficients don't hold of the energy. Null vectors are left out, as in the decompositions.
    """
    mean = np.zeros(len(found.basis)) if found.mean is None else found.mean
    centre = F.array(*[F.lit(float(m)) for m in mean])
    size = F.aggregate(F.zip_with(vec, centre, lambda x, m: x.cast("double") - m), F.lit(0.0), lambda s, x: s + x * x)
    own = [_literal_dot(F.col(vec), found.basis[:, k]) - F.lit(float(mean @ found.basis[:, k])) for k in range(found.basis.shape[1])]
    held = sum((c * c for c in own), F.lit(0.0))
    sums = rows.filter(F.col(vec).isNotNull()).agg(F.sum(size).alias("all"), F.sum(held).alias("held"))
    return sums.select(F.sqrt(F.greatest(F.lit(0.0), F.col("all") - F.col("held")) / F.col("all")).alias("relative_error"))
