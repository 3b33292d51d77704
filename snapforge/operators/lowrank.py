"""Lyapunov equations of large sparse systems by low-rank factors, and balanced truncation on the factors.

A and E stay tables (see ``sparse``), factors are tables with one array per state, and the driver sees matrices as wide as
a factor only: inner products, shifts, and the reduced system.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapforge.operators import sparse
from snapforge.operators.lyapunov import REGULARISATION, Reduced
from snapforge.operators.sparse import System, Vectors, combine, inner, parts_of, product, unpack, written
from snapforge.operators.svd import triangle, truncation_rank

#: Shifts to fall back on, and those whose solves widen the first search space.
HEURISTIC, PROBES = (-1e-3, -1e-2, -1e-1, -1.0, -10.0), (-1e-2, -1e-1, -1.0, -10.0)
#: Norm of A above which a system is scaled before it is reduced.
LARGE_NORM = 1e6


@dataclass(frozen=True)
class Factor:
    """Z with Z Z^T the Gramian; steps taken and the norm of what is left of the equation, relative to that of B B^T."""

    vectors: Vectors
    steps: int
    residual: float


class Columns:
    """A factor in the making: blocks times small matrices, side by side, put together when asked for."""

    def __init__(self, width: int):
        self.width, self.terms = width, []

    def add(self, block: Vectors, matrix: np.ndarray) -> None:
        self.terms.append((block, matrix))

    @property
    def count(self) -> int:
        return sum(m.shape[1] for _, m in self.terms)

    def joined(self, last: int | None = None) -> Vectors:
        """All columns, or the ``last`` ones."""
        total, at, terms = self.count, 0, []
        for block, m in self.terms:
            placed = np.zeros((block.columns, total), m.dtype)
            placed[:, at : at + m.shape[1]] = m
            at += m.shape[1]
            placed = placed[:, total - (last or total) :]
            if placed.any():
                terms.append((block, placed))
        return combine(terms or [(self.terms[0][0], np.zeros((self.terms[0][0].columns, last or total)))])

    def compress(self, states: int) -> Vectors:
        """The same Z Z^T with no more columns than its numerical rank; the columns are replaced by these."""
        found = compress(written(self.joined(), "factor"), states)
        self.terms = [(found, np.eye(found.columns))]
        return found


def triangle_of(z: Vectors) -> np.ndarray:
    """R of the QR decomposition of tall vectors."""
    width = z.width

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in (batch.column(0)[k].as_py() for k in range(len(batch))):
                yield pa.RecordBatch.from_arrays([pa.array(list(unpack(data, float, width)), pa.list_(pa.float64()))], ["vec"])

    return triangle(z.table.select("data").mapInArrow(rows, "vec array<double>"), "vec")


def compress(z: Vectors, states: int) -> Vectors:
    """Z times the right singular vectors of its triangle, those of values under the largest times ``states`` times 2.22e-16 left out."""
    r = triangle_of(z)
    if not r.size:
        return z
    _, s, vt = np.linalg.svd(r, full_matrices=False)
    keep = s > s[0] * states * 2.22e-16 if s[0] else np.zeros(len(s), bool)
    return written(combine([(z, vt[keep].T if keep.any() else np.zeros((z.columns, 1)))]), "factor")


def orthonormal(z: Vectors) -> Vectors:
    """An orthonormal basis of the columns' span."""
    values, vectors = np.linalg.eigh(inner(z, z))
    keep = values > max(values.max(initial=0), 0) * 1e-14
    first = combine([(z, vectors[:, keep] / np.sqrt(values[keep]))])
    again = np.linalg.cholesky(inner(first, first))  # the second time makes up for the squared condition
    return combine([(first, np.linalg.inv(again).T)])


def stable(shifts: np.ndarray, tol: float = 1e-14) -> np.ndarray:
    """Those in the open left half plane, one of each conjugate pair, nearly real ones made real, by magnitude."""
    shifts = np.asarray(shifts, complex)
    kept = shifts[(shifts.real < 0) & (np.abs(shifts) > tol) & (np.abs(shifts.real) > tol) & (shifts.imag >= 0)]
    kept = np.where(np.abs(kept.imag) < 1e-12 * np.abs(kept.real), kept.real, kept)
    return kept[np.argsort(np.abs(kept), kind="stable")]


def projected(of: System, basis: Vectors) -> np.ndarray:
    """Eigenvalues of the pencil (A, E) projected on an orthonormal basis."""
    a, e = (inner(basis, product(of, basis, *weights)) for weights in ((1.0, 0.0), (0.0, 1.0)))
    return np.linalg.eigvals(np.linalg.solve(e, a))


def first_shifts(of: System, b: Vectors) -> np.ndarray:
    found = stable(projected(of, written(orthonormal(b), "basis")))
    if len(found):
        return found
    wide = Columns(of.width)
    wide.add(b, np.eye(b.columns))
    for shift in PROBES:
        try:
            wide.add(sparse.solve(of, b, 1.0, shift, tol=1e-6), np.eye(b.columns))
        except RuntimeError:  # a probe that doesn't converge says nothing
            continue
    found = stable(projected(of, written(orthonormal(written(wide.joined(), "probes")), "basis")))
    return found if len(found) else np.array(HEURISTIC)


def lr_adi(of: System, b: Vectors, tol: float = 1e-10, max_iter: int = 500, columns: int = 6, states: int | None = None) -> Factor:
    """Z with A Z Z^T E^T + E Z Z^T A^T + B B^T close to zero, for a stable pencil; of the transposed system for the other Gramian.

    Each step solves with A + s E for all columns of the residual's factor W at once, and A Z Z^T E^T + ... + B B^T is W W^T after it, so its norm
    is known from W's inner products. A complex shift stands for its conjugate too and gives real columns. When all shifts are used,
    new ones come from A and E projected on the last ``columns`` blocks of Z.
    """
    states = states or of.states.count()
    m, eye = b.columns, np.eye(b.columns)
    z, w, shifts, at, steps = Columns(of.width), b, first_shifts(of, b), 0, 0
    norm = lambda x: float(np.linalg.norm(inner(x, x), 2))
    whole = left = norm(b)
    while left > whole * tol and steps < max_iter:
        s = complex(shifts[at])
        v = sparse.solve(of, w, 1.0, s if s.imag else s.real, tol=max(min(1e-8, tol * 1e2), 1e-12), verify=False)
        if not s.imag:
            step, gain = v, -2 * s.real
            z.add(v, eye * np.sqrt(gain))
            steps += 1
        else:
            gain, d = -4 * s.real, s.real / s.imag
            re, im = parts_of(v)
            step = written(combine([(re, eye), (im, eye * d)]), "step")
            z.add(step, eye * np.sqrt(gain))
            z.add(im, eye * np.sqrt(gain * (d * d + 1)))
            steps += 2
        moved = step if of.identity else product(of, step, 0.0, 1.0)
        w = written(combine([(w, eye), (moved, eye * gain)]), "residual-factor")
        left, at = norm(w), at + 1
        if len(z.terms) > 8:
            z.compress(states)
        if at == len(shifts) and left > whole * tol:
            basis = written(orthonormal(written(z.joined(min(columns * m, z.count)), "last")), "basis")
            found = stable(projected(of, basis))
            shifts, at = found if len(found) else shifts, 0
    if not z.terms:
        z.add(b, eye * 0)
    return Factor(z.compress(states), steps, left / whole if whole else 0.0)


def lr_smith(of: System, b: Vectors, tol: float = 1e-10, max_iter: int = 200, states: int | None = None, squeeze: bool = True) -> Factor:
    """Z with A Z Z^T A^T - E Z Z^T E^T + B B^T close to zero, for a pencil inside the unit circle.

    Z is [Y, F Y, F^2 Y, ...] with F = E^-1 A and Y = E^-1 B; what the equation lacks after each step is the next block's outer product.
    With ``squeeze``, Z is cut to its numerical rank.
    """
    states = states or of.states.count()
    back = lambda x: x if of.identity else sparse.solve(of, x, 0.0, 1.0, tol=1e-12)
    eye = np.eye(b.columns)
    z, y = Columns(of.width), back(b)
    norm = lambda x: float(np.linalg.norm(inner(x, x), 2))
    whole = left = norm(y)
    steps = 0
    while steps < max_iter and (left > whole * tol or not steps):
        z.add(y, eye)
        y = written(back(written(product(of, y), "smith")), "smith")
        left, steps = norm(y), steps + 1
        if squeeze and len(z.terms) > 8:
            z.compress(states)
    return Factor(z.compress(states) if squeeze else written(z.joined(), "factor"), steps, left / whole if whole else 0.0)


def lyapunov_residual(of: System, z: Vectors, b: Vectors, discrete: bool = False) -> float:
    """Frobenius norm of the equation's residual, relative to that of B B^T, from inner products alone: it is the norm of a small matrix between wide factors."""
    az, ez = written(product(of, z), "az"), written(product(of, z, 0.0, 1.0), "ez")
    wide = Columns(of.width)
    for block in (az, ez, b):
        wide.add(block, np.eye(block.columns))
    r = triangle_of(written(wide.joined(), "wide"))
    k, m = z.columns, b.columns
    core = np.zeros((2 * k + m, 2 * k + m))
    core[2 * k :, 2 * k :] = np.eye(m)
    if discrete:
        core[:k, :k], core[k : 2 * k, k : 2 * k] = np.eye(k), -np.eye(k)
    else:
        core[:k, k : 2 * k] = core[k : 2 * k, :k] = np.eye(k)
    size = np.linalg.norm(r[:, 2 * k :] @ r[:, 2 * k :].T)
    return float(np.linalg.norm(r @ core @ r.T) / size) if size else 0.0


def balanced_truncation(of: System, b: Vectors, c: Vectors, order: int | None = None, max_error: float | None = None, continuous_time: bool = True, tol: float = 1e-10) -> tuple[Reduced, np.ndarray]:
    """The reduced system and its E, by the square-root method on low-rank factors. ``c`` holds C^T, one row per state.

    A is regularised by -1e-8 E, and scaled where its norm exceeds 1e6, for the Gramians only. ``order`` fixes the
    number of states, else ``max_error`` is the energy share of Hankel singular values that may be lost.
    """
    shifted = of.altered(lambda a, e: a - REGULARISATION * e) if continuous_time else of
    norm = shifted.norm()
    factor = lr_adi if continuous_time else lr_smith
    if continuous_time and norm > LARGE_NORM:
        scaled = shifted.altered(lambda a, e: a / F.lit(norm))
        small = lambda x: combine([(x, np.eye(x.columns) / np.sqrt(norm))])
    else:
        scaled, small = shifted, lambda x: x
    states = of.states.count()
    zc = factor(scaled, written(small(b), "b"), tol=tol, states=states).vectors
    zo = factor(scaled.transposed(), written(small(c), "c"), tol=tol, states=states).vectors
    u, hsv, vt = np.linalg.svd(inner(zo, zc))
    keep = hsv > (hsv[0] if len(hsv) else 0) * states * np.finfo(float).eps
    hsv = hsv[keep]
    r = truncation_rank(hsv, order, max_error)
    if not r:
        raise ValueError("nothing is left of the system")
    root = 1 / np.sqrt(hsv[:r])
    v = written(combine([(zc, vt[:r].T * root)]), "trial")
    w = written(combine([(zo, u[:, :r] * root)]), "test")
    reduced = Reduced(inner(w, product(of, v)), inner(w, b), inner(c, v), hsv)
    return reduced, inner(w, v if of.identity else product(of, v, 0.0, 1.0))


def factor_rows(factor: Factor, of: System) -> DataFrame:
    """(i, vec): one array per state."""
    return sparse.rows_from(factor.vectors, of.states)
