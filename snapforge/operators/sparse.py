"""Large sparse systems on tables: (alpha A + beta E) X = B for any number of states and a few right sides at once.

Vectors are cut into pieces of ``width`` rows, one NumPy matrix a record, and A and E (i, j, v) once into diagonal blocks of as many states and, for
what lies outside of these, the links of each block column. A product is one join of pieces and links; a task sums up what its pieces give to a row, so
only numbers of rows that are linked move, packed by strips of neighbouring pieces, and not a piece for each link. The solver minimises the residual over all directions so far (generalised conjugate residuals for a block
of right sides), preconditioned by solving with the diagonal blocks, so chains and bands with weak links between blocks take a few rounds. A round is one
product and one small sum for the driver: all inner products at once, at most as wide as the directions. Its vectors are written to the shared folder, which cuts the
lineage; the true residual is computed before a result is returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapforge.sources.folders import write_table

WIDTH = 128
#: Bytes of a vector table that may be broadcast to the blocks of a product; it is one of hundreds in a solution, and each passes the driver.
BROADCAST = 1 << 20
#: Links of a block column in one record, on average; a column with more has several.
LINKS = 1 << 14
#: Bytes of one vector in a strip, the pieces that are summed up together, and bytes of sums that a task holds before it hands them on.
STRIP, HELD = 1 << 16, 1 << 25
SENT = "g bigint, b bigint, rows binary, data binary"
STATE = "b bigint, rows binary, cols binary, diagonal binary, x binary, r binary, zs binary, qs binary, z binary, p binary, gram binary"


@dataclass(frozen=True)
class System:
    """Diagonal blocks (b, r, c, a, e) of A and E on the same cells, links (b, part, i, c, a, e) from column c of block b to state i of another one, and the states (i).

    Each block has a part 0 of its links, even if it has none.
    """

    blocks: DataFrame
    links: DataFrame
    states: DataFrame
    width: int
    pieces: int
    identity: bool = True
    decoupled: bool = False

    def transposed(self) -> System:
        links = self.links.select("b", F.explode(F.arrays_zip("i", "c", "a", "e")).alias("x")).select((F.col("b") * self.width + F.col("x.c")).alias("i"), F.col("x.i").alias("j"), "x.a", "x.e")
        return replace(self, blocks=self.blocks.select("b", F.col("c").alias("r"), F.col("r").alias("c"), "a", "e"), links=_links(links, self.states, self.width))

    def altered(self, a: Callable[[Column, Column], Column]) -> System:
        """With other numbers in A, made of those of A and E in the same cell."""
        return replace(self, **{part: getattr(self, part).withColumn("a", F.zip_with("a", "e", a)) for part in ("blocks", "links")})

    def norm(self) -> float:
        """The Frobenius norm of A."""
        cells = self.blocks.select(F.explode("a").alias("a")).unionByName(self.links.select(F.explode("a").alias("a")))
        return float(np.sqrt(cells.agg(F.sum(F.col("a") * F.col("a")).alias("n")).first()["n"] or 0.0))


@dataclass(frozen=True)
class Vectors:
    """Pieces (b, data): ``width`` rows of ``columns`` numbers each; absent pieces are zero."""

    table: DataFrame
    columns: int
    width: int
    kind: type = float


def system(a: DataFrame, e: DataFrame | None = None, width: int = WIDTH) -> System:
    """``e`` is the identity unless given. States are all ids i and j of both; cells that repeat add up, and null ones are left out."""
    number = lambda: F.when(~F.isnan(F.col("v").cast("double")), F.col("v").cast("double"))
    part = lambda m, own, other: m.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), number().alias(own), F.lit(0.0).alias(other))
    summed = lambda m: m.groupBy("i", "j").agg(F.sum("a").alias("a"), F.sum("e").alias("e"))
    given = part(a, "a", "e")
    if e is not None:
        given = given.unionByName(part(e, "e", "a"))
    # A null cell makes its ids states and gives no number; it is known by the null of its own matrix.
    known = F.max(F.col("a").isNotNull() & F.col("e").isNotNull()).alias("known")
    cells = write_table(given.groupBy("i", "j").agg(F.sum("a").alias("a"), F.sum("e").alias("e"), known), "cells")
    states = write_table(_union([cells.select(F.col(c).alias("i")) for c in "ij"]).filter("i IS NOT NULL").distinct(), "states")
    cells = cells.filter("known AND i IS NOT NULL AND j IS NOT NULL").select("i", "j", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("e", F.lit(0.0)).alias("e"))
    block, inside = lambda c: _block(c, width), lambda c: (F.col(c) - _block(c, width) * width).cast("int")
    own, outside = cells.filter(block("i") == block("j")), cells.filter(block("i") != block("j"))
    if e is None:
        own = summed(own.unionByName(states.select("i", F.col("i").alias("j"), F.lit(0.0).alias("a"), F.lit(1.0).alias("e"))))
    lists = own.groupBy(block("i").alias("b")).agg(F.collect_list(F.struct(inside("i").alias("r"), inside("j").alias("c"), "a", "e")).alias("cells"))
    blocks = write_table(lists.select("b", *[F.col(f"cells.{c}").alias(c) for c in "rcae"]), "blocks")
    return System(blocks, _links(outside, states, width), states, width, states.select(block("i")).distinct().count(), e is None, not outside.limit(1).count())


def _block(name: str, width: int) -> Column:
    return F.floor(F.col(name) / width).cast("long")


def _links(cells: DataFrame, states: DataFrame, width: int) -> DataFrame:
    """(b, part, i, c, a, e): cells (i, j, a, e) by block column, those of columns with many in several parts."""
    cells = cells.withColumn("b", _block("j", width))
    many = cells.groupBy("b").count().filter(F.col("count") > LINKS).select("b", F.ceil(F.col("count") / LINKS).alias("parts"))  # no more rows than cells / LINKS
    placed = cells.join(F.broadcast(many), "b", "left").select("b", F.coalesce(F.pmod(F.xxhash64("i"), "parts"), F.lit(0)).cast("int").alias("part"), F.struct("i", (F.col("j") - F.col("b") * width).cast("int").alias("c"), "a", "e").alias("cell"))
    none = states.select(_block("i", width).alias("b")).distinct().select("b", F.lit(0).alias("part"), F.lit(None).cast(placed.schema["cell"].dataType).alias("cell"))
    lists = placed.unionByName(none).groupBy("b", "part").agg(F.collect_list("cell").alias("cells"))
    return write_table(lists.select("b", "part", *[F.col(f"cells.{c}").alias(c) for c in "icae"]), "links")


def _union(parts: list[DataFrame]) -> DataFrame:
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total


def parted(batches: Iterator[pa.RecordBatch], rows: int = 32) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time: pieces are large, and what is made of them should not be held for a whole batch."""
    for batch in batches:
        for first in range(0, len(batch), rows):
            yield batch.slice(first, rows)


def _binary(rows: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values: the rows between neighbouring bounds, which begin with 0."""
    size = rows.itemsize * (rows.shape[1] if rows.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def unpack(data: bytes | None, kind: type, width: int, columns: int | None = None) -> np.ndarray:
    """A piece; without data a piece of zeros."""
    if data is None:
        return np.zeros((width, columns or 0), kind)
    return np.frombuffer(data, kind).reshape(width, -1)


def pieces_of(rows: DataFrame, columns: int, width: int = WIDTH, row_id: str = "i", vec: str = "vec") -> Vectors:
    """Of rows (id, array of ``columns`` numbers); an id that comes twice counts as the sum, null rows are left out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted(batches, 512):
            rows, owner = batch.column(1).flatten(), np.repeat(np.arange(len(batch)) * width, np.diff(batch.column(1).offsets))
            out = np.zeros((len(batch) * width, columns))
            np.add.at(out, owner + rows.field("at").to_numpy(), rows.field("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), columns))
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(out, np.arange(len(batch) + 1) * width)], ["b", "data"])

    place = F.floor(F.col(row_id) / width).cast("long")
    each = rows.filter(F.col(row_id).isNotNull() & F.col(vec).isNotNull()).groupBy(place.alias("b")).agg(F.collect_list(F.struct((F.col(row_id) - place * width).cast("int").alias("at"), F.col(vec).cast("array<double>").alias("vec"))).alias("rows"))
    return Vectors(each.mapInArrow(pack, "b bigint, data binary"), columns, width)


def columns_of(cells: DataFrame, columns: int, width: int = WIDTH) -> Vectors:
    """Of a matrix (i, j, v) with ``columns`` columns."""
    from snapforge.functions.matrix import rows_of

    return pieces_of(rows_of(cells.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v")), columns), columns, width)


def rows_from(x: Vectors, states: DataFrame) -> DataFrame:
    """(i, vec) of each state; of complex vectors (i, vec, im)."""
    kind, width, x_columns = x.kind, x.width, x.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, data in ((batch.column(0)[k].as_py(), batch.column(1)[k].as_py()) for k in range(len(batch))):
                piece = unpack(data, kind, width)
                parts = [piece.real, piece.imag] if kind is complex else [piece]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(b * width, (b + 1) * width)), *[pa.ListArray.from_arrays(pa.array(np.arange(width + 1, dtype=np.int32) * x_columns), pa.array(np.ascontiguousarray(p).ravel())) for p in parts]], ["i", "vec", "im"][: 1 + len(parts)])

    found = x.table.mapInArrow(rows, "i bigint, vec array<double>" + ", im array<double>" * (kind is complex))
    zero = F.array_repeat(F.lit(0.0), x.columns)
    names = [c for c in found.columns if c != "i"]
    return states.join(found, "i", "left").select("i", *[F.coalesce(c, zero).alias(c) for c in names])


def _span(width: int, kind: type, columns: int) -> int:
    """Pieces of a strip."""
    return max(1, STRIP // (width * columns * np.dtype(kind).itemsize))


def _sent(of: System, weights: tuple[complex, complex], pieces: DataFrame, kind: type, columns: int) -> DataFrame:
    """``SENT``: for each strip g the pieces (b, data) that lie in it, and what links add to its rows: their ids and numbers, each once a record."""
    alpha, beta = weights
    width, span = of.width, _span(of.width, kind, columns)

    def deal(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids = np.concatenate([i for i, _ in held])
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        sums, ids = np.add.reduceat(np.concatenate([v for _, v in held])[order], first, axis=0), ids[first]
        strips = ids // (width * span)
        bounds = np.concatenate([[0], np.flatnonzero(strips[1:] != strips[:-1]) + 1, [len(ids)]])
        return pa.RecordBatch.from_arrays([pa.array(strips[bounds[:-1]]), pa.nulls(len(bounds) - 1, pa.int64()), _binary(ids, bounds), _binary(sums, bounds)], ["g", "b", "rows", "data"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in parted(batches):
            b, part, data, i = batch.columns[:4]
            c, a, e = (x.flatten().to_numpy(zero_copy_only=False) for x in batch.columns[4:])
            if len(c):
                z = np.frombuffer(b"".join(data.to_pylist()), kind).reshape(-1, columns)
                at = np.repeat(np.arange(len(batch)) * width, np.diff(i.offsets)) + c
                held.append((i.flatten().to_numpy(), (alpha * a + beta * e)[:, None] * z[at]))
                size += held[-1][1].nbytes
            own = np.flatnonzero(part.to_numpy() == 0)
            if len(own):
                b = b.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([pa.array(b.to_numpy() // span), b, pa.nulls(len(own), pa.binary()), data.take(pa.array(own))], ["g", "b", "rows", "data"])
            if size > HELD:
                yield deal(held)
                held, size = [], 0
        if held:
            yield deal(held)

    small = of.pieces * width * columns * np.dtype(kind).itemsize <= BROADCAST
    met = of.links.join(F.broadcast(pieces) if small else pieces.hint("merge"), "b")
    return met.select("b", "part", "data", "i", "c", "a", "e").mapInArrow(multiply, SENT)


def _gathered(sent: pa.Table, places: np.ndarray, kind: type, width: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """The pieces sent to a strip and what links add to them, in the order of ``places``."""
    z, added = np.zeros((2, len(places), width, columns), kind)
    rows_of = added.reshape(-1, columns)
    for b, rows, data in zip(*(sent.column(c).to_pylist() for c in ("b", "rows", "data")), strict=True):
        if rows is None:
            z[np.searchsorted(places, b)] = unpack(data, kind, width)
        else:
            ids = np.frombuffer(rows, np.int64)
            rows_of[np.searchsorted(places, ids // width) * width + ids % width] += np.frombuffer(data, kind).reshape(-1, columns)
    return z, added


def product(of: System, x: Vectors, alpha: complex = 1.0, beta: complex = 0.0) -> Vectors:
    """(alpha A + beta E) X."""
    kind, width, columns = x.kind, x.width, x.columns

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted(batches, 512):
            lists = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in batch.columns[2:6]]
            out = [_apply([values[offsets[k] : offsets[k + 1]] for offsets, values in lists], unpack(batch.column(1)[k].as_py(), kind, width)).tobytes() for k in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["b", "data"])

    def _apply(cells: list[np.ndarray], z: np.ndarray) -> np.ndarray:
        r, c, a, e = cells
        dense = np.zeros((width, width), kind)
        dense[r, c] = alpha * a + beta * e
        return dense @ z

    def total(key: tuple, sent: pa.Table, own: pa.Table) -> pa.Table:
        ids = [np.frombuffer(rows, np.int64) // width for rows in sent.column("rows").drop_null().to_pylist()]
        places = np.unique(np.concatenate([sent.column("b").drop_null().to_numpy(), *ids])).astype(np.int64)
        z, out = _gathered(sent, places, kind, width, columns)
        for row in own.to_pylist():
            k = np.searchsorted(places, row["b"])
            if k < len(places) and places[k] == row["b"]:
                out[k] += _apply([np.array(row[c], int if c in "rc" else float) for c in "rcae"], z[k])
        return pa.Table.from_arrays([pa.array(places), _binary(out.reshape(-1, columns), np.arange(len(places) + 1) * width)], ["b", "data"])

    if of.decoupled:
        small = of.pieces * width * columns * np.dtype(kind).itemsize <= BROADCAST
        met = of.blocks.join(F.broadcast(x.table) if small else x.table, "b")
        return replace(x, table=met.select("b", "data", "r", "c", "a", "e").mapInArrow(multiply, "b bigint, data binary"))
    sent = _sent(of, (alpha, beta), x.table, kind, columns)
    own = of.blocks.withColumn("g", F.floor(F.col("b") / _span(width, kind, columns)).cast("long"))
    return replace(x, table=sent.groupBy("g").cogroup(own.groupBy("g")).applyInArrow(total, "b bigint, data binary"))


def combine(terms: list[tuple[Vectors, np.ndarray]]) -> Vectors:
    """The sum of vectors times small matrices, which go along with the tasks. All have pieces of one width."""
    first, width = terms[0][0], terms[0][0].width
    kind = complex if any(v.kind is complex or np.iscomplexobj(m) for v, m in terms) else float
    kinds, matrices = [v.kind for v, _ in terms], [m for _, m in terms]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted(batches):
            out = []
            for k in range(len(batch)):
                data = [c[k].as_py() for c in batch.columns[1:]]
                total = sum(unpack(d, k, width) @ m for d, k, m in zip(data, kinds, matrices, strict=True) if d is not None)
                out.append(np.ascontiguousarray(total, kind).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["b", "data"])

    joined = first.table.withColumnRenamed("data", "d0")
    for k, (v, _) in enumerate(terms[1:], 1):
        joined = joined.join(v.table.withColumnRenamed("data", f"d{k}").hint("merge"), "b", "full")
    return Vectors(joined.mapInArrow(add, "b bigint, data binary"), matrices[0].shape[1], width, kind)


def parts_of(x: Vectors) -> tuple[Vectors, Vectors]:
    """Real and imaginary part."""
    if x.kind is float:
        return x, combine([(x, np.zeros((x.columns, x.columns)))])
    width = x.width

    def part(of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
        def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parted(batches):
                out = [np.ascontiguousarray(of(unpack(d, complex, width))).tobytes() for d in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["b", "data"])

        return x.table.mapInArrow(take, "b bigint, data binary")

    return tuple(replace(x, table=part(f), kind=float) for f in (np.real, np.imag))


def inner(x: Vectors, y: Vectors) -> np.ndarray:
    """X^H Y, a small matrix: one per task, added up."""
    width, kinds, alone = x.width, (x.kind, y.kind), x is y

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for k in range(len(batch)):
                a = unpack(batch.column(0)[k].as_py(), kinds[0], width)
                more = a.conj().T @ (a if alone else unpack(batch.column(1)[k].as_py(), kinds[1], width))
                total = more if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(complex).tobytes()], pa.binary())], ["gram"])

    pairs = x.table.select("b", F.col("data").alias("one"))
    pairs = pairs.select("one") if alone else pairs.join(y.table.select("b", F.col("data").alias("two")).hint("merge"), "b").select("one", "two")
    return _summed(pairs.mapInArrow(partial, "gram binary"), x.columns, y.columns, x.kind is complex or y.kind is complex)


def _summed(grams: DataFrame, rows: int, columns: int, complex_: bool) -> np.ndarray:
    """The sum of complex matrices, one a record: added within tasks, then in one, as they are few and small."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column(0).to_pylist():
                more = np.frombuffer(data, complex)
                total = more if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["gram"])

    parts = [np.frombuffer(r["gram"], complex) for r in grams.mapInArrow(add, "gram binary").collect()]
    total = sum(parts).reshape(rows, columns) if parts else np.zeros((rows, columns), complex)
    return total if complex_ else total.real


def solve(of: System, rhs: Vectors, alpha: complex = 1.0, beta: complex = 0.0, tol: float = 1e-10, rounds: int = 200, depth: int = 40, verify: bool = True) -> Vectors:
    """X with (alpha A + beta E) X = B, each column up to a relative residual of ``tol``; an error if ``rounds`` don't suffice or it stops to fall, as in singular systems.

    After ``depth`` rounds the directions are dropped and the search begins anew from the residual. Complex weights give complex vectors.
    Without ``verify`` the residual kept by the rounds decides, and the true one is not computed once more. Where no block is linked to another one, each is solved by itself.
    """
    kind = complex if rhs.kind is complex or complex(alpha).imag or complex(beta).imag else float
    weights = (alpha, beta) if kind is complex else (complex(alpha).real, complex(beta).real)
    m, width = rhs.columns, of.width
    if rhs.width != width:
        raise ValueError("pieces and blocks must have one width")
    if of.decoupled and (found := _solve_blocks(of, rhs, weights, kind, tol)) is not None:
        return found
    state = _start(of, rhs, weights, kind)
    size = None
    update, held, since, before = None, 0, 0, None
    for _ in range(rounds):
        state = write_table(_round(of, state, weights, kind, m, update), "krylov")
        g = _summed(state.select("gram"), held + 2 * m, 2 * m, kind is complex)
        h, pp, pr = g[:held, :m], g[held : held + m, :m], g[held : held + m, m:]
        rr = np.abs(np.diag(g[held + m :, m:]))
        size = rr if size is None else size
        if not rr.any():
            return _solution(state, of, m, kind)
        values, vectors = np.linalg.eigh((lambda s: (s + s.conj().T) / 2)(pp - h.conj().T @ h))
        keep = values > max(values.max(), 0) * 1e-13 + np.abs(np.diag(pp)).max() * 1e-15
        turn = vectors[:, keep] / np.sqrt(values[keep])
        c = turn.conj().T @ (pr - h.conj().T @ g[:held, m:])
        update, held, since = (h, turn, c), held + int(keep.sum()), since + 1
        left = rr - (np.abs(c) ** 2).sum(axis=0)
        if (left <= np.maximum(tol * tol * size, 1e-300)).all() or not keep.any() or since >= depth:
            x = _solution(state, of, m, kind, update)
            x = replace(x, table=write_table(x.table, "solution"))
            if not verify and (left <= np.maximum(tol * tol * size, 1e-300)).all():
                return x
            mine = replace(rhs, kind=kind, table=_as_kind(rhs, kind).table)
            residual = combine([(mine, np.eye(m)), (product(of, x, *weights), -np.eye(m))])
            residual = replace(residual, table=write_table(residual.table, "residual"))
            true = np.abs(np.diag(inner(residual, residual)))
            if (true <= np.maximum((2 * tol) ** 2 * size, 1e-300)).all():
                return x
            if before is not None and (true > before / 4).all():
                raise RuntimeError(f"the residuals {np.sqrt(true)} don't fall any more: the system may be singular")
            before = true
            state = _start(of, residual, weights, kind, x)
            update, held, since = None, 0, 0
    raise RuntimeError(f"no solution within {rounds} rounds: relative residuals {np.sqrt(rr / np.maximum(size, 1e-300))}")


def _solve_blocks(of: System, rhs: Vectors, weights: tuple[complex, complex], kind: type, tol: float) -> Vectors | None:
    """The solution of a system whose blocks aren't linked, one block at a time; none if a block is singular or a column's residual exceeds ``tol`` and rounding."""
    width, m, given, (alpha, beta) = of.width, rhs.columns, rhs.kind, weights

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in batch.columns[2:6]]
            out, sizes = [], np.zeros((2, m))
            for k in range(len(batch)):
                r, c, a, e = (values[offsets[k] : offsets[k + 1]] for offsets, values in lists)
                own, v = unpack(batch.column(1)[k].as_py(), given, width).astype(kind), alpha * a + beta * e
                if (r == c).all():
                    diagonal = np.ones(width, kind)
                    diagonal[r] = v
                    with np.errstate(all="ignore"):
                        x = own / diagonal[:, None]
                        back = np.zeros(x.shape, kind)
                        back[r] = v[:, None] * x[r]
                else:
                    dense = np.zeros((width, width), kind)
                    dense[r, c] = v
                    empty = ~dense.any(axis=1) & ~dense.any(axis=0)
                    try:
                        x = np.linalg.solve(dense + np.diag(empty), own)
                    except np.linalg.LinAlgError:
                        x = np.full(own.shape, np.nan, kind)
                    back = dense @ x
                out.append(np.ascontiguousarray(x, kind).tobytes())
                sizes += np.stack([(np.abs(own - back) ** 2).sum(axis=0), (np.abs(own) ** 2).sum(axis=0)])
            grams = [sizes.astype(complex).tobytes()] + [None] * (len(out) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(grams[: len(out)], pa.binary())], ["b", "data", "gram"])

    met = rhs.table.join(of.blocks.hint("shuffle_hash"), "b", "left").select("b", "data", "r", "c", "a", "e")
    table = write_table(met.mapInArrow(each, "b bigint, data binary, gram binary"), "solution")
    left, size = _summed(table.select("gram").dropna(), 2, m, False)
    return Vectors(table.select("b", "data"), m, width, kind) if (left <= max(2 * tol, 1e-13) ** 2 * size).all() else None


def _as_kind(x: Vectors, kind: type) -> Vectors:
    return x if x.kind is kind else combine([(x, np.eye(x.columns, dtype=kind))])


def _start(of: System, rhs: Vectors, weights: tuple[complex, complex], kind: type, x: Vectors | None = None) -> DataFrame:
    """``STATE`` before the first round: the diagonal blocks with the right sides as residuals."""
    width, m, given, (alpha, beta) = of.width, rhs.columns, rhs.kind, weights
    names = [f.split()[0] for f in STATE.split(", ")]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted(batches):
            lists = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in (batch.column(k) for k in "rcae")]
            out = []
            for k in range(len(batch)):
                r, c, a, e = (values[offsets[k] : offsets[k + 1]] for offsets, values in lists)
                at, own = (unpack(batch.column(name)[k].as_py(), of_kind, width, m).astype(kind) for name, of_kind in (("x", kind), ("data", given)))
                out.append([r.tobytes(), c.tobytes(), (alpha * a + beta * e).astype(kind).tobytes(), at.tobytes(), own.tobytes(), b"", b"", b"", b"", b""])
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("b"), *[pa.array(c, pa.binary()) for c in zip(*out, strict=True)]], names)

    places = of.states.select(F.floor(F.col("i") / width).cast("long").alias("b")).distinct()
    known = x.table.withColumnRenamed("data", "x") if x is not None else places.select("b", F.lit(None).cast("binary").alias("x"))
    joined = places.join(of.blocks, "b", "left").join(rhs.table, "b", "left").join(known, "b", "left")
    return joined.mapInArrow(begin, STATE)


def _advance(row: dict, kind: type, width: int, update: tuple | None) -> dict:
    """The state of one piece after the driver's ``update`` of the last round: directions made orthonormal, residual reduced."""
    at = {k: unpack(row[k], kind, width) for k in ("x", "r", "zs", "qs", "z", "p")}
    if update is not None:
        h, turn, c = update
        z, q = (at["z"] - at["zs"] @ h) @ turn, (at["p"] - at["qs"] @ h) @ turn
        at |= {"x": at["x"] + z @ c, "r": at["r"] - q @ c, "zs": np.hstack([at["zs"], z]), "qs": np.hstack([at["qs"], q])}
    return at


def _diagonal(row: dict, kind: type, width: int) -> np.ndarray:
    dense = np.zeros((width, width), kind)
    dense[np.frombuffer(row["rows"], np.int32), np.frombuffer(row["cols"], np.int32)] = np.frombuffer(row["diagonal"], kind)
    return dense


def _precondition(row: dict, r: np.ndarray, kind: type, width: int) -> np.ndarray:
    """The residual divided by the diagonal block; rows without a state stand for themselves, and a singular block is not used."""
    dense = _diagonal(row, kind, width)
    empty = ~dense.any(axis=1) & ~dense.any(axis=0)
    dense[empty, empty] = 1
    try:
        found = np.linalg.solve(dense, r)
        return found if np.isfinite(found).all() else r
    except np.linalg.LinAlgError:
        return r


def _round(of: System, state: DataFrame, weights: tuple[complex, complex], kind: type, m: int, update: tuple | None) -> DataFrame:
    """``STATE`` with the next directions, their images under the operator and all inner products of each piece."""
    width = of.width
    names = [f.split()[0] for f in STATE.split(", ")]

    def directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted(batches):
            rows = batch.to_pylist()
            out = [np.ascontiguousarray(_precondition(row, _advance(row, kind, width, update)["r"], kind, width)).tobytes() for row in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["b", "data"])

    def meet(key: tuple, own: pa.Table, sent: pa.Table) -> pa.Table:
        own = own.sort_by("b")
        z, p = _gathered(sent, own.column("b").to_numpy(), kind, width, m)
        out = []
        for k, row in enumerate(own.to_pylist()):
            at = _advance(row, kind, width, update)
            p[k] += _diagonal(row, kind, width) @ z[k]
            gram = np.hstack([at["qs"], p[k], at["r"]]).conj().T @ np.hstack([p[k], at["r"]])
            out.append([row["b"], row["rows"], row["cols"], row["diagonal"], *[np.ascontiguousarray(v).tobytes() for v in (at["x"], at["r"], at["zs"], at["qs"], z[k], p[k], gram.astype(complex))]])
        return pa.Table.from_arrays([pa.array(c, pa.binary() if k else pa.int64()) for k, c in enumerate(zip(*out, strict=True))], names)

    sent = _sent(of, weights, state.mapInArrow(directions, "b bigint, data binary"), kind, m)
    strip = F.floor(F.col("b") / _span(width, kind, m)).cast("long")
    return state.groupBy(strip.alias("g")).cogroup(sent.groupBy("g")).applyInArrow(meet, STATE)


def _solution(state: DataFrame, of: System, m: int, kind: type, update: tuple | None = None) -> Vectors:
    width = of.width

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted(batches):
            out = [np.ascontiguousarray(_advance(row, kind, width, update)["x"]).tobytes() for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["b", "data"])

    return Vectors(state.mapInArrow(read, "b bigint, data binary"), m, width, kind)


def written(x: Vectors, name: str) -> Vectors:
    """The same, as a table in the shared folder."""
    return replace(x, table=write_table(x.table, name))

