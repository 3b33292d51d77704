"""Matrices as DataFrames: long form (i, j, v) with absent cells zero, or one array per row (id, vec)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapforge.sources.folders import write_table


def to_long(rows: DataFrame, row_id: str, vec: str) -> DataFrame:
    """(i, j, v) of a table with one array per row."""
    return rows.select(F.col(row_id).cast("long").alias("i"), F.posexplode(F.col(vec)).alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def scale(a: DataFrame, factor: float) -> DataFrame:
    return a.withColumn("v", F.col("v") * factor)


def add(*parts: DataFrame) -> DataFrame:
    """Sum of matrices; cells that a part lacks count as zero there."""
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total.groupBy("i", "j").agg(F.sum("v").alias("v"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """A B: one join on the inner index, then partial sums before the shuffle by cell."""
    right = b.select(F.col("i").alias("inner"), F.col("j").alias("col"), F.col("v").alias("w"))
    return a.join(right, F.col("j") == F.col("inner")).groupBy("i", F.col("col").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def block_cells(a: DataFrame, width: int) -> DataFrame:
    """(bi, bj, r, c, v): the cells of each square block of ``width`` as three arrays; null cells are left out."""
    block = lambda x: F.floor(F.col(x) / width).cast("long")
    inside = lambda x: (F.col(x) - block(x) * width).cast("int")
    cells = F.collect_list(F.struct(inside("i").alias("r"), inside("j").alias("c"), F.col("v").cast("double").alias("v"))).alias("cells")
    return a.dropna(subset=["i", "j", "v"]).groupBy(block("i").alias("bi"), block("j").alias("bj")).agg(cells).select("bi", "bj", *[F.col(f"cells.{x}").alias(x) for x in "rcv"])


def matmul_blocked(a: DataFrame, b: DataFrame, width: int = 256) -> DataFrame:
    """A B for dense matrices: blocks meet by block row and column, and each pair of blocks is one dense product.

    A block of A goes to every block column of B and the other way round, sorted by the inner block, so a task holds a pair of blocks and one sum at a time,
    and nothing but blocks is shuffled: neither scalar products nor partial sums. Cells that repeat add up; cells of the result that are zero are absent.
    Indices count from 0.
    """
    left, right = write_table(block_cells(a, width), "left-blocks"), write_table(block_cells(b, width), "right-blocks")
    last = lambda x, c: F.sequence(F.lit(0).cast("long"), F.lit(x.agg(F.max(c).alias("n")).first()["n"] or 0).cast("long"))
    one = left.select("bi", F.explode(last(right, "bj")).alias("bj"), F.col("bj").alias("k"), F.lit(0).alias("side"), "r", "c", "v")
    two = right.select(F.explode(last(left, "bi")).alias("bi"), "bj", F.col("bi").alias("k"), F.lit(1).alias("side"), "r", "c", "v")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, held, held_at = None, None, np.zeros((width, width)), None

        def cells() -> Iterator[pa.RecordBatch]:
            r, c = np.nonzero(total)
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array(r + at[0] * width), pa.array(c + at[1] * width), pa.array(total[r, c])], ["i", "j", "v"])

        for batch in batches:
            for row in range(len(batch)):
                bi, bj, k, side = (batch.column(x)[row].as_py() for x in range(4))
                if (bi, bj) != at:
                    if at is not None:
                        yield from cells()
                    at, total, held_at = (bi, bj), np.zeros((width, width)), None
                block = np.zeros((width, width))
                np.add.at(block, tuple(batch.column(x)[row].values.to_numpy() for x in (4, 5)), batch.column(6)[row].values.to_numpy())
                if side == 0:
                    held, held_at = block, k
                elif held_at == k:
                    total += held @ block
        if at is not None:
            yield from cells()

    together = one.unionByName(two).repartition("bi", "bj").sortWithinPartitions("bi", "bj", "k", "side")
    return together.mapInArrow(multiply, "i bigint, j bigint, v double")


#: Bytes of the rows that are one operand of a product, and of the product's part that is held at once.
STRIP, TILE = 4 << 20, 16 << 20


def rows_with_rows(rows: DataFrame, row_id: str, vec: str) -> DataFrame:
    """(i, total, largest): of the products of each row with all rows, the sum, and the largest with a row of another id (null if there is none).

    That is A A^T, reduced by row while it is made: rows are packed into strips, every pair of strips is one dense product in tiles, and only a sum and
    a maximum a row leave a task. Strips are read anew for each pair of their partitions, so nothing is shuffled more than once. The products grow with the square of the rows.
    Rows without an array are left out, absent numbers count as zero.
    """
    given = rows.filter(F.col(row_id).isNotNull() & F.col(vec).isNotNull())
    size = given.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("columns")).first()
    columns = max(size["columns"] or 0, 1)
    strips = max(1, -(-size["n"] * columns * 8 // STRIP))
    numbers = F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda j: F.coalesce(F.get(vec, j).cast("double"), F.lit(0.0)))
    dealt = given.select(F.pmod(F.xxhash64(F.col(row_id).cast("long")), F.lit(strips)).cast("int").alias("strip"), F.col(row_id).cast("long").alias("i"), numbers.alias("vec"))

    def pack(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts = zip(*((b.column(1).to_numpy(), as_matrix(b.column(2))) for b in batches), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.vstack(parts).tobytes()], pa.binary())], ["strip", "ids", "data"])

    packed = write_table(dealt.groupBy("strip").applyInArrow(pack, "strip int, ids binary, data binary").repartition(strips, "strip"), "strips")

    def reduce_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, total, largest = None, None, None, None

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total), pa.array(largest)], ["i", "total", "largest"])

        for batch in batches:
            for row in range(len(batch)):
                own, other = batch.column(0)[row].as_py(), batch.column(3)[row].as_py()
                if own != at:
                    if at is not None:
                        yield found()
                    at, ids = own, np.frombuffer(batch.column(1)[row].as_buffer(), np.int64).copy()
                    left = np.frombuffer(batch.column(2)[row].as_buffer(), float).reshape(-1, columns).copy()
                    total, largest = np.zeros(len(ids)), np.full(len(ids), -np.inf)
                right = np.frombuffer(batch.column(5)[row].as_buffer(), float).reshape(-1, columns)
                step = max(1, TILE // (8 * len(right)))
                for first in range(0, len(ids), step):
                    part = slice(first, first + step)
                    v = left[part] @ right.T
                    total[part] += v.sum(axis=1)
                    if own == other:  # equal ids meet in one strip only
                        v[ids[part, None] == np.frombuffer(batch.column(4)[row].as_buffer(), np.int64)] = -np.inf
                    np.maximum(largest[part], v.max(axis=1), out=largest[part])
        if at is not None:
            yield found()

    one = packed.select(F.col("strip").alias("s1"), F.col("ids").alias("i1"), F.col("data").alias("d1")).repartition(strips, "s1")
    two = packed.select(F.col("strip").alias("s2"), F.col("ids").alias("i2"), F.col("data").alias("d2"))
    pairs = one.crossJoin(two.hint("shuffle_replicate_nl"))
    each = pairs.mapInArrow(reduce_, "i bigint, total double, largest double").groupBy("i").agg(F.sum("total").alias("total"), F.max("largest").alias("largest"))
    return each.withColumn("largest", F.when(F.col("largest") > float("-inf"), F.col("largest")))


def low_rank_apply(left: DataFrame, right: DataFrame, x: DataFrame, check: bool = True) -> DataFrame:
    """L (R^T x), the small inner product first, so L R^T never exists.

    Both factors must have the same number of columns (the highest index that occurs is compared; ``check`` reads them for that).
    """
    if check:
        widths = [(f.agg(F.max("j").alias("j")).first()["j"] or 0) + 1 for f in (left, right)]
        if widths[0] != widths[1]:
            raise ValueError(f"low-rank factors must have the same number of columns, not {widths[0]} and {widths[1]}")
    return matmul(left, matmul(transpose(right), x))


def hstack(a: DataFrame, b: DataFrame, columns: int) -> DataFrame:
    """``b`` to the right of ``a``, which has ``columns`` columns."""
    return a.unionByName(b.withColumn("j", F.col("j") + columns))


def vstack(a: DataFrame, b: DataFrame, rows: int) -> DataFrame:
    """``b`` below ``a``, which has ``rows`` rows."""
    return a.unionByName(b.withColumn("i", F.col("i") + rows))


def stable_shifts(shifts: DataFrame, tol: float = 1e-14, positive_imaginary: bool = False) -> DataFrame:
    """Shifts (re, im) in the open left half plane, away from zero and from the imaginary axis."""
    kept = (F.col("re") < 0) & (F.abs("re") > tol) & (F.sqrt(F.col("re") ** 2 + F.col("im") ** 2) > tol)
    return shifts.filter(kept & (F.col("im") >= 0) if positive_imaginary else kept)


def smallest_shifts(shifts: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` shifts of least magnitude, ties by real and then imaginary part."""
    return shifts.orderBy(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2), "re", "im").limit(n)


def scale_columns(a: DataFrame, weights: DataFrame) -> DataFrame:
    """Each column j times its weight (j, w), as a basis by its spectrum; columns without a weight are left out."""
    return a.join(weights.select("j", "w"), "j").select("i", "j", (F.col("v") * F.col("w")).alias("v"))


def save_state(state: dict[str, np.ndarray], spark: SparkSession, path: str) -> None:
    """Write small named matrices as one Parquet table (name, rows, columns, values)."""
    rows = [(name, *np.atleast_2d(m).shape, np.atleast_2d(m).ravel().tolist()) for name, m in state.items()]
    spark.createDataFrame(rows, "name string, rows int, columns int, cells array<double>").coalesce(1).write.parquet(path)


def load_state(spark: SparkSession, path: str, strict: tuple[str, ...] = ()) -> dict[str, np.ndarray]:
    """Read them again; names in ``strict`` that are missing are an error."""
    found = {r["name"]: np.array(r["cells"]).reshape(r["rows"], r["columns"]) for r in spark.read.parquet(path).collect()}
    if missing := [name for name in strict if name not in found]:
        raise KeyError(f"the state lacks {', '.join(missing)}")
    return found


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def frobenius(a: DataFrame) -> DataFrame:
    return a.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def trace(a: DataFrame) -> DataFrame:
    return a.filter("i = j").agg(F.sum("v").alias("trace"))


def as_matrix(column: pa.Array) -> np.ndarray:
    """The arrays of an Arrow column, none of which is null, as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def table_of(cells: np.ndarray) -> pa.RecordBatch:
    i, j = np.indices(cells.shape)
    return pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(cells.ravel())], ["i", "j", "v"])


def gram(rows: DataFrame, vec: str, other: str | None = None, centre: np.ndarray | None = None) -> DataFrame:
    """(i, j, v) of the sum of vec other^T over all rows, ``other`` being ``vec`` itself unless named. ``centre`` is taken from each vector first.

    Each Arrow batch is one small matrix product, each task returns one table, and Spark adds the tables up: what is
    shuffled depends on the number of columns and tasks, not on the rows. Rows with a null vector are left out.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch.column(0)):
                one, two = (as_matrix(c) if centre is None else as_matrix(c) - centre for c in batch.columns)
                more = one.T @ two
                total = more if total is None else total + more
        if total is not None:
            yield table_of(total)

    second = vec if other is None else other
    vectors = rows.filter(F.col(vec).isNotNull() & F.col(second).isNotNull()).select(F.col(vec).cast("array<double>").alias("a"), F.col(second).cast("array<double>").alias("b"))
    return vectors.mapInArrow(partial, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def rows_of(a: DataFrame, columns: int) -> DataFrame:
    """(i, vec) of a matrix in long form with ``columns`` columns; absent cells are zero, and rows without cells are absent."""
    cells = F.map_from_entries(F.collect_list(F.struct("j", "v")))
    each = a.groupBy("i").agg(cells.alias("cells"))
    dense_row = F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda j: F.coalesce(F.element_at("cells", j.cast("long")), F.lit(0.0)))
    return each.select("i", dense_row.alias("vec"))


def conjugate(a: DataFrame) -> DataFrame:
    """Of a complex matrix (i, j, re, im)."""
    return a.withColumn("im", -F.col("im"))


def reshape(a: DataFrame, columns: int, new_columns: int) -> DataFrame:
    """The same cells in row order, dealt into rows of ``new_columns``."""
    flat = F.col("i") * columns + F.col("j")
    return a.select(F.floor(flat / new_columns).cast("long").alias("i"), (flat % new_columns).cast("long").alias("j"), "v")


def identity(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def random_normal(spark: SparkSession, rows: int, columns: int, seed: int = 0) -> DataFrame:
    """Independent standard normal cells. The same seed gives the same cells, however Spark deals the rows."""
    unit = lambda salt: (F.pmod(F.xxhash64("i", "j", F.lit(seed), F.lit(salt)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    cells = spark.range(rows).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long"))).alias("j"))
    return cells.select("i", "j", (F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * np.pi * unit(2))).alias("v"))


def dense(a: DataFrame, cells: int = 2048 * 2048) -> np.ndarray:
    """A small matrix on the driver; one of more than ``cells`` cells is refused before any is fetched.

    The matrix is written first, so it is computed once, and fetched as columns.
    """
    kept = write_table(a.select("i", "j", F.col("v").cast("double").alias("v")), "dense")
    shape = kept.agg(F.max("i").alias("i"), F.max("j").alias("j")).first()
    if shape["i"] is None:
        return np.zeros((0, 0))
    if (shape["i"] + 1) * (shape["j"] + 1) > cells:
        raise ValueError(f"a matrix with {shape['i'] + 1} x {shape['j'] + 1} cells is too large for the driver")
    out = np.zeros((shape["i"] + 1, shape["j"] + 1))
    i, j, v = (c.to_numpy() for c in kept.toArrow().columns)
    out[i, j] = v
    return out


def fix_signs(vectors: np.ndarray) -> np.ndarray:
    """Each column's entry of largest magnitude (the first of equals) made positive."""
    if not vectors.size:
        return vectors
    lead = np.abs(np.round(vectors, 12)).argmax(axis=0)
    return vectors * np.where(vectors[lead, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def distinct_rounded(rows: DataFrame, columns: list[str], order: str, decimals: int = 9) -> DataFrame:
    """Of rows that agree after rounding, the first in ``order``, with its values unrounded."""
    first = F.min(F.struct(F.col(order), *[F.col(c) for c in columns])).alias("row")
    keys = [F.round(F.col(c), decimals).alias(f"_k{i}") for i, c in enumerate(columns)]
    return rows.groupBy(*keys).agg(first).select("row.*")


def free_name(rows: DataFrame, name: str) -> str:
    """``name``, or a variant of it that no column of ``rows`` bears (Spark compares names without case)."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ordered_rank(rows: DataFrame, key: Column, span: int, order: list[str], buckets: int = 1024, name: str = "rank") -> DataFrame:
    """Add ``name``, 1, 2, ... over all rows by ``key`` (a whole number in [0, span), null first) and then ``order``.

    Buckets of the key's range are ranked by themselves and moved up by the counts of those before, a table of at
    most ``buckets`` + 1 rows, so no task sees all rows. A column called ``name`` is replaced.
    """
    k, bucket, first, n = (free_name(rows, x) for x in ("_key", "_bucket", "_first", "_n"))
    rows = rows.withColumn(k, key).withColumn(bucket, F.coalesce(F.floor(F.col(k) * buckets / span), F.lit(-1)).cast("int"))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias(n))
    firsts = counts.select(bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    ranked = rows.withColumn(name, F.row_number().over(Window.partitionBy(bucket).orderBy(k, *order)))
    return ranked.join(F.broadcast(firsts), bucket).withColumn(name, F.col(name) + F.col(first)).drop(k, bucket, first)
