"""Meshes as tables: cells with their node ids, boundary facets, measures and normals, and point-to-boundary searches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapforge.functions.matrix import as_matrix, free_name
from snapforge.operators.cells import nearest as by_cells
from snapforge.operators.sampling import apportion, key_hash
from snapforge.sources.folders import write_table

#: Corners of each facet, as positions in a cell's connectivity.
FACETS = {
    "triangle": ((0, 1), (1, 2), (2, 0)),
    "quad": ((0, 1), (1, 2), (2, 3), (3, 0)),
    "tetra": ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)),
}


def boundary_facets(cells: DataFrame, kind: str | None, conn: str = "conn", by: list[str] | None = None) -> DataFrame:
    """Facets used by exactly one cell (of the same ``by`` columns), with their vertices in the cell's order.

    All cells are of ``kind``, or else of the kind that their column ``cell_type`` names. Quadratic cells count with their
    corner nodes, which come first. Counting is a partial aggregate, so a facet costs one row per task.
    """
    of = lambda k: F.array(*[F.array(*[F.get(F.col(conn), F.lit(i)) for i in corner]) for corner in FACETS[k]])
    facets = of(kind) if kind else F.coalesce(*[F.when(F.col("cell_type") == k, of(k)) for k in FACETS])
    by = by or []
    each = cells.select(*by, F.explode(facets).alias("facet"))
    counted = each.groupBy(*by, F.array_sort("facet").alias("_key")).agg(F.count(F.lit(1)).alias("_n"), F.min("facet").alias("facet"))
    return counted.filter("_n = 1").select(*by, "facet")


def facet_corners(facets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes that ``facets`` have, once each."""
    return nodes.join(facets.select(F.explode("facet").alias("node_id")).distinct(), "node_id", "left_semi")


def triangle_geometry(facets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds corners (``p0``, ``p1``, ``p2``), area, centroid (``cx``, ``cy``, ``cz``) and unit normal (``nx``, ``ny``, ``nz``) to facets of three nodes.

    Normals follow the corners' order, as seen anticlockwise. Nodes are (node_id, x, y, z).
    """
    rows = facets.select(*facets.columns, *[F.get("facet", F.lit(i)).alias(f"_f{i}") for i in range(3)])
    for i in range(3):
        rows = rows.join(nodes.select(F.col("node_id").alias(f"_f{i}"), F.array("x", "y", "z").alias(f"p{i}")), f"_f{i}").drop(f"_f{i}")
    at = lambda p, a: F.get(p, F.lit(a))
    e1, e2 = ([at(p, a) - at("p0", a) for a in range(3)] for p in ("p1", "p2"))
    cross = [e1[(a + 1) % 3] * e2[(a + 2) % 3] - e1[(a + 2) % 3] * e2[(a + 1) % 3] for a in range(3)]
    rows = rows.withColumn("_x", F.array(*cross)).withColumn("_l", F.sqrt(sum((at("_x", a) * at("_x", a) for a in range(3)), F.lit(0.0))))
    centre = [((at("p0", a) + at("p1", a) + at("p2", a)) / 3).alias(f"c{n}") for a, n in enumerate("xyz")]
    normal = [(at("_x", a) / (F.col("_l") + 1e-30)).alias(f"n{n}") for a, n in enumerate("xyz")]
    return rows.select(*facets.columns, "p0", "p1", "p2", (F.col("_l") / 2).alias("area"), *centre, *normal)


def unit_draw(*parts: Column | str) -> Column:
    """A number in (0, 1) from the MD5 of the parts, which other engines have too."""
    digits = F.substring(F.md5(F.concat_ws("/", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def sample_triangles(facets: DataFrame, key: str, n: int | DataFrame, seed: int = 0, by: str | None = None) -> DataFrame:
    """``n`` points on triangles (from ``triangle_geometry``) with their normals, each facet getting its share by area.

    With ``by``, each of its groups gets its own number of points, from a table (``by``, count).
    """
    drawn = sample_facets(facets, "area", key, n, by=by)
    name = [by] if by else []
    r, u = F.sqrt(unit_draw(*name, "sample", F.lit(f"{seed}/r"))), unit_draw(*name, "sample", F.lit(f"{seed}/u"))
    drawn = drawn.withColumn("_r", r).withColumn("_u", u)
    at = lambda p, a: F.get(p, F.lit(a))
    point = [((1 - F.col("_r")) * at("p0", a) + F.col("_r") * (1 - F.col("_u")) * at("p1", a) + F.col("_r") * F.col("_u") * at("p2", a)).alias(c) for a, c in enumerate("xyz")]
    return drawn.select(*name, "sample", key, *point, "nx", "ny", "nz")


def sample_boundaries(facets: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` points with normals over all boundaries together; each boundary's number is its largest-remainder share by area."""
    counts = apportion(facets.groupBy("boundary").agg(F.sum("area").alias("weight")), "boundary", "weight", n)
    return sample_triangles(facets, key, counts.select("boundary", "count"), seed, by="boundary")


def nearest_normals(points: DataFrame, facets: DataFrame, key: str, facet_key: str) -> DataFrame:
    """(query, facet, nx, ny, nz): the normal of the facet whose centroid is nearest to each point (x, y, z); ties by facet."""
    centres = facets.select(F.col(facet_key).alias(key), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    near = nearest(points, centres, key, ["x", "y", "z"], 1, same=False)
    normals = facets.select(F.col(facet_key).alias("neighbour"), "nx", "ny", "nz")
    return near.join(normals, "neighbour").select("query", F.col("neighbour").alias("facet"), "nx", "ny", "nz")


def split_quads(cells: DataFrame, conn: str = "conn") -> DataFrame:
    """Each quad a, b, c, d as the triangles a, b, c and a, c, d."""
    c = lambda i: F.get(F.col(conn), F.lit(i))
    return cells.select(F.explode(F.array(F.array(c(0), c(1), c(2)), F.array(c(0), c(2), c(3)))).alias(conn))


def edge_geometry(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """facet, length, centre and unit normal of each edge (facet: two node ids), nodes being (node_id, x, y).

    Normals point away from the mean of the mesh's nodes.
    """
    ends = edges.select("facet", F.get("facet", F.lit(0)).alias("a"), F.get("facet", F.lit(1)).alias("b"))
    for end in "ab":
        ends = ends.join(nodes.select(F.col("node_id").alias(end), F.col("x").alias(f"{end}x"), F.col("y").alias(f"{end}y")), end)
    mean = nodes.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))  # one row
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    out = ends.select("facet", F.sqrt(dx * dx + dy * dy).alias("length"), ((F.col("ax") + F.col("bx")) / 2).alias("cx"), ((F.col("ay") + F.col("by")) / 2).alias("cy"), dy.alias("nx"), (-dx).alias("ny"))
    out = out.crossJoin(F.broadcast(mean))  # with a single row
    inward = F.col("nx") * (F.col("cx") - F.col("mx")) + F.col("ny") * (F.col("cy") - F.col("my")) < 0
    sign = F.when(inward, -1.0).otherwise(1.0) / (F.col("length") + 1e-30)
    return out.select("facet", "length", "cx", "cy", (F.col("nx") * sign).alias("nx"), (F.col("ny") * sign).alias("ny"))


def unit_cube(points: DataFrame, axes: list[str]) -> DataFrame:
    """Each axis moved and stretched to [0, 1]; an axis without extent keeps its scale."""
    box = points.agg(*[f(a).alias(f"_{n}_{a}") for a in axes for n, f in (("low", F.min), ("high", F.max))])
    out = points.crossJoin(F.broadcast(box))  # with a single row
    for a in axes:
        span = F.col(f"_high_{a}") - F.col(f"_low_{a}")
        out = out.withColumn(a, (F.col(a) - F.col(f"_low_{a}")) / F.when(span < 1e-15, 1.0).otherwise(span))
    return out.select(*points.columns)


def locate_boundary(points: DataFrame, nodes: DataFrame, axes: list[str], tolerance: float) -> DataFrame:
    """Add ``boundary``: of the nearest boundary node within ``tolerance``, else null; ties go to the first name.

    Each point looks for its nearest node by cells of bounded size (see ``cells``), no farther than the tolerance; nodes at one place count once, with
    their first name. Points are numbered in a written table and meet their boundary by that number, so nulls in other columns, repeated
    points and columns of any name are no matter; a column called ``boundary`` is replaced. A point without a coordinate has no boundary.
    """
    points = points.drop("boundary")
    row, name = (free_name(points, x) for x in ("_row", "_name"))
    numbered = write_table(points.withColumn(row, F.monotonically_increasing_id()), "points")
    places = nodes.groupBy(*[F.col(a).cast("double").alias(a) for a in axes]).agg(F.min(F.struct("boundary")).getField("boundary").alias(name))
    near = by_cells(numbered.select(F.col(row).alias(name), *axes), places, name, axes, 1, same=False, within=tolerance)
    return numbered.join(near.select(F.col("query").alias(row), F.col("neighbour").alias("boundary")), row, "left").drop(row)


def nearest(queries: DataFrame, points: DataFrame, key: str, axes: list[str], k: int, block: int = 4096, same: bool = True, rounds: int = 4) -> DataFrame:
    """(query, neighbour, distance, rank): the k nearest points of each stated query, ties by id.

    With ``same``, queries are points too, and a point isn't its own neighbour. Up to three axes, points are found by cells of bounded size (see ``cells``), so
    queries far from everything cost no more than others. Queries in more axes, and all without ``rounds``, are compared with all points in blocks. Rows without a
    coordinate are left out.
    """
    if len(axes) <= 3 and rounds:
        return by_cells(queries, points, key, axes, k, same)
    complete = [F.col(a).isNotNull() & ~F.isnan(F.col(a).cast("double")) for a in axes]
    for c in complete:
        queries, points = queries.filter(c), points.filter(c)
    left = queries.select(F.col(key).alias("query"), *[F.col(a).cast("double").alias(f"_q{i}") for i, a in enumerate(axes)])
    right = points.select(F.col(key).alias("neighbour"), *[F.col(a).cast("double").alias(f"_p{i}") for i, a in enumerate(axes)])
    best = Window.partitionBy("query").orderBy("distance", "neighbour")
    return _nearest_in_blocks(left, right, len(axes), k, block, same).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _nearest_in_blocks(left: DataFrame, right: DataFrame, axes: int, k: int, block: int, same: bool) -> DataFrame:
    """At least the k nearest of each query: each pair of blocks is one small distance table, of which k rows per query go on."""
    n_q, n_p = left.count(), right.count()
    q_blocks, p_blocks = max(1, -(-n_q // block)), max(1, -(-n_p // block))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q = left.withColumn("qb", deal("query", q_blocks)).withColumn("pb", F.explode(F.sequence(F.lit(0), F.lit(p_blocks - 1))))
    p = right.withColumn("pb", deal("neighbour", p_blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    kinds = [d.schema[c].dataType.simpleString() for d, c in ((left, "query"), (right, "neighbour"))]

    def closest(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("neighbour")
        a, b = queries[[f"_q{i}" for i in range(axes)]].to_numpy(), points[[f"_p{i}" for i in range(axes)]].to_numpy()
        ids, rows = points["neighbour"].to_numpy(), []
        for name, x in zip(queries["query"].to_numpy(), a, strict=True):
            d = np.sqrt(((b - x) ** 2).sum(axis=1))
            if same:
                d[ids == name] = np.inf
            near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
            order = near[np.argsort(d[near], kind="stable")][:k]
            order = order[np.isfinite(d[order])]
            rows.append(pd.DataFrame({"query": name, "neighbour": ids[order], "distance": d[order]}))
        return pd.concat(rows) if rows else pd.DataFrame({"query": [], "neighbour": [], "distance": []})

    return q.groupBy("qb", "pb").cogroup(p.groupBy("qb", "pb")).applyInPandas(closest, f"query {kinds[0]}, neighbour {kinds[1]}, distance double")


def pca_normals(queries: DataFrame, points: DataFrame, key: str, k: int = 8, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """(query, n<axis> ...): direction of least spread of each query's k nearest points, away from the mean of all points.

    Covariances are aggregates over the neighbours; their eigenvectors are taken in batches.
    """
    d = len(axes)
    near = nearest(queries, points, key, list(axes), k)
    pairs = [(a, b) for a in range(d) for b in range(d)]
    spread = near.join(points.select(F.col(key).alias("neighbour"), *axes), "neighbour").groupBy("query").agg(*[F.covar_pop(axes[a], axes[b]).alias(f"_s{a}{b}") for a, b in pairs])
    mean = points.agg(*[F.avg(a).alias(f"_m{i}") for i, a in enumerate(axes)])
    own = queries.select(F.col(key).alias("query"), *axes).crossJoin(F.broadcast(mean))  # with a single row
    rows = spread.join(own.select("query", F.array(*[F.col(a) - F.col(f"_m{i}") for i, a in enumerate(axes)]).alias("away")), "query")
    rows = rows.select("query", F.array(*[f"_s{a}{b}" for a, b in pairs]).alias("spread"), "away")

    def directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                least = np.linalg.eigh(as_matrix(batch.column(1)).reshape(-1, d, d))[1][:, :, 0]
                least *= np.where((least * as_matrix(batch.column(2))).sum(axis=1) < 0, -1.0, 1.0)[:, None]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in least.T]], ["query", *[f"n{a}" for a in axes]])

    kind = rows.schema["query"].dataType.simpleString()
    return rows.mapInArrow(directions, f"query {kind}, " + ", ".join(f"n{a} double" for a in axes))


def hull_2d(points: DataFrame, x: str = "x", y: str = "y", fan_in: int = 16) -> list[tuple[float, float]]:
    """Corners of the convex hull, anticlockwise: each task keeps its own points' hull, hulls are merged in rounds.

    What reaches the driver is a hull of hulls; points without a coordinate are left out.
    """

    def local(batches):
        found: list[tuple[float, float]] = []
        for batch in batches:
            found = chain(found + list(zip(batch[x].tolist(), batch[y].tolist(), strict=True)))
        yield pd.DataFrame(found, columns=[x, y], dtype=float)

    hulls = points.select(F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).dropna().mapInPandas(local, f"{x} double, {y} double")
    parts = hulls.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // fan_in)
        hulls = hulls.repartition(parts).mapInPandas(local, f"{x} double, {y} double")
    return chain([(r[x], r[y]) for r in hulls.collect()])


def chain(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Monotone chain: lower, then upper side."""
    order = sorted(set(points))
    if len(order) < 3:
        return order

    def side(sequence):
        out: list[tuple[float, float]] = []
        for p in sequence:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return side(order) + side(order[::-1])


def contained(points: DataFrame, hull: list[tuple[float, float]], tolerance: float, x: str = "x", y: str = "y") -> DataFrame:
    """Add ``inside``: on the inner side of every edge of the hull, or within ``tolerance`` of it."""
    inside = F.lit(True)
    for (ax, ay), (bx, by) in zip(hull, hull[1:] + hull[:1], strict=True):
        length = float(np.hypot(bx - ax, by - ay)) or 1.0
        inside = inside & (((F.col(x) - ax) * (by - ay) - (F.col(y) - ay) * (bx - ax)) / length <= tolerance)
    return points.withColumn("inside", inside)


def hull_area(hull: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(hull, hull[1:] + hull[:1], strict=True)) / 2


def sample_facets(facets: DataFrame, measure: str, key: str, n: int | DataFrame, runs: int = 4096, by: str | None = None) -> DataFrame:
    """``n`` samples, evenly spaced over the facets laid end to end, so each facet gets its share: ``sample``, ``at`` in [0, 1).

    Facets are laid in runs by a hash of ``key`` (null keys too), and by ``key`` within a run; runs are summed by themselves
    and moved up by a table of ``runs`` rows. With ``by``, the facets of each group are laid by themselves, and ``n`` is a
    table (``by``, count); a group without a count, or with none, gets no samples.
    """
    run, total, base, whole, inner, a, b, wanted = (free_name(facets, x) for x in ("_run", "_s", "_base", "_all", "_in", "_a", "_b", "_n"))
    group = [by] if by else []
    rows = facets.withColumn(run, F.coalesce(F.pmod(key_hash(facets, key), F.lit(runs)), F.lit(-1)))
    of_group = Window.partitionBy(*group) if by else Window.partitionBy(F.lit(1))
    before, everything = (of_group.orderBy(run).rowsBetween(Window.unboundedPreceding, end) for end in (-1, Window.unboundedFollowing))
    sums = rows.groupBy(*group, run).agg(F.sum(measure).alias(total))
    sums = sums.select(*group, run, F.coalesce(F.sum(total).over(before), F.lit(0.0)).alias(base), F.sum(total).over(everything).alias(whole))
    sums = sums.join(n.select(by, F.col("count").alias(wanted)), by) if by else F.broadcast(sums.withColumn(wanted, F.lit(n)))
    within = Window.partitionBy(*group, run).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(inner, F.coalesce(F.sum(measure).over(within), F.lit(0.0))).join(sums, [*group, run])
    start = F.round((F.col(base) + F.col(inner)) * F.col(wanted) / F.col(whole), 9)
    stop = F.round((F.col(base) + F.col(inner) + F.col(measure)) * F.col(wanted) / F.col(whole), 9)
    first, last = F.ceil(start - 0.5), F.ceil(stop - 0.5) - 1
    rows = rows.withColumn(a, start).withColumn(b, stop).filter(last >= first).withColumn("sample", F.explode(F.sequence(first, last)))
    at = (F.col("sample") + 0.5 - F.col(a)) / (F.col(b) - F.col(a))
    return rows.withColumn("at", at).drop(run, inner, base, whole, a, b, wanted)
