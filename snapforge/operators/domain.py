"""Domains of meshes: nodes, named boundaries with facets or only points, tolerances, normals, and batches of sampled points.

A domain is a few tables. Samples are drawn by hashes, so a seed gives the same batch on any number of executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapforge.functions.matrix import as_matrix, free_name
from snapforge.operators import cells, mesh
from snapforge.operators.sampling import apportion, concat_batches, region_batch
from snapforge.sources.folders import write_table
from snapforge.sources.meshes import checked_facets

INTERIOR = "interior"


@dataclass(frozen=True)
class Domain:
    """``nodes`` (node_id, axes), ``boundary`` (boundary, node_id, axes) and ``facets`` (boundary, facet, key, p0 ..., measure, c<axis>, n<axis>)."""

    axes: tuple[str, ...]
    nodes: DataFrame
    boundary: DataFrame
    facets: DataFrame
    tolerance: float
    hull_tolerance: float
    centre: tuple[float, ...]

    @property
    def normals(self) -> list[str]:
        return [f"n{a}" for a in self.axes]

    def measures(self) -> DataFrame:
        """(boundary, measure, faceted): area or length of a boundary with facets, else its number of points; one row a boundary."""
        whole = self.facets.groupBy("boundary").agg(F.sum("measure").alias("measure"), F.lit(True).alias("faceted"))
        points = self.boundary.join(whole.select("boundary"), "boundary", "left_anti")
        return whole.unionByName(points.groupBy("boundary").agg(F.count(F.lit(1)).cast("double").alias("measure"), F.lit(False).alias("faceted")))

    def regions(self) -> DataFrame:
        """(region, kind, dim): the interior and every boundary."""
        d = len(self.axes)
        inner = self.nodes.sparkSession.range(1).select(F.lit(INTERIOR).alias("region"), F.lit("interior").alias("kind"), F.lit(d).alias("dim"))
        return inner.unionByName(self.boundary.select(F.col("boundary").alias("region"), F.lit("boundary").alias("kind"), F.lit(d - 1).alias("dim")).distinct())

    def locate(self, points: DataFrame) -> DataFrame:
        """Add ``boundary``: the nearest boundary node's within the domain's tolerance, else null."""
        return mesh.locate_boundary(points, self.boundary, list(self.axes), self.tolerance)


def build(nodes: DataFrame, axes: tuple[str, ...] = ("x", "y", "z"), points: DataFrame | None = None, faces: DataFrame | None = None,
          tolerance: float | None = None, hull_tolerance: float | None = None) -> Domain:
    """A domain of two or three axes from nodes (node_id, axes), points (boundary, node_id) and faces (boundary, facet: node ids).

    Facets are edges in two dimensions and triangles in three; one with an unknown node is an error, one without extent is left out. The
    corners of a boundary's facets are its nodes too, together with its points; nodes at one place count once. Tolerances
    default to 1e-6 and 1e-9 of the longest extent. Nodes without a coordinate are left out; none at all is an error.
    """
    d, spark = len(axes), nodes.sparkSession
    if d not in (2, 3):
        raise ValueError("domains have two or three axes")
    nodes = nodes.select("node_id", *[F.col(a).cast("double").alias(a) for a in axes]).dropna()
    box = nodes.agg(F.count(F.lit(1)).alias("n"), *[f(a).alias(f"{name}{a}") for a in axes for name, f in (("low", F.min), ("high", F.max), ("mean", F.avg))]).first()
    if not box["n"]:
        raise ValueError("the domain has no nodes")
    extent = max(box[f"high{a}"] - box[f"low{a}"] for a in axes)
    centre = tuple(box[f"mean{a}"] for a in axes)
    empty = lambda schema: spark.createDataFrame([], schema)
    points = points.select("boundary", "node_id") if points is not None else empty("boundary string, node_id bigint")
    faces = checked_facets(faces.select("boundary", "facet"), nodes) if faces is not None else empty("boundary string, facet array<bigint>")
    facets = write_table(_geometry(faces, nodes, axes, centre), "facets")
    used = points.unionByName(facets.select("boundary", F.explode("facet").alias("node_id")))
    boundary = used.join(nodes, "node_id").groupBy("boundary", *axes).agg(F.min("node_id").alias("node_id"))
    return Domain(tuple(axes), nodes, write_table(boundary.select("boundary", "node_id", *axes), "boundary"), facets,
                  max(extent * 1e-6, 1e-12) if tolerance is None else tolerance, max(extent * 1e-9, 1e-12) if hull_tolerance is None else hull_tolerance, centre)


def _geometry(faces: DataFrame, nodes: DataFrame, axes: tuple[str, ...], centre: tuple[float, ...]) -> DataFrame:
    """Corners, measure, centroid and unit normal; an edge's normal points away from the mean of the nodes, a triangle's follows its corners."""
    names = [*[f"c{a}" for a in axes], *[f"n{a}" for a in axes]]
    if len(axes) == 3:
        placed = nodes.select("node_id", *[F.col(a).alias(b) for a, b in zip(axes, "xyz", strict=True)])
        rows = mesh.triangle_geometry(faces, placed).withColumnRenamed("area", "measure")
        rows = rows.select("boundary", "facet", "p0", "p1", "p2", "measure", *[F.col(f"{m}{b}").alias(f"{m}{a}") for m in "cn" for a, b in zip(axes, "xyz", strict=True)])
    else:
        rows = faces.select("*", *[F.get("facet", F.lit(i)).alias(f"_f{i}") for i in range(2)])
        for i in range(2):
            rows = rows.join(nodes.select(F.col("node_id").alias(f"_f{i}"), F.array(*axes).alias(f"p{i}")), f"_f{i}").drop(f"_f{i}")
        at = lambda p, a: F.get(p, F.lit(a))
        step = [at("p1", a) - at("p0", a) for a in range(2)]
        mid = [(at("p0", a) + at("p1", a)) / 2 for a in range(2)]
        rows = rows.select("boundary", "facet", "p0", "p1", F.sqrt(step[0] * step[0] + step[1] * step[1]).alias("measure"), *[m.alias(n) for m, n in zip([*mid, step[1], -step[0]], names, strict=True)])
        inward = sum((F.col(n) * (F.col(c) - m) for n, c, m in zip(names[2:], names[:2], centre, strict=True)), F.lit(0.0)) < 0
        sign = F.when(inward, -1.0).otherwise(1.0) / F.col("measure")
        rows = rows.filter("measure > 0").select("boundary", "facet", "p0", "p1", "measure", *names[:2], *[(F.col(n) * sign).alias(n) for n in names[2:]])
    return rows.filter("measure > 0").withColumn("key", F.concat_ws("-", "facet"))


def boundary_normals(domain: Domain, points: DataFrame, key: str, boundary: str | None = None, neighbours: int = 8) -> DataFrame:
    """Add ``boundary`` and the unit normal n<axis> to points (unique ``key``, axes) on boundaries.

    All points belong to ``boundary``, or to what their own column ``boundary`` names, or else to where they are located; a point off every
    boundary, or of an unknown one, is an error. On a boundary with facets it's the normal of the facet with the nearest centroid; elsewhere the
    direction of least spread of the nearest ``neighbours`` boundary nodes, away from the mean of the domain's nodes. Neighbours without
    extent enough to have one (a single node) give the direction from that mean; there, a point at the mean itself is an error.
    """
    d, axes, normals = len(domain.axes), list(domain.axes), domain.normals
    if boundary is not None:
        points = points.withColumn("boundary", F.lit(boundary))
    elif "boundary" not in points.columns:
        points = domain.locate(points)
    points = write_table(points.drop(*normals), "on-boundary")
    names = domain.measures().select("boundary", "faceted", F.dense_rank().over(_one_row_each("boundary")).alias("_i"))
    known = write_table(points.select(key, "boundary", *axes).join(F.broadcast(names), "boundary", "left"), "known")  # one row a boundary
    if known.filter("_i is null").limit(1).count():
        raise ValueError("a point is on no boundary: give its boundary, or a larger tolerance")
    far = known.agg(*[F.max(F.abs(a)).alias(a) for a in axes]).first()
    box = domain.boundary.agg(*[F.max(F.abs(a)).alias(a) for a in axes]).first()
    apart = 8.0 * sum((far[a] or 0.0) + (box[a] or 0.0) for a in axes) + 1.0  # farther than any two points are, so neighbours are of one boundary
    lift = lambda rows, name, places: rows.join(F.broadcast(names.withColumnRenamed("boundary", name)), name).select("*", *[F.col(p).alias(f"_a{i}") for i, p in enumerate(places)], (F.col("_i") * apart).alias("_lift"))
    spots = [*[f"_a{i}" for i in range(d)], "_lift"]
    asked = lift(known.select(key, "boundary", *axes), "boundary", axes)
    # facets
    facets = domain.facets.withColumn("_id", F.monotonically_increasing_id())
    facets = write_table(facets, "numbered-facets")
    flat = cells.nearest(asked.filter("faceted").withColumnRenamed(key, "_id"), lift(facets, "boundary", [f"c{a}" for a in axes]).select("_id", *spots), "_id", spots, 1, same=False)
    by_facet = flat.join(facets.select(F.col("_id").alias("neighbour"), *normals), "neighbour").select(F.col("query").alias(key), *normals)
    # points only
    nodes = write_table(domain.boundary.withColumn("_id", F.monotonically_increasing_id()), "numbered-nodes")
    loose = lift(nodes, "boundary", axes).filter(~F.col("faceted"))
    k = max(neighbours, d)
    near = cells.nearest(asked.filter(~F.col("faceted")).withColumnRenamed(key, "_id"), loose.select("_id", *spots), "_id", spots, k, same=False).filter(F.col("distance") < apart / 2)
    pairs = [(a, b) for a in range(d) for b in range(d)]
    spread = near.join(nodes.select(F.col("_id").alias("neighbour"), *axes), "neighbour").groupBy("query").agg(*[F.covar_pop(axes[a], axes[b]).alias(f"_s{a}{b}") for a, b in pairs])
    away = known.select(F.col(key).alias("query"), F.array(*[F.col(a) - F.lit(m) for a, m in zip(axes, domain.centre, strict=True)]).alias("away"))
    rows = spread.join(away, "query").select("query", F.array(*[f"_s{a}{b}" for a, b in pairs]).alias("spread"), "away")
    kind = rows.schema["query"].dataType.simpleString()
    by_spread = rows.mapInArrow(_least_spread(d, normals), f"query {kind}, " + ", ".join(f"{n} double" for n in normals)).withColumnRenamed("query", key)
    return points.join(by_facet.unionByName(by_spread), key)


def _one_row_each(name: str):
    from pyspark.sql import Window

    return Window.orderBy(name)  # over one row a boundary


def _least_spread(d: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            away = as_matrix(batch.column(2))
            values, vectors = np.linalg.eigh(as_matrix(batch.column(1)).reshape(-1, d, d))
            radial = values[:, 1] <= 1e-14 * np.maximum((away * away).sum(axis=1), 1e-300) if d == 2 else values[:, 1] <= 1e-12 * values[:, 2]
            normal = np.where(radial[:, None], away, vectors[:, :, 0])
            length = np.linalg.norm(normal, axis=1)
            if not (length > 0).all():
                raise ValueError("a point at the mean of the nodes has no normal")
            normal = normal / length[:, None] * np.where((normal * away).sum(axis=1) < 0, -1.0, 1.0)[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in normal.T]], ["query", *names])

    return directions


@dataclass(frozen=True)
class Sampler:
    """How regions are sampled: ``interior`` (domain, n) and ``boundary`` (domain, table of (boundary, count)) each give (region, sample, axes).

    Facet samples also carry their facet's normal. A sampler may combine one's interior with another's boundary.
    """

    interior: Callable[[Domain, int], DataFrame]
    boundary: Callable[[Domain, DataFrame], DataFrame]


def random_interior(domain: Domain, n: int) -> DataFrame:
    """``n`` nodes, without repeats while there are enough."""
    rows = domain.nodes.withColumn("region", F.lit(INTERIOR))
    return region_batch(rows, rows.sparkSession.createDataFrame([(INTERIOR, n)], "region string, count bigint"), "region", "node_id").select("region", "sample", *domain.axes)


def random_boundary(domain: Domain, counts: DataFrame) -> DataFrame:
    """Each boundary's ``count``: points of its facets by their measure, evenly spaced over them, or else of its nodes."""
    counts = counts.filter("count > 0").select("boundary", "count").join(domain.measures().select("boundary", "faceted"), "boundary")
    state = counts.groupBy("faceted").count().collect()  # two rows at most
    kinds, found = {r["faceted"] for r in state}, []
    if True in kinds:
        found.append(_on_facets(domain, counts.filter("faceted").drop("faceted")))
    if False in kinds:
        rows = domain.boundary.join(counts.select("boundary"), "boundary", "left_semi")
        drawn = region_batch(rows, counts.filter(~F.col("faceted")).drop("faceted"), "boundary", "node_id")
        found.append(drawn.select(F.col("boundary").alias("region"), (F.col("sample") - 1).alias("sample"), *domain.axes))
    return concat_batches(*found)


def _on_facets(domain: Domain, counts: DataFrame, seed: int = 0) -> DataFrame:
    if len(domain.axes) == 3:
        rows = domain.facets.withColumnRenamed("measure", "area").select("boundary", "key", "area", "p0", "p1", "p2", *[F.col(n).alias(f"n{b}") for n, b in zip(domain.normals, "xyz", strict=True)])
        drawn = mesh.sample_triangles(rows, "key", counts, seed, by="boundary")
        return drawn.select(F.col("boundary").alias("region"), "sample", *[F.col(b).alias(a) for a, b in zip(domain.axes, "xyz", strict=True)], *[F.col(f"n{b}").alias(n) for n, b in zip(domain.normals, "xyz", strict=True)])
    drawn = mesh.sample_facets(domain.facets, "measure", "key", counts, by="boundary")
    corner = lambda p, a: F.get(p, F.lit(a))
    place = [(corner("p0", a) + F.col("at") * (corner("p1", a) - corner("p0", a))).alias(name) for a, name in enumerate(domain.axes)]
    return drawn.select(F.col("boundary").alias("region"), "sample", *place, *domain.normals)


RANDOM = Sampler(random_interior, random_boundary)


def boundary_batch(domain: Domain, counts: Mapping[str, int], sampler: Sampler = RANDOM) -> DataFrame:
    """(region, sample, axes, n<axis>): ``counts[name]`` points of each boundary with unit normals; counts of zero or less are left out.

    No positive count, or a boundary that doesn't exist, is an error.
    """
    asked = {name: int(n) for name, n in counts.items() if n > 0}
    if not asked:
        raise ValueError("some count must be positive")
    spark = domain.nodes.sparkSession
    table = spark.createDataFrame(list(asked.items()), "boundary string, count bigint")
    stray = table.join(domain.measures().select("boundary"), "boundary", "left_anti").first()
    if stray is not None:
        raise ValueError(f"the domain has no boundary {stray['boundary']}")
    drawn = write_table(sampler.boundary(domain, table), "boundary-samples")
    missing = [n for n in domain.normals if n not in drawn.columns]
    for n in missing:
        drawn = drawn.withColumn(n, F.lit(None).cast("double"))
    bare = drawn.filter(reduce(Column.__or__, [F.col(n).isNull() for n in domain.normals]))
    if not bare.limit(1).count():
        return drawn
    row = free_name(bare, "_row")
    numbered = write_table(bare.drop(*domain.normals).withColumnRenamed("region", "boundary").withColumn(row, F.monotonically_increasing_id()), "bare-samples")
    given = boundary_normals(domain, numbered, row).withColumnRenamed("boundary", "region").drop(row)
    return drawn.dropna(subset=domain.normals).unionByName(given.select(*drawn.columns))


def mixed_batch(domain: Domain, counts: Mapping[str, int], sampler: Sampler = RANDOM) -> DataFrame:
    """``boundary_batch`` of the boundaries in ``counts`` together with points of ``interior``, whose normals are null."""
    inner, outer = counts.get(INTERIOR, 0), {k: n for k, n in counts.items() if k != INTERIOR and n > 0}
    if inner <= 0:
        return boundary_batch(domain, outer, sampler)
    batch = sampler.interior(domain, int(inner))
    return concat_batches(boundary_batch(domain, outer, sampler), batch) if outer else batch.select("*", *[F.lit(None).cast("double").alias(n) for n in domain.normals])


def weighted_batch(domain: Domain, n: int, weights: Mapping[str, float] | None = None, sampler: Sampler = RANDOM, interior: bool = True) -> DataFrame:
    """``n`` points shared out among regions by ``weights`` (largest remainders, ties by name), with the normalised weight of their region.

    Without weights, every boundary and (with ``interior``) the interior weigh the same.
    """
    spark = domain.nodes.sparkSession
    if not weights:
        weights = {r["region"]: 1.0 for r in domain.regions().collect() if interior or r["kind"] == "boundary"}  # one row a region
    table = spark.createDataFrame([(k, float(w)) for k, w in weights.items()], "region string, weight double")
    shares = apportion(table, "region", "weight", n).collect()
    total = sum(r["weight"] for r in shares)
    batch = mixed_batch(domain, {r["region"]: r["count"] for r in shares}, sampler)
    share = spark.createDataFrame([(r["region"], r["weight"] / total) for r in shares], "region string, weight double")
    return batch.drop("weight").join(F.broadcast(share), "region")  # one row a region


def merged_boundary_batch(domain: Domain, n: int, sampler: Sampler = RANDOM) -> DataFrame:
    """``n`` points of all boundaries together, shared out by their area or length, or number of points where they have no facets."""
    shares = apportion(domain.measures().select("boundary", "measure"), "boundary", "measure", n)
    return boundary_batch(domain, {r["boundary"]: r["count"] for r in shares.collect()}, sampler)
