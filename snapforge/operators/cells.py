"""Nearest neighbours by cells of bounded size: a tree of cuts at quantiles, whose nodes are tables.

A cell with more points than ``size`` is cut at the eighths of its widest axis, what lies on a cut apart from what lies between, so
a value that many points share parts from the rest; equal points, which no
axis parts, are dealt by their id's hash. So no cell exceeds its size, whatever outliers, clusters or repeats there are. A query is first answered
from its own cell; its k-th distance there bounds the search, which goes down the tree into those cells only whose box is within reach.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapforge.functions.matrix import as_matrix
from snapforge.sources.folders import write_table

FAN = 16
#: Nodes of one level that may be broadcast; with more of them, each has few points and is met by a shuffle.
BROADCAST = 50_000
#: Queries that meet a cell's points in one task.
BLOCK = 4096


def complete(rows: DataFrame, key: str, axes: list[str], name: str) -> DataFrame:
    """(name, p): id and coordinates of the rows that have all of them."""
    p = F.array(*[F.col(a).cast("double") for a in axes])
    return rows.select(F.col(key).alias(name), p.alias("p")).filter(~F.exists("p", lambda x: x.isNull() | F.isnan(x)))


def _near(table: DataFrame, nodes: int) -> DataFrame:
    return F.broadcast(table) if nodes <= BROADCAST else table


def _bucket(identity: str) -> Column:
    """The part, one of ``FAN``, of a cut cell that a row falls into: by the cuts of the cell's axis, or by its id where all points are equal."""
    x = F.element_at("p", F.col("axis") + 1)
    return F.when(F.col("alike"), F.pmod(F.xxhash64(identity), F.lit(FAN))).otherwise(F.size(F.filter("cuts", lambda c: c < x)) + F.size(F.filter("cuts", lambda c: c <= x)))


def grow(points: DataFrame, axes: int, size: int, rounds: int = 12) -> tuple[DataFrame, list[tuple[DataFrame, int]], list[tuple[DataFrame, int]]]:
    """Leaves (node, neighbour, p), and for each level its nodes (node, n, low, high, leaf) and its cuts (node, axis, alike, cuts) with their numbers.

    A node's parts are numbered node * FAN + 1 and on. ``rounds`` cuts hold for any number of points that Spark can.
    """
    rows, leaves, levels, cuts = write_table(points.withColumn("node", F.lit(0).cast("long")), "points"), [], [], []
    ends = [f(F.element_at("p", i + 1)).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(axes)]
    for depth in range(rounds + 1):
        box = [F.array(*[f"{name}{i}" for i in range(axes)]).alias(name) for name in ("low", "high")]
        nodes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *ends).select("node", "n", *box)
        nodes = write_table(nodes.withColumn("leaf", (F.col("n") <= size) | F.lit(depth == rounds)), "nodes")
        levels.append((nodes, nodes.count()))
        spans = F.zip_with("high", "low", lambda a, b: a - b)
        large = nodes.filter(~F.col("leaf")).select("node", (F.array_position(spans, F.array_max(spans)) - 1).cast("int").alias("axis"), (F.array_max(spans) == 0).alias("alike"))
        n_large = large.count()
        marked = rows.join(_near(large, n_large), "node", "left")
        leaves.append(marked.filter("axis IS NULL").select("node", "neighbour", "p"))
        if not n_large:
            break
        inner = marked.filter("axis IS NOT NULL")
        at = F.percentile_approx(F.element_at("p", F.col("axis") + 1), [k / (FAN // 2) for k in range(1, FAN // 2)]).alias("cuts")
        own = write_table(inner.groupBy("node", "axis", "alike").agg(at), "cuts")
        cuts.append((own, n_large))
        moved = rows.join(_near(own, n_large), "node").withColumn("node", F.col("node") * FAN + 1 + _bucket("neighbour"))
        rows = write_table(moved.select("neighbour", "p", "node"), "points")
    return write_table(reduce(DataFrame.unionByName, leaves), "leaves"), levels, cuts


def _reach(far: bool) -> Column:
    """Least (or largest) distance from ``p`` to a box, from ``low`` and ``high``."""
    gap = lambda p, low, high: F.greatest(F.abs(p - low), F.abs(p - high)) if far else F.greatest(low - p, p - high, F.lit(0.0))
    gaps = F.transform(F.arrays_zip("p", "low", "high"), lambda x: gap(x["p"], x["low"], x["high"]))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g))


def _search(pairs: DataFrame, leaves: DataFrame, k: int, same: bool) -> DataFrame:
    """(query, neighbour, distance): the k nearest of each pair's (query, p, node) cell. Cells with many queries are met by several tasks."""
    blocks = pairs.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    asked = pairs.join(blocks, "node").select("node", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int").alias("block"), "query", "p")
    given = leaves.join(blocks, "node").select("node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "neighbour", "p")
    kinds = [f.schema[c].dataType.simpleString() for f, c in ((pairs, "query"), (leaves, "neighbour"))]

    def closest(key: tuple, queries: pa.Table, points: pa.Table) -> pa.Table:
        points = points.sort_by("neighbour")
        b, ids = as_matrix(points.column("p").combine_chunks()) if len(points) else np.zeros((0, 1)), points.column("neighbour")
        names, found, own = queries.column("query"), [[], [], []], {}
        for at, other in enumerate(ids.to_pylist() if same else []):
            own.setdefault(other, []).append(at)
        for row, (x, name) in enumerate(zip(queries.column("p").to_pylist(), names.to_pylist(), strict=True)):
            d = np.sqrt(((b - np.array(x)) ** 2).sum(axis=1)) if len(b) else np.zeros(0)
            if same:
                d[own.get(name, [])] = np.inf
            near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
            near = near[np.argsort(d[near], kind="stable")][:k]
            near = near[np.isfinite(d[near])]
            found[0] += [row] * len(near)
            found[1] += near.tolist()
            found[2] += d[near].tolist()
        columns = [names.take(pa.array(found[0], pa.int64())), ids.take(pa.array(found[1], pa.int64())), pa.array(found[2], pa.float64())]
        return pa.Table.from_arrays(columns, ["query", "neighbour", "distance"])

    return asked.groupBy("node", "block").cogroup(given.groupBy("node", "block")).applyInArrow(closest, f"query {kinds[0]}, neighbour {kinds[1]}, distance double")


def nearest(queries: DataFrame, points: DataFrame, key: str, axes: list[str], k: int, same: bool = True, size: int = 1024, within: float | None = None) -> DataFrame:
    """(query, neighbour, distance, rank): exactly the k nearest points of each query, ties by id.

    With ``same``, queries are points too, and a point isn't its own neighbour. Ids are unique; rows without a coordinate are left out. Fewer
    than k points give fewer neighbours, and none an empty result. Points farther than ``within`` aren't looked for.
    """
    leaves, levels, cuts = grow(complete(points, key, axes, "neighbour"), len(axes), size)
    asked = write_table(complete(queries, key, axes, "query"), "queries")
    home = asked.withColumn("node", F.lit(0).cast("long")).withColumn("bound", F.lit(float("inf") if within is None else float(within)))
    for level, (nodes, n) in enumerate(levels):  # down to the query's own cell; a box with enough points bounds the search
        known = home.join(_near(nodes.select("node", "n", "low", "high", "leaf"), n), "node", "left")
        bound = F.when(F.col("n") >= k + int(same), F.least("bound", _reach(True))).otherwise(F.col("bound"))
        home = known.withColumn("bound", bound).select("query", "p", "node", "bound")
        if level < len(cuts):
            own, m = cuts[level]
            down = home.join(_near(own, m), "node", "left")
            home = down.withColumn("node", F.coalesce(F.col("node") * FAN + 1 + _bucket("query"), "node")).select("query", "p", "node", "bound")
    home = write_table(home, "home")
    first = write_table(_search(home.select("query", "p", "node"), leaves, k, same), "first")
    kth = first.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("d")).filter(F.col("n") >= k).select("query", "d")
    open_ = home.join(kth, "query", "left").select("query", "p", F.col("node").alias("own"), (F.least("bound", F.coalesce("d", F.lit(float("inf")))) * (1 + 1e-9)).alias("bound"))
    frontier, reached = open_.withColumn("node", F.lit(0).cast("long")), []
    for level, (nodes, n) in enumerate(levels):
        if level:
            inner = nodes.withColumn("parent", F.floor((F.col("node") - 1) / FAN)).withColumnRenamed("node", "part")
            frontier = frontier.join(_near(inner, n), F.col("node") == F.col("parent")).drop("parent", "node").withColumnRenamed("part", "node")
        else:
            frontier = frontier.join(_near(nodes, n), "node")
        frontier = write_table(frontier.filter(_reach(False) <= F.col("bound")).select("query", "p", "own", "bound", "node", "leaf"), "frontier")
        reached.append(frontier.filter(F.col("leaf") & (F.col("node") != F.col("own"))).select("query", "p", "node"))
        frontier = frontier.filter(~F.col("leaf")).drop("leaf")
    others = _search(reduce(DataFrame.unionByName, reached), leaves, k, same)
    best = Window.partitionBy("query").orderBy("distance", "neighbour")
    both = first.unionByName(others)
    both = both if within is None else both.filter(F.col("distance") <= float(within))
    return both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
