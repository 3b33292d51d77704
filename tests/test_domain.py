"""Domains: construction, normals on facets and points, batches."""

import math

import pytest
from pyspark.sql import functions as F

from snapforge.operators import domain as dom


@pytest.fixture(scope="module")
def square(spark):
    """A 4 x 4 grid of nodes with its left and right sides as edges, its bottom and one corner as points."""
    nodes = spark.createDataFrame([(10 * x + y, float(x), float(y), "n") for x in range(4) for y in range(4)] + [(99, None, 1.0, "n")], "node_id bigint, x double, y double, note string")
    faces = [("left", [y, y + 1]) for y in range(3)] + [("right", [30 + y, 31 + y]) for y in range(3)] + [("right", [33, 33])]
    points = [("bottom", 10 * x) for x in range(4)] + [("bottom", 10), ("corner", 33), ("left", 0)]
    return dom.build(nodes, ("x", "y"), spark.createDataFrame(points, "boundary string, node_id bigint"), spark.createDataFrame(faces, "boundary string, facet array<bigint>"))


def test_construction(spark, square):
    assert square.tolerance == pytest.approx(3e-6) and square.hull_tolerance == pytest.approx(3e-9) and square.centre == (1.5, 1.5)
    assert {r["boundary"]: (r["measure"], r["faceted"]) for r in square.measures().collect()} == {"left": (3.0, True), "right": (3.0, True), "bottom": (4.0, False), "corner": (1.0, False)}
    assert {r["region"]: (r["kind"], r["dim"]) for r in square.regions().collect()} == {"interior": ("interior", 2), **{b: ("boundary", 1) for b in ("left", "right", "bottom", "corner")}}
    assert {r["boundary"]: r["count"] for r in square.boundary.groupBy("boundary").count().collect()} == {"left": 4, "right": 4, "bottom": 4, "corner": 1}
    with pytest.raises(ValueError):
        dom.build(square.nodes.limit(0), ("x", "y"))
    with pytest.raises(ValueError):
        dom.build(square.nodes, ("x", "y"), faces=spark.createDataFrame([("b", [0, 1234])], "boundary string, facet array<bigint>"))
    with pytest.raises(ValueError):
        dom.build(square.nodes, ("x",))


def test_normals(spark, square):
    places = [(1, 0.0, 1.2), (2, 3.0, 2.0), (3, 1.0, 0.0)]
    points = spark.createDataFrame([(*p, None, 7) for p in places], "id bigint, x double, y double, note string, nx int")
    named = points.withColumn("boundary", F.element_at(F.create_map(*[F.lit(v) for v in (1, "left", 2, "right", 3, "bottom")]), F.col("id").cast("int")))
    found = {r["id"]: (r["boundary"], r["nx"], r["ny"]) for r in dom.boundary_normals(square, named, "id").collect()}
    assert found[1] == ("left", -1.0, 0.0) and found[2] == ("right", 1.0, 0.0)
    assert found[3][0] == "bottom" and found[3][1] == pytest.approx(0, abs=1e-9) and found[3][2] == pytest.approx(-1)
    single = dom.boundary_normals(square, points.filter("id = 2"), "id", "corner").first()  # one node: away from the middle
    assert (single["nx"], single["ny"]) == (pytest.approx(1.5 / math.hypot(1.5, 0.5)), pytest.approx(0.5 / math.hypot(1.5, 0.5)))
    located = dom.boundary_normals(square, points.filter("id = 3"), "id").first()
    assert located["boundary"] == "bottom"
    with pytest.raises(ValueError):
        dom.boundary_normals(square, points, "id")  # (0, 1.2) is on no boundary node
    with pytest.raises(ValueError):
        dom.boundary_normals(square, points, "id", "elsewhere")


def test_batches(square):
    batch = dom.mixed_batch(square, {"interior": 20, "left": 6, "bottom": 3, "corner": 2, "right": 0}).collect()
    sizes = {r: sum(x["region"] == r for x in batch) for r in ("interior", "left", "bottom", "corner", "right")}
    assert sizes == {"interior": 20, "left": 6, "bottom": 3, "corner": 2, "right": 0}
    for r in batch:
        assert (r["nx"] is None) == (r["region"] == "interior")
        if r["region"] != "interior":
            assert math.hypot(r["nx"], r["ny"]) == pytest.approx(1)
        if r["region"] == "left":
            assert r["x"] == 0.0 and (r["nx"], r["ny"]) == (-1.0, 0.0)
    assert sorted(r["y"] for r in batch if r["region"] == "left") == pytest.approx([0.25, 0.75, 1.25, 1.75, 2.25, 2.75])
    merged = dom.merged_boundary_batch(square, 22).collect()  # by 3, 3, 4 and 1
    assert {r: sum(x["region"] == r for x in merged) for r in ("left", "right", "bottom", "corner")} == {"left": 6, "right": 6, "bottom": 8, "corner": 2}
    for bad in ({}, {"left": 0}, {"elsewhere": 2}):
        with pytest.raises(ValueError):
            dom.boundary_batch(square, bad)


def test_weights_and_combined_samplers(square):
    batch = dom.weighted_batch(square, 7, {"interior": 2.0, "left": 1.0, "right": 1.0}).collect()
    assert sorted((r["region"], r["weight"]) for r in batch) == [("interior", 0.5)] * 3 + [("left", 0.25)] * 2 + [("right", 0.25)] * 2  # 3.5, 1.75 and 1.75
    even = dom.weighted_batch(square, 8, interior=False).collect()
    assert {(r["region"], r["weight"]) for r in even} == {(b, 0.25) for b in ("left", "right", "bottom", "corner")} and len(even) == 8
    middle = dom.Sampler(lambda d, n: dom.random_interior(d, n).withColumn("x", F.lit(1.5)), dom.RANDOM.boundary)
    mixed = dom.mixed_batch(square, {"interior": 3, "left": 2}, middle).collect()
    assert [r["x"] for r in mixed if r["region"] == "interior"] == [1.5] * 3 and sum(r["region"] == "left" for r in mixed) == 2


def test_solids(spark):
    """A tetrahedron's two faces as one boundary: points lie in them, with their normals."""
    nodes = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 1.0)], "node_id bigint, x double, y double, z double")
    faces = spark.createDataFrame([("floor", [0, 2, 1]), ("wall", [0, 1, 3]), ("flat", [0, 1, 1])], "boundary string, facet array<bigint>")
    found = dom.merged_boundary_batch(dom.build(nodes, faces=faces), 40).collect()
    assert len(found) == 40
    for r in found:
        assert (r["nx"], r["ny"], r["nz"]) == ((0.0, 0.0, -1.0) if r["region"] == "floor" else (0.0, -1.0, 0.0))
        assert (r["z"] if r["region"] == "floor" else r["y"]) == 0 and min(r["x"], r["y"], r["z"]) >= 0 and r["x"] + r["y"] + r["z"] <= 1 + 1e-12
