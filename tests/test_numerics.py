"""Decompositions and solvers against NumPy and closed forms."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snapforge.functions import losses, matrix
from snapforge.operators import lyapunov, mesh, sampling, svd
from snapforge.sources import meshes
from snapforge.streaming.incremental import stream_svd


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, vec array<double>")


def test_variants_agree_with_numpy(spark):
    x = np.random.default_rng(1).standard_normal((40, 6))
    rows, wanted = frame(spark, x).repartition(5), np.linalg.svd(x, compute_uv=False)
    for found in (svd.svd_gram(rows, "vec"), svd.svd_tsqr(rows, "vec"), svd.svd_randomized(rows, "vec", 6)):
        assert np.allclose(found.sigma, wanted, atol=1e-8)
        assert np.allclose(found.basis.T @ found.basis, np.eye(6), atol=1e-8)
    centred = svd.svd_gram(rows, "vec", rank=3, center=True)
    assert np.allclose(centred.sigma, np.linalg.svd(x - x.mean(axis=0), compute_uv=False)[:3])
    error = svd.reconstruction_error(rows, "vec", svd.svd_gram(rows, "vec", rank=2)).first()[0]
    assert error == pytest.approx(np.sqrt((wanted[2:] ** 2).sum() / (wanted**2).sum()))


def test_tsqr_keeps_small_values(spark):
    u = np.linalg.qr(np.random.default_rng(0).standard_normal((50, 3)))[0]
    rows = frame(spark, u * np.array([1, 1e-6, 1e-10]))
    assert np.allclose(svd.svd_tsqr(rows, "vec").sigma, [1, 1e-6, 1e-10], rtol=1e-4)


def test_empty_and_null_vectors(spark):
    empty = spark.createDataFrame([], "id bigint, vec array<double>")
    for f in (svd.svd_gram, svd.svd_tsqr):
        assert len(f(empty, "vec").sigma) == 0
    some = spark.createDataFrame([(1, [3.0, 4.0]), (2, None)], "id bigint, vec array<double>")
    assert np.allclose(svd.svd_gram(some, "vec").sigma, [5.0])


@pytest.mark.parametrize(("tol", "rank"), [(0.1, 2), (0.01, 3), (None, 3)])
def test_truncation(tol, rank):
    assert svd.truncation_rank(np.array([3.0, 2.0, 1.0]), tol=tol) == rank


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 8), st.integers(0, 10**6))
def test_lyapunov_residuals(n, seed):
    r = np.random.default_rng(seed)
    a = r.standard_normal((n, n))
    stable, b = a - (np.abs(np.linalg.eigvals(a)).max() + 0.5) * np.eye(n), r.standard_normal((n, 2))
    x = lyapunov.continuous(stable, b)
    assert np.linalg.norm(stable @ x + x @ stable.T + b @ b.T) < 1e-6 * max(1, np.linalg.norm(b @ b.T))
    e = np.eye(n) * 2
    y = lyapunov.continuous(stable, b, e)
    assert np.linalg.norm(stable @ y @ e.T + e @ y @ stable.T + b @ b.T) < 1e-6 * max(1, np.linalg.norm(b @ b.T))
    small = a / (np.abs(np.linalg.eigvals(a)).max() + 0.5) * 0.9
    z = lyapunov.smith(small, b)
    assert np.linalg.norm(small @ z @ small.T - z + b @ b.T) < 1e-8 * max(1, np.linalg.norm(z))


def test_smith_basis_of_zero_matrix():
    z = lyapunov.smith_basis(np.zeros((3, 3)), np.ones((3, 1)), max_iter=1)
    assert z.shape == (3, 1)
    assert np.linalg.norm(z) == pytest.approx(1)


def test_balanced_truncation_of_symmetric_system():
    r = np.random.default_rng(3)
    a = -np.eye(12) + 0.1 * r.standard_normal((12, 12))
    a = (a + a.T) / 2
    b, c = r.standard_normal((12, 3)), r.standard_normal((2, 12))
    found = lyapunov.balanced_truncation(a, b, c, order=5)
    assert np.allclose(found.hsv[:5], [2.430606, 0.856435, 0.234924, 0.069498, 0.010662], atol=1e-5)
    assert found.order == 5


def test_structured_grid_boundary(spark):
    m, n = 7, 5
    node = lambda x, y: x * 100 + y
    quads = spark.createDataFrame([([node(x, y), node(x + 1, y), node(x + 1, y + 1), node(x, y + 1)],) for x in range(m) for y in range(n)], "conn array<bigint>")
    assert mesh.boundary_facets(quads, "quad").count() == 2 * (m + n)
    assert mesh.boundary_facets(mesh.split_quads(quads), "triangle").count() == 2 * (m + n)
    tetra = spark.createDataFrame([([0, 1, 2, 3],), ([1, 2, 3, 4],)], "conn array<bigint>")
    assert mesh.boundary_facets(tetra, "tetra").count() == 6


def test_largest_remainder_and_batches(spark):
    weights = spark.createDataFrame([("interior", 2.0), ("left", 1.0)], "name string, weight double")
    counts = sampling.apportion(weights, "name", "weight", 5)
    assert dict(counts.select("name", "count").collect()) == {"interior": 3, "left": 2}
    assert sampling.expand(counts, "name").count() == 5
    inner = spark.createDataFrame([(0.2,)], "x double")
    outer = spark.createDataFrame([(0.0, -1.0)], "x double, normal double")
    assert {tuple(r) for r in sampling.concat_batches(inner, outer).collect()} == {(0.2, None), (0.0, -1.0)}


def test_split_keeps_both_sides(spark):
    rows = spark.range(10).withColumnRenamed("id", "key")
    assert sampling.train_validation_split(rows, "key").filter("split = 'validation'").count() == 2
    assert sampling.train_validation_split(rows.limit(1), "key").filter("split = 'validation'").count() == 0


def test_factors_multiply_to_the_matrix(spark):
    x = np.random.default_rng(1).standard_normal((10, 6))
    rows = frame(spark, x).repartition(3)
    found = svd.svd_tsqr(rows, "vec")
    back = svd.reconstruct(svd.left_factor(rows, "id", "vec", found), "id", "vec", found).orderBy("id").collect()
    assert np.allclose([r["vec"] for r in back], x)
    centred = svd.svd_gram(rows, "vec", center=True)
    back = svd.reconstruct(svd.left_factor(rows, "id", "vec", centred), "id", "vec", centred, add_mean=True).orderBy("id").collect()
    assert np.allclose([r["vec"] for r in back], x)
    mean = x.mean(axis=0)
    low = svd.svd_gram(rows, "vec", rank=2, center=True)
    truth = np.linalg.norm((x - mean) - (x - mean) @ low.basis @ low.basis.T) / np.linalg.norm(x - mean)
    assert svd.reconstruction_error(rows, "vec", low).first()[0] == pytest.approx(truth)


def test_wide_states_and_inner_products(spark):
    r = np.random.default_rng(2)
    x, weights = r.standard_normal((2000, 5)), r.uniform(1, 3, 2000)
    found, left = svd.svd_dual(frame(spark, x), "id", "vec")
    u = np.array([row["vec"] for row in left.orderBy("id").collect()])
    assert np.allclose(found.sigma, np.linalg.svd(x, compute_uv=False)) and np.allclose(u * found.sigma @ found.basis.T, x)
    product = spark.createDataFrame([(i, i, float(w)) for i, w in enumerate(weights)], "i bigint, j bigint, v double")
    found, left = svd.svd_dual(frame(spark, x), "id", "vec", product=product)
    u = np.array([row["vec"] for row in left.orderBy("id").collect()])
    assert np.allclose(u.T @ (weights[:, None] * u), np.eye(5), atol=1e-8) and np.allclose(u * found.sigma @ found.basis.T, x)


def test_states_outnumber_what_the_driver_could_hold(spark):
    cells = spark.range(100_000).select(F.col("id").alias("i"), F.posexplode(F.array(*[F.sin(F.col("id") * (k + 1) * 0.001) for k in range(20)])).alias("j", "v"))
    states = matrix.rows_of(cells.select("i", F.col("j").cast("long").alias("j"), "v"), 20)
    found, left = svd.svd_dual(states, "i", "vec", rank=5)
    assert left.count() == 100_000 and len(found.sigma) == 5
    assert np.allclose(matrix.dense(matrix.gram(left, "vec")), np.eye(5), atol=1e-8)


@pytest.mark.parametrize("variant", ["standard", "brand"])
def test_batches_fold_to_the_whole(spark, variant):
    x = np.random.default_rng(1).standard_normal((12, 4))
    wanted = svd.svd_tsqr(frame(spark, x), "vec")
    found = svd.svd_incremental([frame(spark, part) for part in (x[:2], x[2:3], x[3:3], x[3:])], "vec", variant=variant)
    assert np.allclose(found.sigma, wanted.sigma) and np.allclose(np.abs(found.basis.T @ wanted.basis), np.eye(4), atol=1e-8)
    cut = svd.svd_incremental([frame(spark, x[:6]), frame(spark, x[6:])], "vec", rank=2, variant=variant)
    assert len(cut.sigma) == 2 and np.allclose(cut.basis.T @ cut.basis, np.eye(2), atol=1e-8)


def test_streams_fold_new_files_only(spark, tmp_path):
    x = np.random.default_rng(4).standard_normal((30, 3))
    path, checkpoint = str(tmp_path / "rows"), str(tmp_path / "state")
    frame(spark, x[:20]).repartition(4).write.parquet(path)
    first = stream_svd(spark, path, frame(spark, x).schema, "vec", checkpoint=checkpoint, files_per_batch=1)
    assert np.allclose(first.sigma, np.linalg.svd(x[:20], compute_uv=False))
    frame(spark, x[20:]).coalesce(1).write.mode("append").parquet(path)
    both = stream_svd(spark, path, frame(spark, x).schema, "vec", checkpoint=checkpoint, files_per_batch=1)
    assert np.allclose(both.sigma, np.linalg.svd(x, compute_uv=False))


def test_sparse_and_orthogonal(spark):
    r = np.random.default_rng(6)
    x = np.where(r.random((60, 12)) < 0.2, r.standard_normal((60, 12)), 0)
    cells = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in np.argwhere(x)], "i bigint, j bigint, v double")
    assert np.allclose(svd.svd_sparse(cells, 12, 4).sigma, np.linalg.svd(x, compute_uv=False)[:4], rtol=1e-6)
    q = np.array([row["vec"] for row in svd.orthogonalise(frame(spark, r.standard_normal((9, 3))), "id", "vec").collect()])
    assert np.allclose(q.T @ q, np.eye(3))
    with pytest.raises(ValueError, match="dependent"):
        svd.orthogonalise(frame(spark, np.ones((5, 2))), "id", "vec")


def test_small_matrix_operators(spark):
    left = matrix.to_long(frame(spark, [[1, 2], [3, 4], [5, 6]]), "id", "vec")
    right = matrix.to_long(frame(spark, [[0.5, 1], [1.5, 2], [2.5, 3]]), "id", "vec")
    found = matrix.dense(matrix.low_rank_apply(left, right, matrix.identity(spark, 3)))
    assert np.allclose(found, [[2.5, 5.5, 8.5], [5.5, 12.5, 19.5], [8.5, 19.5, 30.5]])
    with pytest.raises(ValueError, match="same number of columns"):
        matrix.low_rank_apply(left, matrix.to_long(frame(spark, [[1, 2, 3]]), "id", "vec"), left)
    normal = matrix.dense(matrix.random_normal(spark, 300, 20))
    assert abs(normal.mean()) < 0.05 and abs(normal.std() - 1) < 0.05
    assert np.allclose(matrix.dense(matrix.random_normal(spark, 300, 20).repartition(3)), normal)
    assert matrix.dense(matrix.reshape(left, 2, 3)).tolist() == [[1, 2, 3], [4, 5, 6]]


def test_ranks_of_null_and_repeated_keys(spark):
    rows = spark.createDataFrame([(None, i) for i in range(3)] + [(i // 5, i) for i in range(50)], "key bigint, rank int").withColumn("_bucket", F.lit(1))
    split = sampling.train_validation_split(rows, "key", 0.1)
    assert split.count() == 53 and split.columns == ["key", "rank", "_bucket", "split"]
    assert sorted(r["key"] is None for r in split.filter("split = 'validation'").collect()) == [False, False, True, True, True]


def test_weights_and_counts_are_checked(spark):
    for bad in ([], [("a", -1.0)], [("a", 0.0)], [("a", None)], [("a", float("nan"))]):
        with pytest.raises(ValueError):
            sampling.apportion(spark.createDataFrame(bad, "name string, weight double"), "name", "weight", 5)
    with pytest.raises(ValueError, match="negative"):
        sampling.apportion(spark.createDataFrame([("a", 1.0)], "name string, weight double"), "name", "weight", -1)
    drawn = sampling.sample_with_replacement(spark.range(10).withColumnRenamed("id", "key"), "key", 500)
    counts = [r["count"] for r in drawn.groupBy("key").count().collect()]
    assert sum(counts) == 500 and len(counts) == 10 and max(counts) < 90


@pytest.mark.parametrize(("mode", "values", "delta", "waits", "best"), [
    ("min", [1.0, 0.95, 0.88], 0.1, [0, 1, 0], 0.88), ("max", [1.0, 1.05, 1.12], 0.1, [0, 1, 0], 1.12), ("min", [2.0, None, float("nan"), 1.0], 0.0, [0, 1, 2, 0], 1.0)])
def test_early_stop_compares_with_the_accepted_best(spark, mode, values, delta, waits, best):
    found = losses.early_stop(spark.createDataFrame(list(enumerate(values)), "epoch int, loss double"), "epoch", "loss", 2, delta, mode=mode).orderBy("epoch").collect()
    assert [r["wait"] for r in found] == waits and found[-1]["best"] == best


def test_early_stop(spark):
    history = spark.createDataFrame(list(enumerate([5.0, 4.0, 4.5, 4.6, 3.0])), "epoch int, loss double")
    found = losses.early_stop(history, "epoch", "loss", 2).orderBy("epoch").collect()
    assert [r["wait"] for r in found] == [0, 0, 1, 2, 0]
    assert [r["stopped"] for r in found] == [False, False, False, True, True]


def test_strata_are_whole_when_hashes_are_alike(spark):
    same = [((i << 32) + 3, "same") for i in range(400)]  # one hash for all, at 0.85 of the range
    few = [((i << 32) + i % 3, "few") for i in range(400)]
    rows = spark.createDataFrame([*same, *few, (None, "tiny"), (7, "tiny")], "key bigint, name string")
    counts = spark.createDataFrame([("same", 60), ("few", 150), ("tiny", 5), ("none", 3)], "name string, count bigint")
    found = sampling.sample_strata(rows, counts, "name", "key").collect()
    by_hash = lambda r: (r[0] * sampling.MULTIPLIER % sampling.MODULUS, r[0])
    assert {r["key"] for r in found if r["name"] == "same"} == {(i << 32) + 3 for i in range(60)}
    assert {r["key"] for r in found if r["name"] == "few"} == {r[0] for r in sorted(few, key=by_hash)[:150]}
    assert len([r for r in found if r["name"] == "tiny"]) == 2


def test_boundary_nodes_are_taken_whole(spark):
    from snapforge.jobs import catalogue

    points = catalogue.points_of(spark, "/root/testdata/sf0.001").collect()
    expected = {p["vec_id"]: "side0" if any(n["label"] == 0 and math.hypot(p["x"] - n["x"], p["y"] - n["y"]) <= 0.02 for n in points) else None for p in points}
    found = {r["vec_id"]: r["boundary"] for r in catalogue.QUERIES["locate_boundary_label"](spark, "/root/testdata/sf0.001").collect()}
    assert found == expected and sum(x is not None for x in found.values()) >= sum(p["label"] == 0 for p in points) > 0


def test_locate_prefers_first_name_on_ties(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 9.0)], "id int, x double, y double")
    nodes = spark.createDataFrame([("b", 0.1, 0.0), ("a", -0.1, 0.0)], "boundary string, x double, y double")
    found = mesh.locate_boundary(points, nodes, ["x", "y"], 0.5).orderBy("id").collect()
    assert [r["boundary"] for r in found] == ["a", None]


def test_hull_and_area(spark):
    r = np.random.default_rng(5)
    inner = r.uniform(0.1, 0.9, (200, 2)).tolist()
    points = spark.createDataFrame([(float(x), float(y)) for x, y in [*inner, (0, 0), (1, 0), (1, 1), (0, 1), (0.5, 0.0)]] + [(None, 0.0)], "x double, y double").repartition(5)
    hull = mesh.hull_2d(points)
    assert sorted(hull) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert mesh.hull_area(hull) == pytest.approx(1)
    other = spark.createDataFrame([(0.5, 0.5), (1.5, 0.5), (1.0, 1.0)], "x double, y double")
    assert [r["inside"] for r in mesh.contained(other, hull, 1e-9).collect()] == [True, False, True]


def test_nearest_in_many_blocks(spark):
    x = np.random.default_rng(7).random((60, 2))
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id bigint, x double, y double")
    found = mesh.nearest(points.filter("id % 10 = 0"), points, "id", ["x", "y"], 3, block=7).collect()
    for q in range(0, 60, 10):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        assert [r["neighbour"] for r in sorted(found, key=lambda r: r["rank"]) if r["query"] == q] == np.argsort(d)[:3].tolist()


def test_grid_and_blocks_agree(spark):
    r = np.random.default_rng(8)
    x = np.vstack([r.random((300, 3)), 50 + r.random((3, 3)), np.ones((40, 3))])  # a crowd, three far away, and one place many times
    rows = [(i, *map(float, p)) for i, p in enumerate(x)] + [(999, None, 0.0, 0.0), (998, float("nan"), 0.0, 0.0)]
    points = spark.createDataFrame(rows, "id bigint, x double, y double, z double")
    found = mesh.nearest(points, points, "id", ["x", "y", "z"], 5)
    slow = mesh.nearest(points, points, "id", ["x", "y", "z"], 5, rounds=0)
    key = lambda d: {(r["query"], r["rank"]): (r["neighbour"], round(r["distance"], 9)) for r in d.collect()}
    assert key(found) == key(slow) and len(key(found)) == 343 * 5
    alone = points.filter("id = 0")
    assert mesh.nearest(alone, alone, "id", ["x", "y", "z"], 5).count() == 0
    assert mesh.nearest(points, points.limit(0), "id", ["x", "y", "z"], 5).count() == 0


def test_triangles_in_space(spark):
    nodes = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 2.0, 0.0, 0.0), (2, 0.0, 2.0, 0.0), (3, 0.0, 0.0, 1.0)], "node_id bigint, x double, y double, z double")
    facets = spark.createDataFrame([(1, [0, 1, 2], "a"), (2, [0, 2, 1], "b"), (3, [0, 1, 3], "b")], "id bigint, facet array<bigint>, boundary string")
    found = {r["id"]: r for r in mesh.triangle_geometry(facets, nodes).collect()}
    assert [found[i]["area"] for i in (1, 2, 3)] == [2, 2, 1]
    assert (found[1]["nz"], found[2]["nz"], found[3]["ny"]) == (1, -1, -1)
    assert found[1]["cx"] == pytest.approx(2 / 3)
    points = mesh.sample_boundaries(mesh.triangle_geometry(facets, nodes), "id", 50).collect()
    assert sum(p["boundary"] == "a" for p in points) == 20
    assert all(abs(p["z"]) < 1e-12 and p["x"] >= 0 and p["y"] >= 0 and p["x"] + p["y"] <= 2 for p in points if p["boundary"] == "a")
    assert mesh.facet_corners(facets.filter("id = 3"), nodes).count() == 3
    normals = mesh.nearest_normals(spark.createDataFrame([(9, 0.0, -1.0, 0.3)], "id bigint, x double, y double, z double"), mesh.triangle_geometry(facets, nodes), "id", "id").collect()
    assert normals[0]["facet"] == 3


MSH = """$MeshFormat
2.2 0 8
$EndMeshFormat
$PhysicalNames
2
1 1 "left"
2 2 "plate"
$EndPhysicalNames
$Nodes
4
1 0 0 0
2 1 0 0
3 1 1 0
4 0 1 0
$EndNodes
$Elements
3
1 1 2 1 5 4 1
2 2 2 2 6 1 2 3
3 2 2 2 6 1 3 4
$EndElements
"""
INP = """** comment
*HEADING
plate
*NODE
1, 0., 0.
2, 1., 0.
3, 1., 1.
4, 0., 1.
*ELEMENT, TYPE=T2D2, ELSET=left
1, 4, 1
*Element, type=CPS3, elset=plate
2, 1, 2, 3
3, 1, 3, 4
*END
"""


@pytest.mark.parametrize(("name", "text", "read"), [("m.msh", MSH, meshes.read_msh), ("m.inp", INP, meshes.read_inp)])
def test_mesh_files(spark, tmp_path, name, text, read):
    (tmp_path / name).write_text(text)
    nodes, cells = read(spark, str(tmp_path))
    assert {tuple(r) for r in nodes.collect()} == {(1, 0, 0, 0), (2, 1, 0, 0), (3, 1, 1, 0), (4, 0, 1, 0)}
    assert {(r["cell_id"], r["cell_type"], tuple(r["conn"]), r["set_name"].lower()) for r in cells.collect()} == {
        (1, "line", (4, 1), "left"), (2, "triangle", (1, 2, 3), "plate"), (3, "triangle", (1, 3, 4), "plate")}
    names = {r["set_name"] for r in cells.collect()}
    plate = next(n for n in names if n.lower() == "plate")
    faces = meshes.boundary_faces(cells, 2, rename={plate: "edge"}).collect()
    assert sorted(tuple(r["facet"]) for r in faces if r["boundary"] == "edge") == [(1, 2), (2, 3), (3, 4), (4, 1)]
    assert [tuple(r["facet"]) for r in faces if r["boundary"] != "edge"] == [(4, 1)]
    assert meshes.boundary_faces(cells, 2, keep=["none"]).count() == 0


def test_sets_and_facets_are_checked(spark):
    cells = spark.createDataFrame([(1, "quad", [0, 1, 2, 3], "a"), (2, "triangle6", [4, 5, 6, 7, 8, 9], "a"), (3, "hexahedron", list(range(8)), "b"), (4, "tetra", [0, 1, 2, 3], None)], "cell_id bigint, cell_type string, conn array<bigint>, set_name string")
    assert sorted(tuple(r["facet"]) for r in meshes.boundary_faces(cells, 3).collect()) == [(0, 1, 2), (0, 2, 3), (4, 5, 6)]
    nodes = spark.range(4).select(F.col("id").alias("node_id"))
    facets = meshes.boundary_faces(cells, 3)
    with pytest.raises(ValueError, match="doesn't exist"):
        meshes.checked_facets(facets, nodes)
    points = spark.createDataFrame([("p", 1), ("p", 1), ("q", 2)], "set_name string, node_id bigint")
    assert meshes.boundary_nodes(points, cells, keep=["p", "a"]).count() == 11
    assert meshes.boundary_nodes(points, cells, keep=["a"], use_cells=False).count() == 0
    assert meshes.dimension_of("tetra10") == 3
    with pytest.raises(KeyError):
        meshes.dimension_of("unknown")


def test_batches_of_regions(spark):
    left = [(i, "left", -1.0, 0.0) for i in range(3)]
    rows = spark.createDataFrame([(i + 10, "interior", None, None) for i in range(3)] + left, "id bigint, region string, nx double, ny double")
    counts = lambda **n: spark.createDataFrame(list(n.items()), "region string, count bigint")
    batch = sampling.region_batch(rows, counts(interior=1, left=2), "region", "id").collect()
    assert sorted(r["region"] for r in batch) == ["interior", "left", "left"]
    assert [r["nx"] for r in sorted(batch, key=lambda r: r["region"])] == [None, -1.0, -1.0]
    assert sampling.region_batch(rows, counts(interior=2, left=0), "region", "id").count() == 2
    assert len({r["id"] for r in sampling.region_batch(rows, counts(left=40), "region", "id").collect()}) == 3
    for bad in (counts(left=0), counts(nowhere=1)):
        with pytest.raises(ValueError):
            sampling.region_batch(rows, bad, "region", "id")
    weights = spark.createDataFrame([("interior", 2.0), ("left", 1.0)], "region string, w double")
    found = sampling.weighted_batch(rows, weights, "region", "w", "id", 5).collect()
    assert sorted((r["region"], round(r["weight"], 6)) for r in found) == [("interior", 0.666667)] * 3 + [("left", 0.333333)] * 2


def test_derivatives_and_pairs(spark):
    rows = spark.createDataFrame([("a", i, float(i * i)) for i in (0, 1, 2, 3, 5)], "line string, i int, v double")
    found = {r["i"]: (r["first"], r["second"]) for r in losses.grid_derivatives(rows, ["line"], "i", "v").collect()}
    assert found[1] == (2.0, 2.0) and found[2] == (4.0, 2.0) and found[0] == found[3] == found[5] == (None, None)
    pairs = losses.step_pairs(rows, "line", ["i"], "v", 2).orderBy("step").collect()
    assert [(r["v"], r["target"]) for r in pairs] == [(0.0, 4.0), (1.0, 9.0), (4.0, 25.0)]


def test_states_are_saved_and_loaded(spark, tmp_path):
    state = {"w": np.arange(6.0).reshape(2, 3), "b": np.ones(3)}
    matrix.save_state(state, spark, str(tmp_path / "state"))
    back = matrix.load_state(spark, str(tmp_path / "state"), strict=("w", "b"))
    assert np.array_equal(back["w"], state["w"]) and back["b"].tolist() == [[1, 1, 1]]
    with pytest.raises(KeyError):
        matrix.load_state(spark, str(tmp_path / "state"), strict=("none",))
