"""Large sparse systems, low-rank factors and balanced truncation against dense solvers and closed forms; repaired operators."""

import numpy as np
import pytest

from snapforge.functions import dynamics, matrix
from snapforge.operators import cells as cells_of_points
from snapforge.operators import lowrank, lyapunov, mesh, sampling, sparse, svd


def cells(spark, m):
    return spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "i bigint, j bigint, v double")


def vectors(spark, x, width):
    rows = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "i bigint, vec array<double>")
    return sparse.written(sparse.pieces_of(rows, x.shape[1], width), "test")


def dense(x, states):
    rows = sparse.rows_from(x, states).orderBy("i").collect()
    real = np.array([r["vec"] for r in rows])
    return real + 1j * np.array([r["im"] for r in rows]) if x.kind is complex else real


def coupled(n, seed=0):
    r = np.random.default_rng(seed)
    a = np.diag(-3.0 - np.arange(n) % 3) + np.diag(np.full(n - 1, 1.3), 1) + np.diag(np.full(n - 1, -0.7), -1)
    for _ in range(n):
        a[r.integers(n), r.integers(n)] += 0.2 * r.standard_normal()
    return a


@pytest.fixture
def broadcast_or_not(request, monkeypatch):
    monkeypatch.setattr(sparse, "BROADCAST", request.param)


@pytest.mark.parametrize("broadcast_or_not", [0, 1 << 24], indirect=True)
def test_solves_shifted_and_transposed(spark, broadcast_or_not):
    a, b = coupled(50), np.random.default_rng(1).standard_normal((50, 3))
    of, rhs = sparse.system(cells(spark, a), width=16), vectors(spark, b, 16)
    assert np.abs((a + 2j * np.eye(50) - np.eye(50)) @ dense(sparse.solve(of, rhs, 1.0, -1 + 2j), of.states) - b).max() < 1e-8
    assert np.abs(a.T @ dense(sparse.solve(of.transposed(), rhs), of.states) - b).max() < 1e-8


def test_solve_with_mass_matrix_zero_side_and_gaps(spark):
    a, e = coupled(20), np.eye(20) * 2 + np.diag(np.full(19, 0.3), 1)
    b = np.random.default_rng(2).standard_normal((20, 2))
    b[:, 1] = 0
    far = 1000  # ids with a gap between them
    place = lambda m: cells(spark, m).selectExpr(f"i + CASE WHEN i >= 10 THEN {far} ELSE 0 END AS i", f"j + CASE WHEN j >= 10 THEN {far} ELSE 0 END AS j", "v")
    of = sparse.system(place(a), place(e), width=8)
    rows = spark.createDataFrame([(i + far * (i >= 10), b[i].tolist()) for i in range(20)], "i bigint, vec array<double>")
    x = dense(sparse.solve(of, sparse.written(sparse.pieces_of(rows, 2, 8), "b"), 1.0, -0.5), of.states)
    assert x.shape == (20, 2) and np.abs((a - 0.5 * e) @ x - b).max() < 1e-8 and not x[:, 1].any()


def test_restarts_and_singular_systems(spark):
    n = 24
    a = np.diag(np.full(n, 2.0)) + np.diag(np.full(n - 1, -1.0), 1) + np.diag(np.full(n - 1, -1.0), -1)
    of, rhs = sparse.system(cells(spark, a), width=8), vectors(spark, np.ones((n, 1)), 8)
    assert np.abs(a @ dense(sparse.solve(of, rhs, depth=4, rounds=60), of.states) - 1).max() < 1e-8
    singular = np.zeros((4, 4))
    singular[0, 1] = singular[1, 0] = singular[2, 3] = 1.0
    with pytest.raises(RuntimeError, match="residuals"):
        sparse.solve(sparse.system(cells(spark, singular), width=8), vectors(spark, np.ones((4, 1)), 8), rounds=10)


def test_adi_factor_with_complex_shifts_and_mass(spark):
    n, r = 30, np.random.default_rng(0)
    a = np.diag(-2.0 - np.arange(n) % 3) + np.diag(np.full(n - 1, 2.3), 1) + np.diag(np.full(n - 1, -1.7), -1)
    e = np.diag(1 + 0.5 * r.random(n))
    b = r.standard_normal((n, 2))
    of, rhs = sparse.system(cells(spark, a), cells(spark, e), width=16), vectors(spark, b, 16)
    found = lowrank.lr_adi(of, rhs)
    z, x = dense(found.vectors, of.states), lyapunov.continuous(a, b, e)
    assert np.abs(z @ z.T - x).max() < 1e-8 * np.abs(x).max()
    assert lowrank.lyapunov_residual(of, found.vectors, rhs) < 1e-8


def test_smith_factor(spark):
    n, r = 20, np.random.default_rng(0)
    a, b = coupled(n) / 14, r.standard_normal((n, 2))
    of, rhs = sparse.system(cells(spark, a), width=8), vectors(spark, b, 8)
    found = lowrank.lr_smith(of, rhs)
    z, x = dense(found.vectors, of.states), lyapunov.smith(a, b)
    assert np.abs(z @ z.T - x).max() < 1e-8 * np.abs(x).max()
    assert lowrank.lyapunov_residual(of, found.vectors, rhs, discrete=True) < 1e-8
    # one step on the zero matrix gives B itself
    zero = sparse.system(spark.createDataFrame([(i, i, 0.0) for i in range(3)], "i bigint, j bigint, v double"), width=8)
    one = lowrank.lr_smith(zero, vectors(spark, np.ones((3, 1)), 8), max_iter=1)
    assert np.linalg.norm(dense(one.vectors, zero.states)) == pytest.approx(np.sqrt(3))


def test_balanced_truncation_on_factors(spark):
    r = np.random.default_rng(3)
    n = 12
    a = -np.eye(n) + 0.1 * r.standard_normal((n, n))
    a = (a + a.T) / 2
    b, c = r.standard_normal((n, 3)), r.standard_normal((2, n))
    of = sparse.system(cells(spark, a), width=8)
    found, e = lowrank.balanced_truncation(of, vectors(spark, b, 8), vectors(spark, c.T, 8), order=5)
    assert np.allclose(found.hsv[:5], [2.430606, 0.856435, 0.234924, 0.069498, 0.010662], atol=1e-5)
    assert np.allclose(e, np.eye(5), atol=1e-6)
    assert np.allclose(sorted(np.linalg.eigvals(found.a).real), sorted(np.linalg.eigvals(lyapunov.balanced_truncation(a, b, c, order=5).a).real), atol=1e-5)


def test_centring_far_from_zero(spark):
    x = 1e6 + 0.01 * np.random.default_rng(0).standard_normal((1000, 2))
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "vec array<double>")
    assert np.allclose(svd.svd_gram(rows, "vec", center=True).sigma, np.linalg.svd(x - x.mean(axis=0), compute_uv=False), rtol=1e-6)


def test_point_location_with_nulls_repeats_and_clashing_columns(spark):
    points = spark.createDataFrame([(0.0, 0.0, "a", "x", 1), (0.0, 0.0, None, None, 2), (0.0, 0.0, None, None, 2), (5.0, 5.0, "b", None, 3), (None, 0.0, "c", None, 4)], "x double, y double, note string, boundary string, _row int")
    nodes = spark.createDataFrame([("left", 0.01, 0.0), ("right", 0.01, 0.0)], "boundary string, x double, y double")
    found = mesh.locate_boundary(points, nodes, ["x", "y"], 0.1).collect()
    assert sorted((r["_row"], r["boundary"]) for r in found) == [(1, "left"), (2, "left"), (2, "left"), (3, None), (4, None)]


def test_fewer_probes_than_columns(spark):
    r = np.random.default_rng(5)
    u, v = np.linalg.qr(r.standard_normal((300, 40)))[0], np.linalg.qr(r.standard_normal((2100, 40)))[0]
    x = (u * 0.6 ** np.arange(40)) @ v.T
    rows = spark.createDataFrame([(row.tolist(),) for row in x], "vec array<double>")
    assert np.allclose(svd.svd_randomized(rows, "vec", 3).sigma, 0.6 ** np.arange(3), rtol=1e-6)


def test_driver_matrices_are_bounded(spark):
    with pytest.raises(ValueError, match="too large"):
        matrix.dense(spark.createDataFrame([(0, 0, 1.0), (99, 99, 1.0)], "i bigint, j bigint, v double"), cells=100)


def test_text_keys_split(spark):
    rows = spark.createDataFrame([(f"key {i}",) for i in range(50)] + [(None,)], "name string")
    found = sampling.train_validation_split(rows, "name", 0.2)
    assert sorted(r["count"] for r in found.groupBy("split").count().collect()) == [10, 41]


def test_blocked_product(spark):
    r = np.random.default_rng(0)
    a, b = r.standard_normal((21, 30)), r.standard_normal((30, 13))
    a[:, 8:16] = 0  # a block column of nothing
    found = matrix.dense(matrix.matmul_blocked(cells(spark, a), cells(spark, b), width=8))
    assert np.abs(found - a @ b).max() < 1e-12
    assert matrix.matmul_blocked(cells(spark, a).limit(0), cells(spark, b), width=8).count() == 0


def test_neighbours_by_cells(spark):
    """Clusters, repeats and an outlier in five axes, against all distances; cells keep their size."""
    r = np.random.default_rng(0)
    x = np.vstack([r.standard_normal((120, 5)), 1e-6 * r.standard_normal((60, 5)), np.full((70, 5), 0.5), [[1e9] * 5]])
    rows = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)] + [(999, None, 0.0, 0.0, 0.0, 0.0)], "id bigint, a double, b double, c double, d double, e double")
    axes = list("abcde")
    found = cells_of_points.nearest(rows.filter("id % 10 = 0"), rows, "id", axes, 4, size=32).collect()
    for q in range(0, len(x), 10):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        wanted = np.lexsort((np.arange(len(x)), d))[:4]
        own = sorted((n["rank"], n["neighbour"], n["distance"]) for n in found if n["query"] == q)
        assert [n[1] for n in own] == wanted.tolist() and np.allclose([n[2] for n in own], d[wanted])
    leaves, _, _ = cells_of_points.grow(cells_of_points.complete(rows, "id", axes, "neighbour"), 5, 32)
    sizes = [n["count"] for n in leaves.groupBy("node").count().collect()]
    assert max(sizes) <= 32 and sum(sizes) == len(x)
    assert cells_of_points.nearest(rows.limit(0), rows, "id", axes, 4).count() == 0
    assert cells_of_points.nearest(rows.filter("id < 3"), rows.filter("id < 3"), "id", axes, 4).count() == 6


def test_dynamics_recover_a_known_matrix(spark):
    r = np.random.default_rng(0)
    k = np.array([[0.9, 0.2, 0.0], [-0.3, 0.8, 0.1], [0.0, 0.1, 0.5]])
    rows = []
    for series in range(20):
        x = r.standard_normal(3)
        for step in range(6):
            rows.append((series, step, x.tolist()))
            x = k @ x
    rows.append((99, 0, None))
    states = spark.createDataFrame(rows, "s int, t int, x array<double>")
    found = dynamics.fit(dynamics.with_successor(states, "s", "t", "x"), "x", "successor")
    assert np.allclose(found.k, k)
    assert np.allclose(np.abs(found.eigenvalues), sorted(np.abs(np.linalg.eigvals(k)), reverse=True))
    losses = {row["step"]: (row["n"], row["loss"]) for row in dynamics.rollout_loss(states, "s", "t", "x", found, 8).collect()}
    assert sorted(losses) == [1, 2, 3, 4, 5] and all(n == 20 and loss < 1e-20 for n, loss in losses.values())
    with pytest.raises(ValueError, match="ridge"):
        dynamics.fit(spark.createDataFrame([([1.0, 0.0], [1.0, 0.0])], "x array<double>, y array<double>"), "x", "y")
