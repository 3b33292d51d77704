"""What a query sends to the driver, shuffles or holds at once stays in proportion to its input."""

import os
from urllib.parse import urlparse

import duckdb
import numpy as np
import pytest

from snapforge.functions import matrix
from snapforge.jobs import catalogue
from snapforge.operators import mesh, sparse, svd
from snapforge.sources.folders import shared_folder


def stages_since(spark, first):
    """Finished and running stages from number ``first`` on, as the status store knows them."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    doubles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, doubles, None)
    return [s for s in (found.apply(i) for i in range(found.size())) if s.stageId() >= first]


def next_stage(spark):
    return max([s.stageId() for s in stages_since(spark, 0)], default=-1) + 1


def test_far_points_send_nothing_to_the_driver(spark):
    """Points far from all facets find the nearest one without a copy of each for thousands of grid cells."""
    r = np.random.default_rng(3)
    centres = r.random((400, 3))
    facets = spark.createDataFrame([(i, *map(float, c), 1.0, 0.0, 0.0) for i, c in enumerate(centres)], "id bigint, cx double, cy double, cz double, nx double, ny double, nz double")
    x = r.normal(0, 1, (500, 3)) * 3
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "q bigint, x double, y double, z double")
    first = next_stage(spark)
    found = {row["query"]: row["facet"] for row in mesh.nearest_normals(points, facets, "q", "id").collect()}
    wanted = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert [found[i] for i in range(len(x))] == wanted.tolist()
    assert sum(s.resultSize() for s in stages_since(spark, first)) < 4 << 20


def test_points_in_one_dense_cell_don_t_meet_all_nodes(spark):
    """Nodes far closer than the tolerance: a point meets those of a cell or two, not every node within the tolerance."""
    r = np.random.default_rng(4)
    x, y = r.random((3000, 2)), r.random((9000, 2))
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id bigint, x double, y double")
    nodes = spark.createDataFrame([(f"n{i:04}", *map(float, p)) for i, p in enumerate(y)], "boundary string, x double, y double")
    first = next_stage(spark)
    found = {row["id"]: row["boundary"] for row in mesh.locate_boundary(points, nodes, ["x", "y"], 2.0).collect()}
    wanted = [((y - p) ** 2).sum(axis=1).argmin() for p in x]
    assert [found[i] for i in range(len(x))] == [f"n{i:04}" for i in wanted]
    assert max(s.peakExecutionMemory() for s in stages_since(spark, first)) < 512 << 20


def test_rows_gram_shuffles_no_copies(spark, tmp_path):
    """The rows' sums and largest products with others, without copies of all rows for each block of columns."""
    x = np.random.default_rng(5).standard_normal((4000, 16)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(4000, None)], "vec_id bigint, embedding array<float>")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    first = next_stage(spark)
    found = {row["i"]: (row["total"], row["largest"]) for row in catalogue.QUERIES["mat_rows_gram"](spark, str(tmp_path)).collect()}
    g = x.astype(float) @ x.T.astype(float)
    total = g.sum(axis=1)
    np.fill_diagonal(g, -np.inf)
    assert np.allclose([found[i] for i in range(4000)], np.stack([total, g.max(axis=1)], axis=1), atol=1e-4) and len(found) == 4000
    assert sum(s.shuffleWriteBytes() for s in stages_since(spark, first)) < 8 * x.size * 8


def test_rows_of_one_id_and_a_row_alone(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0]), (2, [None, 5.0])], "id bigint, v array<double>")
    found = {row["i"]: (row["total"], row["largest"]) for row in matrix.rows_with_rows(rows, "id", "v").collect()}
    assert found == {1: (5 + 3 + 10 + 3 + 9 + 0, 10), 2: (10 + 0 + 25, 10)}
    assert [tuple(row) for row in matrix.rows_with_rows(rows.filter("id = 2"), "id", "v").collect()] == [(2, 25, None)]
    assert matrix.rows_with_rows(rows.limit(0), "id", "v").count() == 0


def test_gramian_agrees_with_sql_on_halves_of_the_last_decimal(spark):
    """1,500 customers, some of whose true values end in a half of the fifth decimal."""
    sf = "/root/testdata/sf0.01"
    found = catalogue.QUERIES["lr_adi_gramian"](spark, sf).select("c_custkey", "own", "with_first").collect()
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW customer AS SELECT * FROM '{sf}/customer.parquet'")
    assert sorted(map(tuple, found)) == sorted(duck.execute(catalogue.ORACLE_SQL["lr_adi_gramian"]).fetchall())


def test_unlinked_blocks_are_solved_without_rounds(spark):
    r = np.random.default_rng(6)
    d, b, pair = -1 - r.random(300), r.standard_normal(300), 0.25
    cells = [(i, i, float(x)) for i, x in enumerate(d)] + [(2 * i, 2 * i + 1, pair) for i in range(150)]
    of = sparse.system(spark.createDataFrame(cells, "i bigint, j bigint, v double"))
    rhs = sparse.written(sparse.pieces_of(spark.createDataFrame([(i, [float(x)]) for i, x in enumerate(b)], "i bigint, vec array<double>"), 1), "rhs")
    rounds = lambda: sum(name.startswith("krylov") for name in os.listdir(urlparse(shared_folder(spark)).path))
    before = rounds()
    found = {row["i"]: complex(row["vec"][0], row["im"][0]) for row in sparse.rows_from(sparse.solve(of, rhs, 1.0, -0.5 + 0.25j), of.states).collect()}
    a = np.diag(d + 0j)
    a[np.arange(0, 300, 2), np.arange(1, 300, 2)] = pair
    assert np.abs(np.array([found[i] for i in range(300)]) - np.linalg.solve(a + (-0.5 + 0.25j) * np.eye(300), b)).max() < 1e-13
    assert rounds() == before


def test_sparse_decomposition_in_small_parts_and_with_null_cells(spark):
    """More rows than are multiplied together; null cells count as absent."""
    x = np.random.default_rng(7).standard_normal((svd.ROWS + 90, 12)) * 0.5 ** np.arange(12)
    x[:, 3:5][::3] = 0
    cells = [(i, j, float(v)) for (i, j), v in np.ndenumerate(x) if v] + [(0, 3, None), (10**6, 0, None)]
    found = svd.svd_sparse(spark.createDataFrame(cells, "i bigint, j bigint, v double").coalesce(1), 12, 3)
    assert np.allclose(found.sigma, np.linalg.svd(x, compute_uv=False)[:3], rtol=1e-9)


def test_an_unlinked_state_without_cells_is_an_error(spark):
    """Whether others share its block or it has none: nothing times its value is not its right side."""
    one = spark.createDataFrame([(0, 0, 2.0)], "i bigint, j bigint, v double")
    for lost in (1, 500):
        of = sparse.system(one.unionByName(spark.createDataFrame([(lost, lost, None)], one.schema)), one)
        rhs = sparse.written(sparse.pieces_of(spark.createDataFrame([(0, [1.0]), (lost, [1.0])], "i bigint, vec array<double>"), 1), "rhs")
        with pytest.raises(RuntimeError):
            sparse.solve(of, rhs)


def test_far_links_move_numbers_and_not_pieces(spark):
    """Each state is linked to one in another block: a product hands on sums by strip, not a piece for each link."""
    n = 4096
    i = np.arange(n)
    j = i * 1031 % n
    of = sparse.system(spark.range(n).selectExpr("id AS i", f"explode(array(struct(id AS j, -3D AS v), struct(id * 1031 % {n} AS j, 0.5D AS v))) AS c").select("i", "c.j", "c.v"))
    x = np.random.default_rng(8).standard_normal((n, 2))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "i bigint, vec array<double>")
    pieces = sparse.written(sparse.pieces_of(rows, 2), "test")
    first = next_stage(spark)
    found = sparse.written(sparse.product(of, pieces), "test")
    assert sum(s.shuffleWriteRecords() for s in stages_since(spark, first)) < n / 8
    y = np.array([row["vec"] for row in sparse.rows_from(found, of.states).orderBy("i").collect()])
    assert np.abs(y - (0.5 * x[j] - 3 * x)).max() < 1e-12


def test_a_state_linked_to_all_others(spark, monkeypatch):
    """Its links are several records, and each row is summed once; null and NaN cells make states only, also of blocks without a number."""
    monkeypatch.setattr(sparse, "LINKS", 64)
    monkeypatch.setattr(sparse, "STRIP", 256)
    r = np.random.default_rng(9)
    n, width, strangers = 300, 8, [308, 500]
    a, e = np.diag(2 + r.random(n)), np.diag(1 + r.random(n))
    a[3], a[:, 3], e[3, 50:] = r.standard_normal(n), r.standard_normal(n), 0.5
    cells = lambda m, more: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)] + more, "i bigint, j bigint, v double")
    of = sparse.system(cells(a, [(0, 500, None), (308, 308, float("nan")), (None, 1, 1.0)]), cells(e, []), width)
    x = r.standard_normal((n, 2))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "i bigint, vec array<double>")
    pieces = sparse.written(sparse.pieces_of(rows, 2, width), "test")
    for system, m in ((of, a - 1.5 * e), (of.transposed(), a.T - 1.5 * e.T)):
        y = {row["i"]: row["vec"] for row in sparse.rows_from(sparse.product(system, pieces, 1.0, -1.5), of.states).collect()}
        assert sorted(y) == [*range(n), *strangers] and not any(y[s] != [0.0, 0.0] for s in strangers)
        assert np.abs(np.array([y[k] for k in range(n)]) - m @ x).max() < 1e-12
        assert system.links.selectExpr("max(size(i)) AS n").first()["n"] < 160
