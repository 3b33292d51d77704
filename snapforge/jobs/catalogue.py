"""Queries over the given tables, one for each operator, with equivalent DuckDB SQL where SQL has one."""

from __future__ import annotations

import itertools
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapforge.functions import losses, matrix
from snapforge.jobs import networks, systems  # noqa: F401 (their queries are registered on import)
from snapforge.jobs.registry import ORACLE_SQL, QUERIES, query, rounded  # noqa: F401
from snapforge.operators import cells as cells_of_points
from snapforge.operators import lyapunov, mesh, sampling, svd
from snapforge.sources import meshes
from snapforge.sources.folders import shared_folder, table
from snapforge.streaming.incremental import stream_gram, stream_svd

LONG = "long AS (SELECT vec_id AS i, unnest(range(len(embedding))) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings)"
GRAM = f"{LONG}, gram AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM long a JOIN long b USING (i) GROUP BY a.j, b.j)"


def embedding_matrix(spark: SparkSession, d: str) -> DataFrame:
    return matrix.to_long(table(spark, d, "embeddings"), "vec_id", "embedding")


# Matrices

@query(f"WITH {LONG} SELECT j AS i, i AS j, round(v, 6) + 0.0 AS v FROM long")
def mat_transpose(spark, d):
    return matrix.transpose(embedding_matrix(spark, d)).select("i", "j", rounded("v"))


@query(f"WITH {LONG} SELECT i, j, round(v * 2.5, 6) + 0.0 AS v FROM long")
def mat_scale(spark, d):
    return matrix.scale(embedding_matrix(spark, d), 2.5).select("i", "j", rounded("v"))


@query(f"WITH {LONG} SELECT i, j, round(sum(v), 6) + 0.0 AS v FROM (SELECT * FROM long UNION ALL SELECT i, 63 - j, 0.5 * v FROM long) GROUP BY i, j")
def mat_sum(spark, d):
    a = embedding_matrix(spark, d)
    return matrix.add(a, matrix.scale(a.withColumn("j", 63 - F.col("j")), 0.5)).select("i", "j", rounded("v"))


@query(f"WITH {GRAM} SELECT i, j, round(v, 6) + 0.0 AS v FROM gram")
def mat_gram(spark, d):
    return matrix.gram(table(spark, d, "embeddings"), "embedding").select("i", "j", rounded("v"))


@query(f"WITH {LONG}, x AS (SELECT vec_id AS i, label::DOUBLE AS v FROM embeddings), p AS (SELECT j, sum(long.v * x.v) AS v FROM long JOIN x USING (i) GROUP BY j) "
       "SELECT j AS i, 0::BIGINT AS j, round(v, 6) + 0.0 AS v FROM p")
def mat_vec_apply(spark, d):
    e = table(spark, d, "embeddings")
    x = e.select(F.col("vec_id").alias("i"), F.lit(0).cast("long").alias("j"), F.col("label").cast("double").alias("v"))
    return matrix.matmul(matrix.transpose(embedding_matrix(spark, d)), x).select("i", "j", rounded("v"))


@query(f"WITH {LONG}, x AS (SELECT vec_id AS i, label::DOUBLE AS v FROM embeddings), p AS (SELECT j, sum(long.v * x.v) AS w FROM long JOIN x USING (i) GROUP BY j) "
       "SELECT i, 0::BIGINT AS j, round(sum(v * w), 5) + 0.0 AS v FROM long JOIN p USING (j) GROUP BY i")
def lowrank_apply(spark, d):
    a = embedding_matrix(spark, d)
    x = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.lit(0).cast("long").alias("j"), F.col("label").cast("double").alias("v"))
    return matrix.low_rank_apply(a, a, x).select("i", "j", rounded("v", 5))


@query(f"WITH {GRAM} SELECT round((SELECT sqrt(sum(v * v)) FROM long), 6) AS norm, round((SELECT sum(v) FROM gram WHERE i = j), 6) AS trace")
def mat_norms(spark, d):
    norm = matrix.frobenius(embedding_matrix(spark, d)).select(rounded("norm"))
    return norm.crossJoin(matrix.trace(matrix.gram(table(spark, d, "embeddings"), "embedding")).select(rounded("trace")))  # one row each


@query(f"WITH {LONG} SELECT i, j, round(v - m, 6) + 0.0 AS v FROM long JOIN (SELECT j, avg(v) AS m FROM long GROUP BY j) USING (j)")
def snapshot_mean_center(spark, d):
    a = embedding_matrix(spark, d)
    return a.join(a.groupBy("j").agg(F.avg("v").alias("m")), "j").select("i", "j", (F.round(F.col("v") - F.col("m"), 6) + 0.0).alias("v"))


@query(f"WITH {LONG} SELECT (i * 64 + j) // 16 AS i, (i * 64 + j) % 16 AS j, round(v, 6) + 0.0 AS v FROM long")
def mat_reshape(spark, d):
    return matrix.reshape(embedding_matrix(spark, d), 64, 16).select("i", "j", rounded("v"))


@query("SELECT l_orderkey AS i, l_linenumber AS j, round(l_discount, 6) AS re, round(-l_tax, 6) + 0.0 AS im FROM lineitem")
def mat_conjugate(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_linenumber").alias("j"), F.col("l_discount").alias("re"), F.col("l_tax").alias("im"))
    return matrix.conjugate(a).select("i", "j", rounded("re"), rounded("im"))


@query("SELECT min(p_partkey) AS p_partkey, arg_min(p_retailprice, p_partkey) AS p_retailprice FROM part GROUP BY round(p_retailprice, 0)")
def distinct_rows_rounded(spark, d):
    return matrix.distinct_rounded(table(spark, d, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"], "p_partkey", 0)


# Decompositions

@query("""WITH g AS (SELECT sum(l_quantity * l_quantity) / 1000 AS a, sum(l_quantity * l_discount) / 1000 AS b, sum(l_discount * l_discount) / 1000 AS d FROM lineitem),
r AS (SELECT (a + d) / 2 AS m, sqrt(((a - d) / 2) ** 2 + b * b) AS h FROM g)
SELECT 0 AS k, round(sqrt(m + h), 5) AS sigma FROM r UNION ALL SELECT 1, round(sqrt(m - h), 5) FROM r""")
def svd2_closed_form(spark, d):
    rows = table(spark, d, "lineitem").select((F.array("l_quantity", "l_discount")).alias("vec"))
    found = svd.svd_gram(rows, "vec")
    return svd.Decomposition(found.sigma / np.sqrt(1000), found.basis).frame(spark).select("k", rounded("sigma", 5))


EMBEDDINGS = f"WITH {LONG} SELECT i, j, round(v, 4) + 0.0 AS v FROM long"


def product_of_factors(rows: DataFrame, key: str, vec: str, found: svd.Decomposition) -> DataFrame:
    """U S V^T in long form."""
    back = svd.reconstruct(svd.left_factor(rows, key, vec, found), key, vec, found, add_mean=True)
    return matrix.to_long(back, key, vec).select("i", "j", rounded("v", 4))


@query(EMBEDDINGS)
def svd_static(spark, d):
    """The three factors multiply to the matrix."""
    rows = table(spark, d, "embeddings")
    return product_of_factors(rows, "vec_id", "embedding", svd.svd_gram(rows, "embedding"))


@query(EMBEDDINGS)
def svd_static_centred(spark, d):
    rows = table(spark, d, "embeddings")
    return product_of_factors(rows, "vec_id", "embedding", svd.svd_gram(rows, "embedding", center=True))


@query(EMBEDDINGS)
def svd_tsqr(spark, d):
    rows = table(spark, d, "embeddings")
    return product_of_factors(rows, "vec_id", "embedding", svd.svd_tsqr(rows, "embedding"))


UNIT = "SELECT x.i::BIGINT AS i, y.j::BIGINT AS j, CASE WHEN x.i = y.j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM range({n}) x(i), range({n}) y(j)"


@query(UNIT.format(n=64))
def svd_left_orthonormal(spark, d):
    """U^T U of the embeddings is the identity."""
    rows = table(spark, d, "embeddings")
    return matrix.gram(svd.left_factor(rows, "vec_id", "embedding", svd.svd_tsqr(rows, "embedding")), "embedding").select("i", "j", rounded("v"))


@query(UNIT.format(n=64))
def qr_orthonormal(spark, d):
    return matrix.gram(svd.orthogonalise(table(spark, d, "embeddings"), "vec_id", "embedding"), "embedding").select("i", "j", rounded("v"))


# The two leading values and the leading right vector of (quantity, discount), scaled alike, in closed form.
PLANE = """g AS (SELECT sum((l_quantity / 50) ** 2) AS a, sum(l_quantity / 50 * l_discount * 10) AS b, sum((l_discount * 10) ** 2) AS d FROM lineitem),
r AS (SELECT a, b, (a + d) / 2 AS m, sqrt(((a - d) / 2) ** 2 + b * b) AS h FROM g),
w AS (SELECT m, h, b / sqrt(b * b + (m + h - a) ** 2) AS x, (m + h - a) / sqrt(b * b + (m + h - a) ** 2) AS y FROM r)"""
PLANE_SVD = f"WITH {PLANE} SELECT 0 AS k, round(sqrt(m + h), 5) AS sigma, round(x, 6) AS x, round(y, 6) AS y FROM w UNION ALL SELECT 1, round(sqrt(m - h), 5), round(CASE WHEN y >= x THEN y ELSE -y END, 6), round(CASE WHEN y >= x THEN -x ELSE x END, 6) FROM w"


def plane_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10).alias("vec"))


def plane_svd(spark: SparkSession, found: svd.Decomposition) -> DataFrame:
    rows = [(k, float(s), *map(float, found.basis[:, k])) for k, s in enumerate(found.sigma)]
    return spark.createDataFrame(rows, "k int, sigma double, x double, y double").select("k", rounded("sigma", 5), rounded("x"), rounded("y"))


@query(PLANE_SVD)
def svd_randomized(spark, d):
    return plane_svd(spark, svd.svd_randomized(plane_rows(spark, d), "vec", 2))


@query(PLANE_SVD)
def svd_sparse(spark, d):
    cells = matrix.to_long(plane_rows(spark, d).select(F.monotonically_increasing_id().alias("id"), "vec"), "id", "vec").filter("v <> 0")
    return plane_svd(spark, svd.svd_sparse(cells, 2, 2))


def line_batches(spark: SparkSession, d: str) -> list[DataFrame]:
    """Seven batches of unlike sizes: the orders' first lines, their second lines, and so on."""
    return [plane_rows(spark, d).filter(F.col("l_linenumber") == n) for n in range(1, 8)]


@query(PLANE_SVD)
def svd_incremental_standard(spark, d):
    return plane_svd(spark, svd.svd_incremental(line_batches(spark, d), "vec"))


@query(PLANE_SVD)
def svd_incremental_brand(spark, d):
    return plane_svd(spark, svd.svd_incremental(line_batches(spark, d), "vec", variant="brand"))


@query(PLANE_SVD.replace("round(x, 6) AS x", "NULL::DOUBLE AS x").split(" UNION")[0].replace(", NULL::DOUBLE AS x, round(y, 6) AS y", "") + " UNION ALL SELECT 1, round(sqrt(m - h), 5) FROM w")
def svd_incremental_fast(spark, d):
    """In two batches, of which the first spans the plane, the dropped residual and rotation lose nothing of sigma."""
    first, second = (plane_rows(spark, d).filter(c) for c in ("l_linenumber <= 3", "l_linenumber > 3"))
    return svd.svd_incremental([first, second], "vec", variant="fast").frame(spark).select("k", rounded("sigma", 5))


@query(PLANE_SVD)
def stream_svd_lines(spark, d):
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    rows = plane_rows(spark, d).select("vec").repartition(8)
    rows.write.parquet(path)
    return plane_svd(spark, stream_svd(spark, path, rows.schema, "vec", variant="brand", files_per_batch=3))


@query(f"WITH {PLANE} SELECT round(sqrt(m + h), 5) AS norm FROM w")
def mat_spectral_norm(spark, d):
    return spark.createDataFrame([(svd.spectral_norm(plane_rows(spark, d), "vec"),)], "norm double").select(rounded("norm", 5))


# Wide snapshots: one state for each user, one snapshot for each type of event.
SNAPSHOTS = """kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS j FROM (SELECT DISTINCT event_type FROM events)),
wide AS (SELECT user_id AS i, j, sum(value) AS v FROM events JOIN kinds USING (event_type) GROUP BY user_id, j),
full_ AS (SELECT u.i, kinds.j, coalesce(v, 0) AS v FROM (SELECT DISTINCT i FROM wide) u CROSS JOIN kinds LEFT JOIN wide ON wide.i = u.i AND wide.j = kinds.j)"""


def user_states(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kinds = e.select("event_type").distinct().withColumn("j", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("long"))  # one row a type
    cells = e.groupBy("event_type", F.col("user_id").cast("long").alias("i")).agg(F.sum("value").alias("v")).join(F.broadcast(kinds), "event_type")
    return matrix.rows_of(cells.select("i", "j", "v"), kinds.count())


@query(f"WITH {SNAPSHOTS} SELECT i, j, round(v, 4) + 0.0 AS v FROM full_")
def svd_dual_product(spark, d):
    found, left = svd.svd_dual(user_states(spark, d), "i", "vec")
    return matrix.to_long(svd.reconstruct(left, "i", "vec", found), "i", "vec").select("i", "j", rounded("v", 4))


@query(f"WITH {SNAPSHOTS}, n AS (SELECT count(*) AS n FROM kinds) SELECT x.j AS i, y.j AS j, CASE WHEN x.j = y.j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM kinds x, kinds y")
def svd_dual_inner_product(spark, d):
    """U^T M U is the identity for the inner product M, which weighs users and couples each with the next by id."""
    states = user_states(spark, d)
    weigh = states.select("i", F.col("i").alias("j"), (F.col("i") % 3 + 2.0).alias("v"))
    beside = states.select("i", (F.col("i") + 1).alias("j"), F.lit(0.5).alias("v"))
    product = weigh.unionByName(beside).unionByName(matrix.transpose(beside))
    _, left = svd.svd_dual(states, "i", "vec", product=product)
    u = matrix.to_long(left, "i", "vec")
    return matrix.matmul(matrix.transpose(u), matrix.matmul(product, u)).select("i", "j", rounded("v"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS i, b.vec_id AS j, list_dot_product(a.v, b.v) AS v FROM e a, e b)
SELECT i, round(sum(v), 4) + 0.0 AS total, round(max(v) FILTER (i <> j), 5) + 0.0 AS largest FROM p GROUP BY i""")
def mat_rows_gram(spark, d):
    """Embeddings times their transpose, block by block: each row's sum and its largest product with another row."""
    found = matrix.rows_with_rows(table(spark, d, "embeddings"), "vec_id", "embedding")
    return found.select("i", rounded("total", 4), rounded("largest", 5))


# 64-wide snapshots of known spectrum: the first component of each embedding, weighed down by its group, along the group's vector of an orthonormal cosine basis.
WIDE = """w AS (SELECT vec_id, vec_id % 40 AS g, embedding[1]::DOUBLE * pow(2.0, -(vec_id % 40)) AS x FROM embeddings),
s AS (SELECT g, sqrt(sum(x * x)) AS sigma, row_number() OVER (ORDER BY sum(x * x) DESC) - 1 AS k FROM w GROUP BY g)"""


def wide_rows(spark: SparkSession, d: str) -> DataFrame:
    group = F.col("vec_id") % 40
    x = F.get("embedding", F.lit(0)).cast("double") * F.pow(F.lit(2.0), -group)
    wave = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: F.cos(F.lit(np.pi) * (j + 0.5) * (group + 1) / 64) * float(np.sqrt(2 / 64)))
    return table(spark, d, "embeddings").withColumn("_x", x).withColumn("_wave", wave).select("vec_id", F.transform("_wave", lambda w: w * F.col("_x")).alias("vec"))


def top_values(spark: SparkSession, found: svd.Decomposition) -> DataFrame:
    return found.frame(spark).select(F.col("k").cast("long").alias("k"), rounded("sigma"))


LEADING = f"WITH {WIDE} SELECT k, round(sigma, 6) AS sigma FROM s WHERE k < 5"


@query(LEADING)
def svd_randomized_wide(spark, d):
    """Five values with 15 probes for 64 columns."""
    return top_values(spark, svd.svd_randomized(wide_rows(spark, d), "vec", 5))


@query(LEADING)
def svd_sparse_wide(spark, d):
    return top_values(spark, svd.svd_sparse(matrix.to_long(wide_rows(spark, d), "vec_id", "vec").filter("v <> 0"), 64, 5))


@query(LEADING)
def svd_incremental_fast_wide(spark, d):
    """The fast variant where later batches only repeat directions of the first: values add up in squares."""
    rows = wide_rows(spark, d)
    first, second = rows.filter("vec_id < 160"), rows.filter("vec_id >= 160")
    return top_values(spark, svd.svd_incremental([first, second], "vec", rank=40, variant="fast")).filter("k < 5")


@query(f"""WITH {WIDE} SELECT vec_id, r.k, CASE WHEN s.k = r.k THEN round(abs(x), 6) ELSE 0.0 END AS size FROM w JOIN s USING (g), (SELECT unnest(range(5)) AS k) r""")
def pod_coefficients_wide(spark, d):
    """Sizes of the coefficients in five basis vectors of 64-wide snapshots."""
    rows = wide_rows(spark, d)
    found = svd.project(rows, "vec_id", "vec", svd.svd_tsqr(rows, "vec", rank=5))
    return found.select("vec_id", F.col("k").cast("long").alias("k"), (F.round(F.abs("c"), 6) + 0.0).alias("size"))


@query(f"WITH {WIDE} SELECT round(sqrt(sum(sigma * sigma) FILTER (k >= 10) / sum(sigma * sigma)), 6) AS relative_error FROM s")
def pod_error_wide(spark, d):
    rows = wide_rows(spark, d)
    return svd.reconstruction_error(rows, "vec", svd.svd_gram(rows, "vec", rank=10)).select(rounded("relative_error"))


@query("""WITH w AS (SELECT vec_id, vec_id % 40 AS g, 1 + embedding[1]::DOUBLE / 100 AS x FROM embeddings)
SELECT round(sqrt(sum((x - m) ** 2)), 6) AS sigma FROM w, (SELECT avg(x) AS m FROM w)""")
def svd_centred_far(spark, d):
    """A cloud a million spreads away from zero, along one direction: its only value after centring."""
    x = (F.get("embedding", F.lit(0)).cast("double") / 100 + 1) * F.lit(1.0)
    rows = table(spark, d, "embeddings").select(F.array(F.lit(1e6) + x * 0.6, F.lit(-2e6) + x * 0.8).alias("vec"))
    return svd.svd_gram(rows, "vec", rank=1, center=True).frame(spark).select(rounded("sigma"))


@query()
def pod_basis(spark, d):
    return svd.svd_gram(table(spark, d, "embeddings"), "embedding", rank=5, center=True).basis_frame(spark)


@query(f"""WITH {PLANE} SELECT l_orderkey, l_linenumber, round(l_quantity / 50 * x + l_discount * 10 * y, 5) + 0.0 AS c FROM lineitem, w""")
def pod_coefficients(spark, d):
    """Coefficients in the leading basis vector."""
    rows = plane_rows(spark, d).withColumn("id", F.struct("l_orderkey", "l_linenumber"))
    found = svd.project(rows, "id", "vec", svd.svd_gram(rows, "vec", rank=1))
    return found.select("id.l_orderkey", "id.l_linenumber", rounded("c", 5))


@query(f"WITH {PLANE} SELECT round(sqrt((m - h) / (2 * m)), 6) AS relative_error FROM w")
def pod_reconstruction_error(spark, d):
    rows = plane_rows(spark, d)
    return svd.reconstruction_error(rows, "vec", svd.svd_tsqr(rows, "vec", rank=1)).select(rounded("relative_error"))


@query("""WITH g AS (SELECT var_pop(l_quantity / 50) AS a, covar_pop(l_quantity / 50, l_discount * 10) AS b, var_pop(l_discount * 10) AS d FROM lineitem)
SELECT round(sqrt(((a + d) / 2 - sqrt(((a - d) / 2) ** 2 + b * b)) / (a + d)), 6) AS relative_error FROM g""")
def pod_centred_error(spark, d):
    """Of a centred basis, to the size of the centred snapshots."""
    rows = plane_rows(spark, d)
    return svd.reconstruction_error(rows, "vec", svd.svd_gram(rows, "vec", rank=1, center=True)).select(rounded("relative_error"))


@query("""WITH s AS (SELECT event_type AS k, sqrt(sum(value * value)) AS sigma FROM events GROUP BY event_type),
e AS (SELECT k, sigma, sum(sigma * sigma) OVER (ORDER BY sigma DESC, k) / sum(sigma * sigma) OVER () AS energy FROM s),
b AS (SELECT *, coalesce(lag(energy) OVER (ORDER BY sigma DESC, k), 0) AS before FROM e)
SELECT k, round(sigma, 4) AS sigma, round(energy, 6) AS energy FROM b WHERE before < 0.75""")
def energy_truncate(spark, d):
    spectrum = table(spark, d, "events").groupBy(F.col("event_type").alias("k")).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("sigma"))
    return svd.truncate(spectrum, 0.25).select("k", rounded("sigma", 4), rounded("energy"))


@query(f"WITH {GRAM} SELECT i, j, round(v, 6) + 0.0 AS v FROM gram")
def stream_gram_embeddings(spark, d):
    schema = table(spark, d, "embeddings").schema
    return stream_gram(spark, f"{d}/embeddings.parque[t]", schema, "embedding").select("i", "j", rounded("v"))


# Systems identified from tables

NATIONS = """n AS (SELECT c_nationkey AS k, -(1 + count(*) / 100.0 + c_nationkey / 10.0) AS a, avg(c_acctbal) / 1000 AS b FROM customer GROUP BY c_nationkey)"""


def nation_system(spark: SparkSession, d: str) -> tuple[list[int], np.ndarray, np.ndarray]:
    """States (25 at most): one for each nation, its decay and its gain from all customers."""
    rows = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg((-(1 + F.count(F.lit(1)) / 100.0 + F.col("k") / 10.0)).alias("a"), (F.avg("c_acctbal") / 1000).alias("b")).orderBy("k").collect()
    return [r["k"] for r in rows], np.array([r["a"] for r in rows]), np.array([[r["b"]] for r in rows])


def cells(spark: SparkSession, keys: list[int], x: np.ndarray, digits: int) -> DataFrame:
    return spark.createDataFrame([(keys[i], keys[j], float(v)) for (i, j), v in np.ndenumerate(x)], "i int, j int, v double").select("i", "j", rounded("v", digits))


@query(f"WITH {NATIONS} SELECT x.k AS i, y.k AS j, round(-x.b * y.b / (x.a + y.a), 5) + 0.0 AS v FROM n x, n y")
def lyap_continuous(spark, d):
    keys, a, b = nation_system(spark, d)
    return cells(spark, keys, lyapunov.continuous(np.diag(a), b), 5)


@query(f"WITH {NATIONS}, m AS (SELECT k, 1 / (a - 0.5) AS a, b FROM n) SELECT x.k AS i, y.k AS j, round(x.b * y.b / (1 - x.a * y.a), 5) + 0.0 AS v FROM m x, m y")
def lyap_discrete(spark, d):
    keys, a, b = nation_system(spark, d)
    return cells(spark, keys, lyapunov.smith(np.diag(1 / (a - 0.5)), b), 5)


@query("""WITH s AS (SELECT l_linestatus AS k, -(1 + 10 * avg(l_discount) + (l_linestatus = 'F')::INT) - 1e-8 AS a, avg(l_quantity) / 10 AS b, avg(l_tax) * 10 AS c FROM lineitem GROUP BY l_linestatus),
p AS (SELECT x.k AS i, y.k AS j, -x.b * y.b / (x.a + y.a) AS p, -x.c * y.c / (x.a + y.a) AS q FROM s x, s y),
m AS (SELECT l.i, r.j, sum(l.p * r.q) AS v FROM p l JOIN p r ON l.j = r.i GROUP BY l.i, r.j),
t AS (SELECT sum(v) FILTER (i = j) AS tr, max(v) FILTER (i = 'F' AND j = 'F') * max(v) FILTER (i = 'O' AND j = 'O') - max(v) FILTER (i = 'F' AND j = 'O') * max(v) FILTER (i = 'O' AND j = 'F') AS det FROM m)
SELECT 0 AS k, round(sqrt(tr / 2 + sqrt(greatest(tr * tr / 4 - det, 0))), 6) AS hsv FROM t UNION ALL SELECT 1, round(sqrt(tr / 2 - sqrt(greatest(tr * tr / 4 - det, 0))), 6) FROM t""")
def bt_hsv_two_states(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("k")).agg(F.avg("l_discount").alias("x"), (F.avg("l_quantity") / 10).alias("b"), (F.avg("l_tax") * 10).alias("c")).orderBy("k").collect()
    a = np.diag([-(1 + 10 * r["x"] + (r["k"] == "F")) for r in rows])
    found = lyapunov.balanced_truncation(a, np.array([[r["b"]] for r in rows]), np.array([[r["c"] for r in rows]]))
    hsv = np.append(found.hsv, np.zeros(len(rows) - len(found.hsv)))
    return spark.createDataFrame([(k, float(s)) for k, s in enumerate(hsv)], "k int, hsv double").select("k", rounded("hsv"))


@query()
def bt_reduced(spark, d):
    """Order-3 reduction of the nations' system, with each nation's suppliers as outputs."""
    keys, a, b = nation_system(spark, d)
    counts = dict(table(spark, d, "supplier").groupBy("s_nationkey").count().collect())
    c = np.array([[1.0 + counts.get(k, 0) for k in keys]])
    found = lyapunov.balanced_truncation(np.diag(a), b, c, order=3)
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(found.a)], "i int, j int, v double")


# Meshes and points

GRID = """cells AS (SELECT DISTINCT (o_custkey % 40)::BIGINT AS x, floor(o_totalprice / 12500)::BIGINT AS y FROM orders),
sides AS (SELECT x, y, unnest([{'a': x * 1000 + y, 'b': (x + 1) * 1000 + y}, {'a': (x + 1) * 1000 + y, 'b': (x + 1) * 1000 + y + 1},
  {'a': (x + 1) * 1000 + y + 1, 'b': x * 1000 + y + 1}, {'a': x * 1000 + y + 1, 'b': x * 1000 + y}]) AS s FROM cells),
edges AS (SELECT min(s) AS s FROM sides GROUP BY least(s.a, s.b), greatest(s.a, s.b) HAVING count(*) = 1)"""


def occupied_cells(spark: SparkSession, d: str) -> DataFrame:
    """Quads of a grid that orders fall into, by customer and price; node (x, y) has id 1000 x + y."""
    node = lambda dx, dy: (F.col("x") + dx) * 1000 + F.col("y") + dy
    o = table(spark, d, "orders").select((F.col("o_custkey") % 40).cast("long").alias("x"), F.floor(F.col("o_totalprice") / 12500).cast("long").alias("y")).distinct()
    return o.select(F.array(node(0, 0), node(1, 0), node(1, 1), node(0, 1)).alias("conn"))


def grid_nodes(quads: DataFrame) -> DataFrame:
    ids = quads.select(F.explode("conn").alias("node_id")).distinct()
    return ids.select("node_id", F.floor(F.col("node_id") / 1000).cast("double").alias("x"), (F.col("node_id") % 1000).cast("double").alias("y"))


@query(f"WITH {GRID} SELECT s.a AS a, s.b AS b FROM edges")
def facet_boundary_quad(spark, d):
    found = mesh.boundary_facets(occupied_cells(spark, d), "quad")
    return found.select(F.get("facet", F.lit(0)).alias("a"), F.get("facet", F.lit(1)).alias("b"))


@query(f"WITH {GRID} SELECT least(s.a, s.b) AS a, greatest(s.a, s.b) AS b FROM edges")
def facet_boundary_tri(spark, d):
    found = mesh.boundary_facets(mesh.split_quads(occupied_cells(spark, d)), "triangle").select(F.array_sort("facet").alias("f"))
    return found.select(F.get("f", F.lit(0)).alias("a"), F.get("f", F.lit(1)).alias("b"))


NODES = """nodes AS (SELECT DISTINCT unnest([s.a, s.b]) AS id FROM sides), spot AS (SELECT id, (id // 1000)::DOUBLE AS x, (id % 1000)::DOUBLE AS y FROM nodes),
mean AS (SELECT avg(x) AS mx, avg(y) AS my FROM spot),
g AS (SELECT s.a, s.b, sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) AS length, (p.x + q.x) / 2 AS cx, (p.y + q.y) / 2 AS cy, q.y - p.y AS nx, p.x - q.x AS ny
  FROM edges JOIN spot p ON p.id = s.a JOIN spot q ON q.id = s.b)"""


@query(f"WITH {GRID}, {NODES} SELECT a, b, round(length, 6) AS length, round(f * nx / length, 6) + 0.0 AS nx, round(f * ny / length, 6) + 0.0 AS ny "
       "FROM (SELECT *, CASE WHEN nx * (cx - mx) + ny * (cy - my) < 0 THEN -1.0 ELSE 1.0 END AS f FROM g, mean)")
def facet_geometry(spark, d):
    quads = occupied_cells(spark, d)
    found = mesh.edge_geometry(mesh.boundary_facets(quads, "quad"), grid_nodes(quads))
    return found.select(F.get("facet", F.lit(0)).alias("a"), F.get("facet", F.lit(1)).alias("b"), rounded("length"), rounded("nx"), rounded("ny"))


POINTS = "points AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"


def points_of(spark: SparkSession, d: str) -> DataFrame:
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return table(spark, d, "embeddings").select("vec_id", "label", at(0).alias("x"), at(1).alias("y"))


@query(f"WITH {POINTS} SELECT vec_id, round((x - (SELECT min(x) FROM points)) / (SELECT max(x) - min(x) FROM points), 6) + 0.0 AS x, "
       "round((y - (SELECT min(y) FROM points)) / (SELECT max(y) - min(y) FROM points), 6) + 0.0 AS y FROM points")
def bbox_unit_cube(spark, d):
    return mesh.unit_cube(points_of(spark, d).select("vec_id", "x", "y"), ["x", "y"]).select("vec_id", rounded("x"), rounded("y"))


@query(f"WITH {POINTS}, hits AS (SELECT p.vec_id, min({{'d': sqrt((p.x - n.x) ** 2 + (p.y - n.y) ** 2), 'b': 'side' || n.label}}) AS best FROM points p JOIN points n "
       "ON n.label >= 5 AND sqrt((p.x - n.x) ** 2 + (p.y - n.y) ** 2) <= 0.02 GROUP BY p.vec_id) SELECT p.vec_id, best.b AS boundary FROM points p LEFT JOIN hits USING (vec_id)")
def locate_boundary(spark, d):
    p = points_of(spark, d)
    nodes = p.filter("label >= 5").select(F.concat(F.lit("side"), F.col("label").cast("string")).alias("boundary"), "x", "y")
    return mesh.locate_boundary(p.select("vec_id", "x", "y"), nodes, ["x", "y"], 0.02).select("vec_id", "boundary")


@query(f"WITH {POINTS}, hits AS (SELECT p.vec_id, min({{'d': sqrt((p.x - n.x) ** 2 + (p.y - n.y) ** 2), 'b': 'side' || n.label}}) AS best FROM points p JOIN points n "
       "ON n.label = 0 AND sqrt((p.x - n.x) ** 2 + (p.y - n.y) ** 2) <= 0.02 GROUP BY p.vec_id) SELECT p.vec_id, best.b AS boundary FROM points p LEFT JOIN hits USING (vec_id)")
def locate_boundary_label(spark, d):
    """Nulls in other columns, and one called boundary, change nothing."""
    p = points_of(spark, d)
    nodes = p.filter("label = 0").select(F.concat(F.lit("side"), F.col("label").cast("string")).alias("boundary"), "x", "y")
    noted = p.select("vec_id", "x", "y", F.when(F.col("vec_id") % 2 == 0, "note").alias("note"), F.lit(None).cast("string").alias("boundary"))
    return mesh.locate_boundary(noted, nodes, ["x", "y"], 0.02).select("vec_id", "boundary")


KNN = f"""{POINTS}, near AS (SELECT q.vec_id AS query, p.vec_id AS neighbour, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) AS distance,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2), p.vec_id) AS rank
  FROM points q JOIN points p ON q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id QUALIFY rank <= 8)"""


@query(f"WITH {KNN} SELECT query, neighbour, round(distance, 6) AS distance, rank::INT AS rank FROM near")
def knn_k8(spark, d):
    p = points_of(spark, d)
    return mesh.nearest(p.filter("vec_id % 50 = 0"), p, "vec_id", ["x", "y"], 8).select("query", "neighbour", rounded("distance"), "rank")


@query(f"""WITH {POINTS}, all_ AS (SELECT vec_id, x, y FROM points UNION ALL SELECT -1, 1e9, -1e9 UNION ALL SELECT -2 - vec_id, 0.25, 0.25 FROM points),
near AS (SELECT q.vec_id AS query, p.vec_id AS neighbour, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) AS distance,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2), p.vec_id) AS rank FROM all_ q JOIN all_ p ON q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id QUALIFY rank <= 8)
SELECT query, neighbour, round(distance, 4) AS distance, rank::INT AS rank FROM near""")
def knn_cells(spark, d):
    """Neighbours among as many equal points as others, and one far away, which no cell of the tree suffers from."""
    p = points_of(spark, d).select("vec_id", "x", "y")
    heap = p.select((-2 - F.col("vec_id")).alias("vec_id"), F.lit(0.25).alias("x"), F.lit(0.25).alias("y"))
    far = spark.createDataFrame([(-1, 1e9, -1e9)], p.schema)
    whole = p.unionByName(far).unionByName(heap)
    return cells_of_points.nearest(whole.filter("vec_id % 50 = 0"), whole, "vec_id", ["x", "y"], 8, size=64).select("query", "neighbour", rounded("distance", 4), "rank")


@query(f"""WITH {KNN}, c AS (SELECT query, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS d FROM near JOIN points ON vec_id = neighbour GROUP BY query),
n AS (SELECT query, b AS nx, (a + d) / 2 - sqrt(((a - d) / 2) ** 2 + b * b) - a AS ny FROM c),
u AS (SELECT query, nx / sqrt(nx * nx + ny * ny) AS nx, ny / sqrt(nx * nx + ny * ny) AS ny FROM n),
s AS (SELECT query, nx, ny, CASE WHEN nx * (x - (SELECT avg(x) FROM points)) + ny * (y - (SELECT avg(y) FROM points)) < 0 THEN -1.0 ELSE 1.0 END AS f FROM u JOIN points ON vec_id = query)
SELECT query, round(f * nx, 5) + 0.0 AS nx, round(f * ny, 5) + 0.0 AS ny FROM s""")
def pca_normal_2d(spark, d):
    p = points_of(spark, d)
    return mesh.pca_normals(p.filter("vec_id % 50 = 0"), p, "vec_id").select("query", rounded("nx", 5), rounded("ny", 5))


# A solid of unit cubes that orders fall into, each cut into six tetrahedra along its diagonal; node (x, y, z) has id 10000 x + 100 y + z.
CUBES = """cubes AS (SELECT DISTINCT (o_custkey % 8)::BIGINT AS x, floor(o_totalprice / 60000)::BIGINT AS y, (o_orderkey % 5)::BIGINT AS z FROM orders),
steps AS (SELECT * FROM (VALUES (10000, 100, 1), (10000, 1, 100), (100, 1, 10000)) v(u, w, out)),
faces AS (SELECT x, y, z, x * 10000 + y * 100 + z + side * out AS o, u, w, out, side FROM cubes, steps, range(2) r(side)),
open_ AS (SELECT f.* FROM faces f LEFT JOIN cubes n ON n.x = f.x + (2 * side - 1) * (out // 10000) AND n.y = f.y + (2 * side - 1) * (out = 100)::INT AND n.z = f.z + (2 * side - 1) * (out = 1)::INT WHERE n.x IS NULL),
tri AS (SELECT o AS a, o + mid AS b, o + u + w AS c, out FROM (SELECT *, unnest([u, w]) AS mid FROM open_)),
spots AS (SELECT *, (a * 100000 + b) * 100000 + c AS facet, (a // 10000 + b // 10000 + c // 10000) / 3.0::DOUBLE AS cx, (a // 100 % 100 + b // 100 % 100 + c // 100 % 100) / 3.0::DOUBLE AS cy, (a % 100 + b % 100 + c % 100) / 3.0::DOUBLE AS cz FROM tri)"""


def occupied_cubes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select((F.col("o_custkey") % 8).cast("long").alias("x"), F.floor(F.col("o_totalprice") / 60000).cast("long").alias("y"), (F.col("o_orderkey") % 5).cast("long").alias("z")).distinct()


def tetrahedra(cubes: DataFrame) -> DataFrame:
    """The columns of ``cubes`` and conn, cell_type of each tetrahedron."""
    corner = F.col("x") * 10000 + F.col("y") * 100 + F.col("z")
    paths = [F.array(corner, corner + p, corner + p + q, corner + 10101) for p, q in itertools.permutations((10000, 100, 1), 2)]
    return cubes.select(*cubes.columns, F.explode(F.array(*paths)).alias("conn"), F.lit("tetra").alias("cell_type"))


def solid_nodes(cells: DataFrame) -> DataFrame:
    n = cells.select(F.explode("conn").alias("node_id")).distinct()
    return n.select("node_id", F.floor(F.col("node_id") / 10000).cast("double").alias("x"), F.floor(F.col("node_id") / 100 % 100).cast("double").alias("y"), (F.col("node_id") % 100).cast("double").alias("z"))


def surface(spark: SparkSession, d: str) -> DataFrame:
    """The solid's surface triangles with their geometry and a number each."""
    cells = tetrahedra(occupied_cubes(spark, d))
    facets = mesh.boundary_facets(cells, "tetra").select(F.array_sort("facet").alias("facet"))
    facet = lambda i: F.get("facet", F.lit(i))
    numbered = facets.withColumn("id", (facet(0) * 100000 + facet(1)) * 100000 + facet(2))
    return mesh.triangle_geometry(numbered, solid_nodes(cells))


@query(f"WITH {CUBES} SELECT facet AS id, 0.5::DOUBLE AS area, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz, (out = 10000)::INT::DOUBLE AS nx, (out = 100)::INT::DOUBLE AS ny, (out = 1)::INT::DOUBLE AS nz FROM spots")
def facet_boundary_tetra(spark, d):
    """Area, centroid and normal (up to its sign) of every surface triangle."""
    return surface(spark, d).select("id", rounded("area"), rounded("cx"), rounded("cy"), rounded("cz"), *[(F.round(F.abs(n), 6) + 0.0).alias(n) for n in ("nx", "ny", "nz")])


@query(f"""WITH {CUBES}, own AS (SELECT *, CASE WHEN x % 4 IN (1, 2) THEN 'mid' ELSE 's' || x % 4 END AS name FROM cubes WHERE x % 4 < 3),
sides AS (SELECT name, x, y, z, x * 10000 + y * 100 + z + side * out AS o, u, w, out, side FROM own, steps, range(2) r(side)),
free AS (SELECT f.* FROM sides f LEFT JOIN own n ON n.name = f.name AND n.x = f.x + (2 * side - 1) * (out // 10000) AND n.y = f.y + (2 * side - 1) * (out = 100)::INT AND n.z = f.z + (2 * side - 1) * (out = 1)::INT WHERE n.x IS NULL)
SELECT name AS boundary, o AS a, o + unnest([u, w]) AS b, o + u + w AS c FROM free""")
def mesh_cell_sets(spark, d):
    """Facets of named cell sets, filtered (s3 is left out) and two of them merged under a new name."""
    cells = tetrahedra(occupied_cubes(spark, d)).withColumn("set_name", F.concat(F.lit("s"), (F.col("x") % 4).cast("string")))
    found = meshes.boundary_faces(cells, 3, keep=["s0", "s1", "s2"], rename={"s1": "mid", "s2": "mid"})
    found = meshes.checked_facets(found, solid_nodes(cells)).select("boundary", F.array_sort("facet").alias("f"))
    return found.select("boundary", *[F.get("f", F.lit(i)).alias(c) for i, c in enumerate("abc")])


@query(f"""WITH {CUBES}, corners AS (SELECT DISTINCT CASE WHEN x % 4 IN (1, 2) THEN 'mid' ELSE 's0' END AS boundary, (x + a) * 10000 + (y + b) * 100 + z + c AS node_id FROM cubes, range(2) p(a), range(2) q(b), range(2) r(c) WHERE x % 4 < 3)
SELECT boundary, node_id FROM corners UNION SELECT 'low', x * 10000 + y * 100 + z FROM cubes WHERE z = 0""")
def mesh_boundary_nodes(spark, d):
    """Point sets and cell sets of one mesh, filtered, renamed and merged without repeats."""
    cubes = occupied_cubes(spark, d)
    cells = tetrahedra(cubes).withColumn("set_name", F.concat(F.lit("s"), (F.col("x") % 4).cast("string")))
    points = cubes.filter("z = 0").select(F.lit("bottom").alias("set_name"), (F.col("x") * 10000 + F.col("y") * 100 + F.col("z")).alias("node_id"))
    return meshes.boundary_nodes(points, cells, keep=["s0", "s1", "s2", "bottom"], rename={"s1": "mid", "s2": "mid", "bottom": "low"})


@query(f"WITH {CUBES}, n AS (SELECT DISTINCT (x + a) * 10000 + (y + b) * 100 + z + c AS id FROM cubes, range(2) p(a), range(2) q(b), range(2) r(c)) SELECT 'node' AS kind, id, (id // 10000 + 2 * (id // 100 % 100) + 4 * (id % 100))::DOUBLE AS value FROM n "
       "UNION ALL SELECT 'cell', x * 10000 + y * 100 + z, (8 * (x * 10000 + y * 100 + z) + 4 * 10101)::DOUBLE FROM cubes")
def mesh_msh_file(spark, d):
    """The solid as a Gmsh text file, written and read again: nodes by a sum of coordinates, hexahedra by the sum of their nodes."""
    cubes = occupied_cubes(spark, d)
    nodes = solid_nodes(tetrahedra(cubes)).select(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("node_id", "x", "y", "z")]).alias("line"))
    corner = F.col("x") * 10000 + F.col("y") * 100 + F.col("z")
    hexa = [corner + s for s in (0, 10000, 10100, 100, 1, 10001, 10101, 101)]
    cells = cubes.select(F.concat_ws(" ", corner.cast("string"), F.lit("5 2 7 7"), *[c.cast("string") for c in hexa]).alias("line"))
    block = lambda name, rows: rows.agg(F.concat_ws("\n", F.lit(f"${name}"), F.count(F.lit(1)).cast("string"), F.concat_ws("\n", F.collect_list("line")), F.lit(f"$End{name}")).alias("part"))
    # A file is one record by its format; this one has as many cells as the grid, at most 8 x 9 x 5.
    whole = block("Nodes", nodes).crossJoin(block("Elements", cells).withColumnRenamed("part", "more"))
    names = '$MeshFormat\n2.2 0 8\n$EndMeshFormat\n$PhysicalNames\n1\n3 7 "solid"\n$EndPhysicalNames'
    path = f"{shared_folder(spark)}/msh-{uuid.uuid4().hex}"
    whole.select(F.concat_ws("\n", F.lit(names), "part", "more").alias("value")).write.text(path)
    n, c = meshes.read_msh(spark, path)
    points = n.select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), (F.col("x") + 2 * F.col("y") + 4 * F.col("z")).alias("value"))
    total = F.aggregate("conn", F.lit(0).cast("long"), lambda s, x: s + x).cast("double")
    return points.unionByName(c.filter("cell_type = 'hexahedron' AND set_name = 'solid'").select(F.lit("cell").alias("kind"), F.col("cell_id").alias("id"), total.alias("value")))


SPACE = "space AS (SELECT vec_id, (embedding[1] + 0.5)::DOUBLE * 8 AS x, (embedding[2] + 0.5)::DOUBLE * 8 AS y, (embedding[3] + 0.5)::DOUBLE * 5 AS z FROM embeddings)"


def space_points(spark: SparkSession, d: str) -> DataFrame:
    at = lambda k, w: ((F.get("embedding", F.lit(k)) + F.lit(0.5).cast("float")).cast("double") * w)
    return table(spark, d, "embeddings").select("vec_id", at(0, 8).alias("x"), at(1, 8).alias("y"), at(2, 5).alias("z"))


@query(f"WITH {CUBES}, {SPACE} SELECT vec_id, arg_min(out, (round(sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2), 9), facet))::INT AS axis FROM space, spots GROUP BY vec_id")
def facet_nearest_normal(spark, d):
    """The axis of the normal of the facet whose centroid is nearest to each point."""
    found = mesh.nearest_normals(space_points(spark, d), surface(spark, d), "vec_id", "id")
    axis = F.when(F.abs("nx") > 0.5, 10000).when(F.abs("ny") > 0.5, 100).otherwise(1)
    return found.select(F.col("query").alias("vec_id"), axis.alias("axis"))


LAID = """laid AS (SELECT *, ((facet::HUGEINT * 2654435761) % 4294967296) % 4096 AS run FROM spots),
sum_ AS (SELECT *, coalesce(sum(0.5) OVER (PARTITION BY {by} ORDER BY run, facet ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before, (sum(0.5) OVER (PARTITION BY {by}))::DOUBLE AS whole FROM laid),
share AS (SELECT s.*, c.n AS n FROM sum_ s, ({counts}) c WHERE c.name = {by}),
picked AS (SELECT *, unnest(range(ceil(round(before * n / whole, 9) - 0.5)::BIGINT, ceil(round((before + 0.5) * n / whole, 9) - 0.5)::BIGINT)) AS sample FROM share)"""
POINTS_OF = """at_ AS (SELECT *, sqrt((('0x' || substr(md5({label} || sample || '/7/r'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) AS r, (('0x' || substr(md5({label} || sample || '/7/u'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS t FROM picked)
SELECT {name}sample, facet AS id, round((1 - r) * (a // 10000) + r * (1 - t) * (b // 10000) + r * t * (c // 10000), 6) + 0.0 AS x,
  round((1 - r) * (a // 100 % 100) + r * (1 - t) * (b // 100 % 100) + r * t * (c // 100 % 100), 6) + 0.0 AS y, round((1 - r) * (a % 100) + r * (1 - t) * (b % 100) + r * t * (c % 100), 6) + 0.0 AS z,
  (out = 10000)::INT::DOUBLE AS nx, (out = 100)::INT::DOUBLE AS ny, (out = 1)::INT::DOUBLE AS nz FROM at_"""


def drawn_points(found: DataFrame, *names: str) -> DataFrame:
    return found.select(*names, "sample", "id", rounded("x"), rounded("y"), rounded("z"), *[(F.round(F.abs(n), 6) + 0.0).alias(n) for n in ("nx", "ny", "nz")])


@query(f"WITH {CUBES}, {LAID.format(by='1', counts='SELECT 1 AS name, 2000 AS n')}, {POINTS_OF.format(label=chr(39) * 2, name='')}")
def facet_points(spark, d):
    """2,000 points with normals on the solid's surface, by area and barycentric coordinates."""
    return drawn_points(mesh.sample_triangles(surface(spark, d), "id", 2000, 7))


@query(f"WITH {CUBES}, " + LAID.format(by="out", counts="""SELECT out AS name, (floor(raw) + (row_number() OVER (ORDER BY round(raw - floor(raw), 9) DESC, out::VARCHAR) <= 2000 - sum(floor(raw)) OVER ())::INT)::BIGINT AS n
  FROM (SELECT out, round(count(*) * 0.5 / sum(count(*) * 0.5) OVER () * 2000, 9) AS raw FROM spots GROUP BY out)""") + f", {POINTS_OF.format(label='out || ' + chr(39) + '/' + chr(39), name='out::VARCHAR AS boundary, ')}")
def boundary_points(spark, d):
    """2,000 points over three boundaries (facets by their axis), each boundary's share by its area."""
    axis = F.when(F.abs("nx") > 0.5, "10000").when(F.abs("ny") > 0.5, "100").otherwise("1")
    return drawn_points(mesh.sample_boundaries(surface(spark, d).withColumn("boundary", axis), "id", 2000, 7), "boundary")


@query(f"""WITH {SPACE}, near AS (SELECT q.vec_id AS query, p.vec_id AS neighbour, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2) AS distance,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2), p.vec_id) AS rank FROM space q JOIN space p ON q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id QUALIFY rank <= 8),
c AS (SELECT query, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, y) AS yy, covar_pop(y, z) AS yz, covar_pop(z, z) AS zz FROM near JOIN space ON vec_id = neighbour GROUP BY query),
q AS (SELECT *, (xx + yy + zz) / 3 AS m FROM c),
p AS (SELECT *, sqrt(((xx - m) ** 2 + (yy - m) ** 2 + (zz - m) ** 2 + 2 * (xy ** 2 + xz ** 2 + yz ** 2)) / 6) AS s FROM q),
d AS (SELECT *, ((xx - m) * ((yy - m) * (zz - m) - yz * yz) - xy * (xy * (zz - m) - yz * xz) + xz * (xy * yz - (yy - m) * xz)) / (2 * s ** 3) AS h FROM p),
e AS (SELECT *, m + 2 * s * cos(acos(greatest(least(h, 1), -1)) / 3 + 2 * pi() / 3) AS low FROM d),
v AS (SELECT query, xy * yz - xz * (yy - low) AS nx, xz * xy - (xx - low) * yz AS ny, (xx - low) * (yy - low) - xy * xy AS nz FROM e),
u AS (SELECT query, nx / l AS nx, ny / l AS ny, nz / l AS nz FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS l FROM v)),
f AS (SELECT u.*, CASE WHEN nx * (x - (SELECT avg(x) FROM space)) + ny * (y - (SELECT avg(y) FROM space)) + nz * (z - (SELECT avg(z) FROM space)) < 0 THEN -1.0 ELSE 1.0 END AS sign FROM u JOIN space ON vec_id = query)
SELECT query, round(sign * nx, 4) + 0.0 AS nx, round(sign * ny, 4) + 0.0 AS ny, round(sign * nz, 4) + 0.0 AS nz FROM f""")
def pca_normal_3d(spark, d):
    p = space_points(spark, d)
    return mesh.pca_normals(p.filter("vec_id % 50 = 0"), p, "vec_id", axes=("x", "y", "z")).select("query", rounded("nx", 4), rounded("ny", 4), rounded("nz", 4))


@query("""WITH near AS (SELECT q.vec_id AS query, p.vec_id AS neighbour, list_distance(q.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS distance FROM embeddings q JOIN embeddings p ON q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id)
SELECT query, neighbour, round(distance, 5) AS distance, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour)::INT AS rank FROM near QUALIFY rank <= 8""")
def knn_k8_whole(spark, d):
    """Neighbours by all 64 coordinates."""
    axes = [f"a{k}" for k in range(64)]
    p = table(spark, d, "embeddings").select("vec_id", *[F.get("embedding", F.lit(k)).cast("double").alias(a) for k, a in enumerate(axes)])
    return mesh.nearest(p.filter("vec_id % 50 = 0"), p, "vec_id", axes, 8).select("query", "neighbour", rounded("distance", 5), "rank")


# Sampling

APPORTION = """w AS (SELECT o_orderpriority AS name, sum(o_totalprice) AS weight FROM orders GROUP BY o_orderpriority),
r AS (SELECT name, round(weight / sum(weight) OVER () * 1000, 9) AS raw FROM w),
c AS (SELECT name, (floor(raw) + (row_number() OVER (ORDER BY round(raw - floor(raw), 9) DESC, name) <= 1000 - sum(floor(raw)) OVER ())::INT)::BIGINT AS n FROM r)"""


def priority_counts(spark: SparkSession, d: str) -> DataFrame:
    weights = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.sum("o_totalprice").alias("weight"))
    return sampling.apportion(weights, "name", "weight", 1000)


@query(f"WITH {APPORTION} SELECT name, n AS count FROM c")
def apportion_counts(spark, d):
    return priority_counts(spark, d).select("name", "count")


@query(f"WITH {APPORTION} SELECT name, unnest(range(1, n + 1)) AS sample FROM c")
def weights_expand(spark, d):
    return sampling.expand(priority_counts(spark, d), "name").select("name", "sample")


@query(f"""WITH {APPORTION}, h AS (SELECT o_orderkey, o_orderpriority AS name, row_number() OVER (PARTITION BY o_orderpriority ORDER BY (o_orderkey::HUGEINT * 2654435761) % 4294967296, o_orderkey) AS rank FROM orders)
SELECT o_orderkey, name FROM h JOIN c USING (name) WHERE rank <= n""")
def stratified_sample(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("name"))
    return sampling.sample_strata(rows, priority_counts(spark, d), "name", "o_orderkey")


@query("""WITH n AS (SELECT count(*) AS n, least(greatest(round_even(count(*) * 0.2, 0), 1), count(*) - 1) AS held FROM documents)
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY (doc_id::HUGEINT * 2654435761) % 4294967296, doc_id) <= held THEN 'validation' ELSE 'train' END AS split FROM documents, n""")
def train_val_split(spark, d):
    return sampling.train_validation_split(table(spark, d, "documents").select("doc_id"), "doc_id")


@query("""WITH d AS (SELECT CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_custkey END AS key FROM orders),
n AS (SELECT least(greatest(round_even(count(*) * 0.3, 0), 1), count(*) - 1) AS held FROM d)
SELECT key, CASE WHEN row_number() OVER (ORDER BY (key::HUGEINT * 2654435761) % 4294967296 NULLS FIRST, key) <= held THEN 'validation' ELSE 'train' END AS split FROM d, n""")
def split_null_and_repeated_keys(spark, d):
    rows = table(spark, d, "orders").select(F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_custkey")).alias("key"))
    return sampling.train_validation_split(rows, "key", 0.3)


@query("""WITH d AS (SELECT CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderpriority END AS name, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey // 8 END AS key FROM orders),
h AS (SELECT name, key, row_number() OVER (PARTITION BY name ORDER BY (key::HUGEINT * 2654435761) % 4294967296 NULLS LAST, key NULLS LAST) AS rank FROM d)
SELECT name, key FROM h WHERE rank <= 150""")
def stratified_null_and_repeated_keys(spark, d):
    o = table(spark, d, "orders")
    rows = o.select(F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority")).alias("name"), F.when(F.col("o_custkey") % 5 != 0, F.floor(F.col("o_custkey") / 8)).alias("key"))
    return sampling.sample_strata(rows, rows.select("name").distinct().withColumn("count", F.lit(150)), "name", "key")


@query(f"WITH {POINTS} SELECT vec_id, x, y, CASE WHEN label = 0 THEN 'boundary' ELSE 'interior' END AS region, CASE WHEN label = 0 THEN 1.0::DOUBLE END AS normal FROM points")
def mixed_batch(spark, d):
    p = points_of(spark, d)
    inner = p.filter("label <> 0").select("vec_id", "x", "y", F.lit("interior").alias("region"))
    outer = p.filter("label = 0").select("vec_id", "x", "y", F.lit("boundary").alias("region"), F.lit(1.0).alias("normal"))
    return sampling.concat_batches(inner, outer)


@query(f"""WITH {APPORTION}, t AS (SELECT sum(weight) AS s FROM w), h AS (SELECT o_orderkey, o_orderpriority AS name, row_number() OVER (PARTITION BY o_orderpriority ORDER BY (o_orderkey::HUGEINT * 2654435761) % 4294967296, o_orderkey) AS rank FROM orders)
SELECT o_orderkey, name AS region, round(weight / s, 9) AS weight FROM h JOIN c USING (name) JOIN w USING (name), t WHERE rank <= n""")
def sampler_weighted(spark, d):
    """1,000 rows shared out among priorities by the orders' prices, with normalised weights."""
    o = table(spark, d, "orders")
    weights = o.groupBy(F.col("o_orderpriority").alias("region")).agg(F.sum("o_totalprice").alias("w"))
    found = sampling.weighted_batch(o.select("o_orderkey", F.col("o_orderpriority").alias("region")), weights, "region", "w", "o_orderkey", 1000)
    return found.select("o_orderkey", "region", rounded("weight", 9))


@query(f"""WITH {POINTS}, p AS (SELECT vec_id, CASE WHEN label = 0 THEN 'boundary' ELSE 'interior' END AS region, CASE WHEN label = 0 THEN x END AS normal FROM points),
h AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY (vec_id::HUGEINT * 2654435761) % 4294967296, vec_id) AS rank FROM p)
SELECT region, normal IS NULL AS plain, count(*) AS n FROM h WHERE rank <= CASE region WHEN 'interior' THEN 120 ELSE 0 END GROUP BY ALL UNION ALL SELECT 'boundary', false, 5000""")
def sampler_mixed(spark, d):
    """120 rows of the interior, and 5,000 draws with replacement of the boundary, whose normals survive."""
    p = points_of(spark, d)
    rows = p.select("vec_id", F.when(F.col("label") == 0, "boundary").otherwise("interior").alias("region"), F.when(F.col("label") == 0, F.col("x")).alias("normal"))
    counts = spark.createDataFrame([("interior", 120), ("boundary", 5000), ("none", 0)], "region string, count bigint")
    batch = sampling.region_batch(rows, counts, "region", "vec_id")
    return batch.groupBy("region", F.col("normal").isNull().alias("plain")).agg(F.count(F.lit(1)).alias("n"))


# Losses and metrics

PAIRS = "pairs AS (SELECT user_id, ts, event_id, value AS x, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events)"


def event_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", F.col("value").alias("x"))
    return losses.step_pairs(rows, "user_id", ["ts", "event_id"], "x").select("user_id", "ts", "event_id", "x", F.col("target").alias("y")).filter(F.col("y").isNotNull())


@query(f"WITH {PAIRS} SELECT round(avg((x - y) ** 2), 4) AS loss FROM pairs WHERE y IS NOT NULL")
def loss_one_step(spark, d):
    return event_pairs(spark, d).agg(F.round(losses.mse(F.col("x"), F.col("y")), 4).alias("loss"))


@query(f"WITH {PAIRS} SELECT round(avg(pow(0.9, step) * (x - y) ** 2), 4) AS loss FROM pairs WHERE y IS NOT NULL")
def loss_rollout_gamma(spark, d):
    rows = event_pairs(spark, d).withColumn("error", (F.col("x") - F.col("y")) ** 2)
    return losses.rollout(rows, "user_id", ["ts", "event_id"], "error", 0.9).select(rounded("loss", 4))


@query("""WITH p AS (SELECT user_id, value AS x, lead(value, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS y, lead(1, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS later, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events)
SELECT user_id, step::INT AS step, x, y FROM p WHERE later IS NOT NULL""")
def pairs_three_steps(spark, d):
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    return losses.step_pairs(rows, "user_id", ["ts", "event_id"], "value", 3).select("user_id", F.col("step").cast("int").alias("step"), F.col("value").alias("x"), F.col("target").alias("y"))


@query(f"""WITH {LONG}, w AS (SELECT i, j, v, lag(v) OVER (PARTITION BY i ORDER BY j) AS a, lead(v) OVER (PARTITION BY i ORDER BY j) AS b FROM long)
SELECT i, j, round((b - a) / 0.5, 5) + 0.0 AS first, round((b - 2 * v + a) / 0.0625, 4) + 0.0 AS second FROM w""")
def grid_derivatives(spark, d):
    """First and second central differences along each embedding's coordinates, 0.25 apart."""
    found = losses.grid_derivatives(embedding_matrix(spark, d), ["i"], "j", "v", 0.25)
    return found.select("i", "j", rounded("first", 5), rounded("second", 4))


@query("SELECT round((sum(l_discount ** 2) + 0.5 * (-0.5) * sum(1 + l_tax - l_discount ** 2 - exp(l_tax))) / count(*), 6) AS loss FROM lineitem")
def loss_vae(spark, d):
    x = F.col("l_discount")
    return table(spark, d, "lineitem").agg(F.round(losses.vae(x * x, x, F.col("l_tax"), 0.5), 6).alias("loss"))


@query(f"WITH {LONG}, m AS (SELECT j, avg(v) AS m FROM long GROUP BY j) SELECT round(avg((v - m) ** 2), 6) AS mse, round(sqrt(sum((v - m) ** 2)) / sqrt(sum(v ** 2)), 6) AS relative_error FROM long JOIN m USING (j)")
def recon_metrics(spark, d):
    a = embedding_matrix(spark, d)
    e = a.join(a.groupBy("j").agg(F.avg("v").alias("m")), "j").withColumn("e", (F.col("v") - F.col("m")) ** 2)
    return e.agg(F.round(F.avg("e"), 6).alias("mse"), F.round(losses.relative_error(F.col("e"), F.col("v") ** 2), 6).alias("relative_error"))


@query("WITH b AS (SELECT o_orderkey // 256 AS batch, avg(o_totalprice / 1000) AS loss FROM orders GROUP BY 1) SELECT round(avg(loss), 4) AS loss FROM b")
def batch_mean_loss(spark, d):
    b = table(spark, d, "orders").groupBy(F.floor(F.col("o_orderkey") / 256)).agg(F.avg(F.col("o_totalprice") / 1000).alias("loss"))
    return b.agg(F.round(F.avg("loss"), 4).alias("loss"))


EARLY = """WITH RECURSIVE h AS (SELECT row_number() OVER (ORDER BY d) - 1 AS epoch, loss FROM (SELECT ts::DATE AS d, round(avg(value), 6) AS loss FROM events GROUP BY 1)),
f(epoch, loss, best, last, stopped) AS (
  SELECT epoch, loss, loss, epoch, 0 >= {patience} FROM h WHERE epoch = 0
  UNION ALL
  SELECT h.epoch, h.loss, CASE WHEN {better} THEN h.loss ELSE best END, CASE WHEN {better} THEN h.epoch ELSE last END,
         stopped OR (CASE WHEN {better} THEN 0 ELSE h.epoch - last END) >= {patience} FROM f JOIN h ON h.epoch = f.epoch + 1)
SELECT epoch, loss, best, epoch - last AS wait, stopped FROM f"""


def loss_history(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("loss"))
    return days.select((F.row_number().over(Window.orderBy("day")) - 1).cast("long").alias("epoch"), "loss")  # one row a day


@query(EARLY.format(patience=5, better="h.loss < best"))
def early_stop_epoch(spark, d):
    return losses.early_stop(loss_history(spark, d), "epoch", "loss", 5)


@query(EARLY.format(patience=4, better="h.loss < best - 0.7"))
def early_stop_min_delta(spark, d):
    return losses.early_stop(loss_history(spark, d), "epoch", "loss", 4, min_delta=0.7)


@query(EARLY.format(patience=4, better="h.loss > best + 0.2"))
def early_stop_max(spark, d):
    return losses.early_stop(loss_history(spark, d), "epoch", "loss", 4, min_delta=0.2, mode="max")


@query(f"WITH {PAIRS} SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 4) AS intercept, count(*) AS n FROM pairs WHERE y IS NOT NULL")
def linear_dynamics_fit(spark, d):
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    return losses.one_step_fit(rows, "user_id", ["ts", "event_id"], "value").select(rounded("slope"), rounded("intercept", 4), "n")


# More of the matrix and point operators

@query(f"WITH {LONG} SELECT i, j, round(abs(v), 6) AS a, round(sqrt(abs(v)), 6) AS r, round(exp(v), 6) AS e, isfinite(1 / nullif(v, 0)) AS f FROM long")
def mat_elementwise(spark, d):
    a, v = embedding_matrix(spark, d), F.col("v")
    finite = F.when(v != 0, ~F.isnan(1 / v) & (F.abs(1 / v) != float("inf")))
    return a.select("i", "j", F.round(F.abs(v), 6).alias("a"), F.round(F.sqrt(F.abs(v)), 6).alias("r"), F.round(F.exp(v), 6).alias("e"), finite.alias("f"))


@query(f"WITH {LONG} SELECT j, bool_or(v > 0.3) AS any_above, bool_and(v > -0.3) AS all_above, round(max(v), 6) + 0.0 AS most, round(sum(v), 6) + 0.0 AS total FROM long GROUP BY j")
def mat_column_reductions(spark, d):
    v = F.col("v")
    return embedding_matrix(spark, d).groupBy("j").agg(F.bool_or(v > 0.3).alias("any_above"), F.bool_and(v > -0.3).alias("all_above"), (F.round(F.max("v"), 6) + 0.0).alias("most"), (F.round(F.sum("v"), 6) + 0.0).alias("total"))


@query(f"WITH {LONG} SELECT i, j, round(v, 6) + 0.0 AS v FROM long UNION ALL SELECT i, j + 64, round(label * 1.0::DOUBLE, 6) FROM (SELECT vec_id AS i, 0 AS j, label FROM embeddings)")
def mat_hstack(spark, d):
    label = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.lit(0).cast("long").alias("j"), F.col("label").cast("double").alias("v"))
    return matrix.hstack(embedding_matrix(spark, d), label, 64).select("i", "j", rounded("v"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_discount - 0.05 AS re, l_tax - 0.04 AS im FROM lineitem)
SELECT DISTINCT round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM s WHERE round(re, 6) < 0 AND round(im, 6) >= 0""")
def stable_shifts(spark, d):
    s = table(spark, d, "lineitem").select((F.round(F.col("l_discount") - 0.05, 6) + 0.0).alias("re"), (F.round(F.col("l_tax") - 0.04, 6) + 0.0).alias("im"))
    return matrix.stable_shifts(s, positive_imaginary=True).distinct()


@query("""WITH s AS (SELECT DISTINCT l_discount - 0.05 AS re, l_tax - 0.04 AS im FROM lineitem), r AS (SELECT DISTINCT round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM s)
SELECT re, im FROM r WHERE re < 0 AND im >= 0 ORDER BY sqrt(re * re + im * im), re, im LIMIT 20""")
def smallest_shifts(spark, d):
    s = table(spark, d, "lineitem").select((F.round(F.col("l_discount") - 0.05, 6) + 0.0).alias("re"), (F.round(F.col("l_tax") - 0.04, 6) + 0.0).alias("im"))
    return matrix.smallest_shifts(matrix.stable_shifts(s, positive_imaginary=True).distinct())


@query(f"WITH {LONG} SELECT i, j, round(v / (1 + j), 6) + 0.0 AS v FROM long WHERE j < 10")
def mat_scale_columns(spark, d):
    weights = spark.range(10).select(F.col("id").alias("j"), (1.0 / (1 + F.col("id"))).alias("w"))
    return matrix.scale_columns(embedding_matrix(spark, d), weights).select("i", "j", rounded("v"))


@query(f"WITH {GRAM} SELECT i, j, round(v, 6) + 0.0 AS v FROM gram")
def state_saved_and_loaded(spark, d):
    """The embeddings' Gram matrix as a model's state, written and read again."""
    path = f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"
    matrix.save_state({"gram": matrix.dense(matrix.gram(table(spark, d, "embeddings"), "embedding"))}, spark, path)
    found = matrix.load_state(spark, path, strict=("gram",))["gram"]
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(found)], "i bigint, j bigint, v double").select("i", "j", rounded("v"))


@query("""SELECT 'side' || label AS boundary, vec_id AS node FROM embeddings WHERE label < 3
UNION SELECT CASE WHEN label = 0 THEN 'side0' ELSE 'rest' END, vec_id FROM embeddings WHERE label IN (0, 5)""")
def boundary_sets(spark, d):
    """Point sets and cell sets of one mesh, filtered, renamed and merged without repeats."""
    e = table(spark, d, "embeddings")
    points = e.filter("label < 3").select(F.concat(F.lit("side"), F.col("label").cast("string")).alias("boundary"), F.col("vec_id").alias("node"))
    cells_ = e.filter("label in (0, 5)").select(F.when(F.col("label") == 0, "side0").otherwise("rest").alias("boundary"), F.col("vec_id").alias("node"))
    return points.unionByName(cells_).distinct()


@query("""WITH o AS (SELECT o_orderkey, o_totalprice, ((o_orderkey::HUGEINT * 2654435761) % 4294967296) % 4096 AS run FROM orders),
c AS (SELECT o_orderkey, o_totalprice, coalesce(sum(o_totalprice) OVER (ORDER BY run, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(o_totalprice) OVER () AS whole FROM o),
r AS (SELECT o_orderkey, ceil(round(before * 500 / whole, 9) - 0.5)::BIGINT AS first, ceil(round((before + o_totalprice) * 500 / whole, 9) - 0.5)::BIGINT - 1 AS last FROM c)
SELECT o_orderkey, unnest(range(first, last + 1)) AS sample FROM r WHERE last >= first""")
def facet_samples(spark, d):
    """500 evenly spaced samples over all orders, laid end to end by price."""
    return mesh.sample_facets(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 500).select("o_orderkey", "sample")


# Seen from a point outside of a hull, all of its points lie within less than a half turn.
HULL = f"""WITH {POINTS}, own AS (SELECT DISTINCT x, y FROM points WHERE label < 5),
seen AS (SELECT p.vec_id, atan2(o.y - p.y, o.x - p.x) AS t FROM points p JOIN own o ON o.x <> p.x OR o.y <> p.y),
turns AS (SELECT vec_id, coalesce(lead(t) OVER (PARTITION BY vec_id ORDER BY t), min(t) OVER (PARTITION BY vec_id) + 2 * pi()) - t AS turn FROM seen),
widest AS (SELECT vec_id, max(turn) AS turn FROM turns GROUP BY vec_id)
SELECT vec_id, label < 5 OR turn <= pi() AS inside FROM points JOIN widest USING (vec_id)"""


@query(HULL)
def hull_contains(spark, d):
    p = points_of(spark, d)
    return mesh.contained(p.select("vec_id", "x", "y"), mesh.hull_2d(p.filter("label < 5")), 1e-9).select("vec_id", "inside")


@query(f"{HULL.rpartition('SELECT vec_id, label')[0]} SELECT DISTINCT x, y FROM points JOIN widest USING (vec_id) WHERE label < 5 AND turn > pi() + 1e-9")
def hull_corners(spark, d):
    """Corners are the points from which all others are seen within less than a half turn."""
    hull = mesh.hull_2d(points_of(spark, d).filter("label < 5"))
    return spark.createDataFrame(hull, "x double, y double")


@query("SELECT doc_id, (row_number() OVER (ORDER BY (doc_id::HUGEINT * 2654435761) % 4294967296, doc_id) - 1) // 64 AS batch FROM documents")
def mini_batches(spark, d):
    """Batches of 64 in a reproducible random order."""
    ranked = matrix.ordered_rank(table(spark, d, "documents").select("doc_id"), sampling.id_hash("doc_id"), sampling.MODULUS, ["doc_id"])
    return ranked.select("doc_id", F.floor((F.col("rank") - 1) / 64).alias("batch"))


from snapforge.jobs import domains  # noqa: E402,F401 (uses the grid above; its queries are registered on import)
