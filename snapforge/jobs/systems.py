"""Queries on large systems with one state per customer: sparse solves, low-rank Gramians, balanced truncation on factors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapforge.functions import dynamics, matrix
from snapforge.jobs.registry import query, rounded
from snapforge.operators import lowrank, sparse
from snapforge.sources.folders import table


def customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("i"), "c_acctbal", "c_nationkey")


def chain(states: DataFrame, n: int, below: float, diagonal: float, above: float) -> DataFrame:
    """(i, j, v): each state with the next by key; keys are 0 to n - 1."""
    cell = lambda j, v: F.struct(j.alias("j"), F.lit(v).alias("v"))
    i = F.col("i")
    each = states.select("i", F.explode(F.array(cell(i - 1, below), cell(i, diagonal), cell(i + 1, above))).alias("c"))
    return each.select("i", "c.j", "c.v").filter((F.col("j") >= 0) & (F.col("j") < n))


def pieces(rows: DataFrame, *columns) -> sparse.Vectors:
    return sparse.written(sparse.pieces_of(rows.select("i", F.array(*columns).alias("vec")), len(columns)), "right-sides")


#: Rows of the inverse of the chain (-1, 5/2, -1), whose characteristic roots are 2 and 1/2.
DECAY = "pow(2.0, -({i})) * (1 - pow(2.0, -2.0 * (n + 1 - ({i})))) / (1 - pow(2.0, -2.0 * (n + 1)))"


@query(f"""WITH s AS (SELECT c_custkey, count(*) OVER () AS n FROM customer)
SELECT c_custkey, round({DECAY.format(i="c_custkey + 1")}, 9) + 0.0 AS first, round({DECAY.format(i="n - c_custkey")}, 9) + 0.0 AS last FROM s""")
def sparse_solve_chain(spark, d):
    """A chain of all customers, pushed at its first and at its last."""
    states = customers(spark, d)
    n = states.count()
    of = sparse.system(chain(states, n, -1.0, 2.5, -1.0))
    push = [F.when(F.col("i") == end, 1.0).otherwise(0.0) for end in (0, n - 1)]
    x = sparse.solve(of, pieces(states, *push))
    at = lambda k: F.get("vec", F.lit(k))
    return sparse.rows_from(x, of.states).select(F.col("i").alias("c_custkey"), at(0).alias("first"), at(1).alias("last")).select("c_custkey", rounded("first", 9), rounded("last", 9))


@query("SELECT c_custkey, round(c_acctbal / 1000, 6) + 0.0 AS balance, (c_custkey % 7 - 3)::DOUBLE AS phase FROM customer")
def sparse_solve_shifted(spark, d):
    """Customers linked in a chain and to far ones, with a mass matrix and a shift: the right sides come from known states, which the solver finds again."""
    states = customers(spark, d)
    n = states.count()
    far = states.select("i", (F.col("i") * 7919 % n).alias("j"), F.lit(0.4).alias("v"))
    decay = states.select("i", F.col("i").alias("j"), (-F.col("c_nationkey") / 10).alias("v"))
    a = matrix.add(chain(states, n, 0.5, -3.0, 0.8), far, decay)
    e = chain(states, n, 0.25, 2.0, -0.25)
    known = states.select("i", F.posexplode(F.array(F.col("c_acctbal") / 1000, (F.col("i") % 7 - 3).cast("double"))).alias("j", "v")).withColumn("j", F.col("j").cast("long"))
    b = matrix.matmul(matrix.add(a, matrix.scale(e, -1.5)), known)
    of = sparse.system(a, e)
    x = sparse.solve(of, sparse.written(sparse.columns_of(b, 2), "right-sides"), 1.0, -1.5, tol=1e-11)
    at = lambda k: F.get("vec", F.lit(k))
    return sparse.rows_from(x, of.states).select(F.col("i").alias("c_custkey"), at(0).alias("balance"), at(1).alias("phase")).select("c_custkey", rounded("balance"), rounded("phase"))


def gramian(factor: lowrank.Factor, of: sparse.System) -> DataFrame:
    """(c_custkey, own, with_first): the Gramian's diagonal and its column of the first customer."""
    z = lowrank.factor_rows(factor, of)
    first = z.filter("i = 0").select(F.col("vec").alias("one"))  # one row
    found = z.crossJoin(F.broadcast(first)).select(F.col("i").alias("c_custkey"), matrix.dot(F.col("vec"), F.col("vec")).alias("own"), matrix.dot(F.col("vec"), F.col("one")).alias("with_first"))
    # Balances have two decimals, so true values lie on halves of the fifth decimal; the last digits of the sums must not decide these.
    return found.select("c_custkey", *[F.round(c, 10).alias(c) for c in ("own", "with_first")]).select("c_custkey", rounded("own", 5), rounded("with_first", 5))


@query("""WITH s AS (SELECT c_custkey, -(1 + c_nationkey / 5.0) AS a, c_acctbal / 1000 AS b FROM customer), one AS (SELECT a AS a1, b AS b1 FROM s WHERE c_custkey = 0)
SELECT c_custkey, round(-b * b / (2 * a), 5) + 0.0 AS own, round(-b * b1 / (a + a1), 5) + 0.0 AS with_first FROM s, one""")
def lr_adi_gramian(spark, d):
    """Customers decay at a rate of their nation and are driven by their balance."""
    states = customers(spark, d)
    of = sparse.system(states.select("i", F.col("i").alias("j"), (-(1 + F.col("c_nationkey") / 5)).alias("v")))
    # What is left is relative to the sum of all squared balances, while every customer's own number is rounded to five decimals.
    return gramian(lowrank.lr_adi(of, pieces(states, F.col("c_acctbal") / 1000), tol=1e-20), of)


@query("""WITH s AS (SELECT c_custkey, count(*) OVER () AS n FROM customer)
SELECT round(0.5 * sum(2 * (1 - (pow(2.0, -(c_custkey + 1)) + pow(2.0, -(n - c_custkey))) / (1 + pow(2.0, -(n + 1))))) , 6) AS energy FROM s""")
def lr_adi_chain_energy(spark, d):
    """The Gramian's trace of a coupled chain driven at all customers alike: half of b^T (-A)^-1 b."""
    states = customers(spark, d)
    of = sparse.system(chain(states, states.count(), 1.0, -2.5, 1.0))
    found = lowrank.lr_adi(of, pieces(states, F.lit(1.0)))
    energy = float(np.trace(sparse.inner(found.vectors, found.vectors)))
    return spark.createDataFrame([(energy,)], "energy double").select(rounded("energy"))


@query("""WITH s AS (SELECT c_custkey, (c_nationkey - 12) / 40.0 AS a, c_acctbal / 1000 AS b FROM customer), one AS (SELECT a AS a1, b AS b1 FROM s WHERE c_custkey = 0)
SELECT c_custkey, round(b * b / (1 - a * a), 5) + 0.0 AS own, round(b * b1 / (1 - a * a1), 5) + 0.0 AS with_first FROM s, one""")
def lr_smith_gramian(spark, d):
    """The same in discrete time."""
    states = customers(spark, d)
    of = sparse.system(states.select("i", F.col("i").alias("j"), ((F.col("c_nationkey") - 12) / 40).alias("v")))
    return gramian(lowrank.lr_smith(of, pieces(states, F.col("c_acctbal") / 1000)), of)


@query("""WITH s AS (SELECT c_custkey % 2 AS k, -(1.0 + 2 * (c_custkey % 2)) - 1e-8 AS a, sum(c_acctbal / 1000 * (1 + c_nationkey) / 100) AS r FROM customer GROUP BY ALL),
p AS (SELECT x.k AS i, y.k AS j, -x.r * y.r / (x.a + y.a) AS p, -1 / (x.a + y.a) AS q FROM s x, s y),
m AS (SELECT l.i, r.j, sum(l.p * r.q) AS v FROM p l JOIN p r ON l.j = r.i GROUP BY l.i, r.j),
t AS (SELECT sum(v) FILTER (i = j) AS tr, max(v) FILTER (i = 0 AND j = 0) * max(v) FILTER (i = 1 AND j = 1) - max(v) FILTER (i = 0 AND j = 1) * max(v) FILTER (i = 1 AND j = 0) AS det FROM m)
SELECT 0 AS k, round(sqrt(tr / 2 + sqrt(greatest(tr * tr / 4 - det, 0))), 5) AS hsv, -1.0::DOUBLE AS pole FROM t UNION ALL SELECT 1, round(sqrt(tr / 2 - sqrt(greatest(tr * tr / 4 - det, 0))), 5), -3.0::DOUBLE FROM t""")
def bt_factors(spark, d):
    """All customers as states of two speeds; the reduction finds the two states that matter, their Hankel singular values and poles."""
    states = customers(spark, d)
    of = sparse.system(states.select("i", F.col("i").alias("j"), (-(1.0 + 2 * (F.col("i") % 2))).alias("v")))
    found, e = lowrank.balanced_truncation(of, pieces(states, F.col("c_acctbal") / 1000), pieces(states, (1 + F.col("c_nationkey")) / 100), order=2)
    poles = sorted(np.linalg.eigvals(np.linalg.solve(e, found.a)).real, reverse=True)
    rows = [(k, float(s), float(p)) for k, (s, p) in enumerate(zip(found.hsv[:2], poles, strict=True))]
    return spark.createDataFrame(rows, "k int, hsv double, pole double").select("k", rounded("hsv", 5), rounded("pole", 5))


# Dynamics of an order's lines: a state is (quantity, discount), scaled alike. Line numbers repeat, so further columns settle the order.
STEPS = """s AS (SELECT l_orderkey AS o, l_quantity / 50 AS x1, l_discount * 10 AS x2, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_discount) - 1 AS step FROM lineitem),
p AS (SELECT a.x1, a.x2, b.x1 AS y1, b.x2 AS y2 FROM s a JOIN s b ON a.o = b.o AND b.step = a.step + 1),
g AS (SELECT sum(x1 * x1) AS a, sum(x1 * x2) AS b, sum(x2 * x2) AS d, sum(y1 * x1) AS c11, sum(y1 * x2) AS c12, sum(y2 * x1) AS c21, sum(y2 * x2) AS c22 FROM p),
k AS (SELECT (c11 * d - c12 * b) / (a * d - b * b) AS k11, (c12 * a - c11 * b) / (a * d - b * b) AS k12, (c21 * d - c22 * b) / (a * d - b * b) AS k21, (c22 * a - c21 * b) / (a * d - b * b) AS k22 FROM g)"""


def line_states(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_quantity", "l_discount").alias("line"), F.array((F.col("l_quantity") / 50).cast("double"), (F.col("l_discount") * 10).cast("double")).alias("state"))


def line_dynamics(rows: DataFrame) -> dynamics.LinearDynamics:
    return dynamics.fit(dynamics.with_successor(rows, "l_orderkey", "line", "state"), "state", "successor")


@query(f"WITH {STEPS} SELECT 0 AS i, 0 AS j, round(k11, 6) AS v FROM k UNION ALL SELECT 0, 1, round(k12, 6) FROM k UNION ALL SELECT 1, 0, round(k21, 6) FROM k UNION ALL SELECT 1, 1, round(k22, 6) FROM k")
def dynamics_fit(spark, d):
    """The matrix that takes a line's state to the next one's best."""
    k = line_dynamics(line_states(spark, d)).k
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(k)], "i int, j int, v double").select("i", "j", rounded("v"))


@query(f"""WITH {STEPS},
p0 AS (SELECT o, x1, x2 FROM s WHERE step = 0), p1 AS (SELECT o, k11 * x1 + k12 * x2 AS x1, k21 * x1 + k22 * x2 AS x2 FROM p0, k),
p2 AS (SELECT o, k11 * x1 + k12 * x2 AS x1, k21 * x1 + k22 * x2 AS x2 FROM p1, k), p3 AS (SELECT o, k11 * x1 + k12 * x2 AS x1, k21 * x1 + k22 * x2 AS x2 FROM p2, k),
made AS (SELECT *, 1 AS step FROM p1 UNION ALL SELECT *, 2 FROM p2 UNION ALL SELECT *, 3 FROM p3)
SELECT step, count(*) AS n, round(avg(((s.x1 - m.x1) ** 2 + (s.x2 - m.x2) ** 2) / 2), 6) AS loss FROM s JOIN made m USING (o, step) GROUP BY step""")
def dynamics_rollout_loss(spark, d):
    """Mean squared error one to three lines ahead of each order's first."""
    rows = line_states(spark, d)
    return dynamics.rollout_loss(rows, "l_orderkey", "line", "state", line_dynamics(rows), 3).select("step", "n", rounded("loss"))


@query("SELECT c_custkey AS i, 0 AS j, round(c_acctbal, 2) + 0.0 AS v FROM customer UNION ALL SELECT c_custkey + (SELECT max(c_custkey) + 1 FROM customer), 1, 1.0 FROM customer")
def mat_vstack(spark, d):
    """Balances on top of an identity's first columns, generated for as many customers and summed by row."""
    states = customers(spark, d)
    n = states.agg(F.max("i").alias("n")).first()["n"] + 1
    top = states.select("i", F.lit(0).cast("long").alias("j"), F.col("c_acctbal").cast("double").alias("v"))
    below = matrix.identity(spark, n).join(states.select("i"), "i", "left_semi").select("i", F.lit(1).cast("long").alias("j"), "v")
    return matrix.vstack(top, below, n).select("i", F.col("j").cast("int").alias("j"), rounded("v", 2))
