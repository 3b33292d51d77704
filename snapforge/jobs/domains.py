"""Queries on the domain that orders fill: a grid of quads by customer and price, its outline as boundaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapforge.jobs.catalogue import GRID, grid_nodes, occupied_cells
from snapforge.jobs.registry import query, rounded
from snapforge.operators import domain, mesh

#: Outline edges by direction, the nodes of the lowest row as a boundary of points, and every region's samples by weight.
OUTLINE = f"""{GRID}, spot AS (SELECT DISTINCT unnest([s.a, s.b]) AS id FROM sides), place AS (SELECT id, (id // 1000)::DOUBLE AS x, (id % 1000)::DOUBLE AS y FROM spot),
mean AS (SELECT avg(x) AS mx, avg(y) AS my FROM place),
named AS (SELECT s.a AS a, s.b AS b, CASE WHEN s.a // 1000 = s.b // 1000 THEN 'upright' ELSE 'level' END AS boundary, s.a || '-' || s.b AS key FROM edges),
floor_ AS (SELECT id, x, y FROM place WHERE y = (SELECT min(y) FROM place)),
measure AS (SELECT boundary, count(*)::DOUBLE AS measure FROM named GROUP BY boundary UNION ALL SELECT 'floor', count(*)::DOUBLE FROM floor_)"""


def outline(spark, d) -> domain.Domain:
    quads = occupied_cells(spark, d)
    nodes = grid_nodes(quads)
    edges = mesh.boundary_facets(quads, "quad")
    of = lambda i: F.floor(F.get("facet", F.lit(i)) / 1000)
    faces = edges.select(F.when(of(0) == of(1), "upright").otherwise("level").alias("boundary"), "facet")
    lowest = nodes.crossJoin(F.broadcast(nodes.agg(F.min("y").alias("low")))).filter("y = low")  # with a single row
    return domain.build(nodes, ("x", "y"), lowest.select(F.lit("floor").alias("boundary"), "node_id"), faces)


@query(f"""WITH {OUTLINE}, corners AS (SELECT DISTINCT boundary, unnest([a, b]) AS id FROM named UNION SELECT 'floor', id FROM floor_), size AS (SELECT boundary, count(*) AS nodes FROM corners GROUP BY boundary),
e AS (SELECT greatest(max(x) - min(x), max(y) - min(y)) AS e FROM place)
SELECT 'interior' AS region, 'interior' AS kind, 2 AS dim, NULL::DOUBLE AS measure, (SELECT count(*) FROM place) AS nodes, round(e * 1e-6, 9) AS tolerance FROM e
UNION ALL SELECT boundary, 'boundary', 1, measure, nodes, round(e * 1e-6, 9) FROM measure JOIN size USING (boundary), e""")
def domain_regions(spark, d):
    found = outline(spark, d)
    sizes = found.boundary.groupBy(F.col("boundary").alias("region")).agg(F.count(F.lit(1)).alias("nodes"))
    sizes = sizes.unionByName(found.nodes.agg(F.lit("interior").alias("region"), F.count(F.lit(1)).alias("nodes")))
    measures = found.measures().select(F.col("boundary").alias("region"), "measure")
    return found.regions().join(sizes, "region").join(measures, "region", "left").select("region", "kind", "dim", "measure", "nodes", F.round(F.lit(found.tolerance), 9).alias("tolerance"))


WEIGHTED = f"""{OUTLINE}, share AS (SELECT * FROM (VALUES ('floor', 5), ('interior', 400), ('level', 297), ('upright', 298)) v(region, n)),
laid AS (SELECT *, ((('0x' || substr(md5(key), 1, 15))::BIGINT) % 4294967296) % 4096 AS run FROM named),
run_ AS (SELECT *, row_number() OVER (PARTITION BY boundary ORDER BY run, key) - 1 AS before, count(*) OVER (PARTITION BY boundary) AS whole FROM laid),
cut AS (SELECT r.*, round(before * n / whole::DOUBLE, 9) AS lo, round((before + 1) * n / whole::DOUBLE, 9) AS hi FROM run_ r JOIN share ON region = boundary),
picked AS (SELECT *, unnest(range(ceil(lo - 0.5)::BIGINT, ceil(hi - 0.5)::BIGINT)) AS sample FROM cut),
ends AS (SELECT p.*, q.x AS ax, q.y AS ay, r.x AS bx, r.y AS by_, (sample + 0.5 - lo) / (hi - lo) AS t FROM picked p JOIN place q ON q.id = a JOIN place r ON r.id = b),
out_ AS (SELECT *, CASE WHEN (by_ - ay) * ((ax + bx) / 2 - mx) + (ax - bx) * ((ay + by_) / 2 - my) < 0 THEN -1.0 ELSE 1.0 END AS f FROM ends, mean),
ranked AS (SELECT 'interior' AS region, x, y, row_number() OVER (ORDER BY (id::HUGEINT * 2654435761) % 4294967296, id) AS rank, NULL::DOUBLE AS nx, NULL::DOUBLE AS ny FROM place
  UNION ALL SELECT 'floor', x, y, row_number() OVER (ORDER BY (id::HUGEINT * 2654435761) % 4294967296, id), 0, -1 FROM floor_)"""


@query(f"""WITH {WEIGHTED}
SELECT boundary AS region, round(ax + t * (bx - ax), 6) + 0.0 AS x, round(ay + t * (by_ - ay), 6) + 0.0 AS y, f * (by_ - ay) + 0.0 AS nx, f * (ax - bx) + 0.0 AS ny, n / 1000.0::DOUBLE AS weight FROM out_ JOIN share ON region = boundary
UNION ALL SELECT region, x, y, nx, ny, n / 1000.0::DOUBLE FROM ranked JOIN share USING (region) WHERE rank <= n""")
def domain_weighted_batch(spark, d):
    """1,000 points over interior and boundaries by weight, boundary points with normals: from edges, and from nodes alone on the floor."""
    batch = domain.weighted_batch(outline(spark, d), 1000, {"floor": 0.005, "interior": 0.4, "level": 0.297, "upright": 0.298})
    return batch.select("region", rounded("x"), rounded("y"), rounded("nx", 5), rounded("ny", 5), rounded("weight"))


@query(f"""WITH {OUTLINE}, w AS (SELECT boundary AS region, measure / sum(measure) OVER () * 200 AS raw FROM measure), f AS (SELECT *, floor(round(raw, 9))::BIGINT AS base FROM w)
SELECT region, base + (row_number() OVER (ORDER BY round(raw - base, 9) DESC, region) <= 200 - sum(base) OVER ())::BIGINT AS n, 0 AS off FROM f""")
def domain_merged_boundary(spark, d):
    """200 points over all boundaries by length, or number of points; none is off the outline's box or without a unit normal."""
    batch = domain.merged_boundary_batch(outline(spark, d), 200)
    off = F.abs(F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny")) - 1) > 1e-9
    return batch.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(off, F.lit(True)).cast("int")).cast("int").alias("off"))
