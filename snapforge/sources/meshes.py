"""Meshes from text files, and named sets of cells and points turned into boundaries.

A mesh is a table of nodes (node_id, x, y, z) and one of cells (cell_id, cell_type, conn, set_name). Files are read by
``spark.read.text``, many at a time; each is cut into sections and lines by SQL functions, so a file is one record and must
fit into a task's memory, while meshes of any size can come as Parquet tables of the same columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapforge.operators.mesh import boundary_facets

# Gmsh's element numbers and Abaqus' element names with the cell types they stand for.
MSH_TYPES = {1: "line", 2: "triangle", 3: "quad", 4: "tetra", 5: "hexahedron", 6: "wedge", 7: "pyramid", 8: "line3", 9: "triangle6", 11: "tetra10", 15: "vertex"}
INP_TYPES = {"T2D2": "line", "B21": "line", "CPS3": "triangle", "CPE3": "triangle", "S3": "triangle", "CPS4": "quad", "CPE4": "quad", "S4": "quad", "C3D4": "tetra",
             "C3D10": "tetra10", "C3D8": "hexahedron", "C3D6": "wedge", "CPS6": "triangle6"}
# Topological dimension of each cell type.
DIMENSION = {"vertex": 0, "line": 1, "line3": 1, "triangle": 2, "triangle6": 2, "quad": 2, "quad8": 2, "quad9": 2, "tetra": 3, "tetra10": 3,
             "hexahedron": 3, "hexahedron20": 3, "hexahedron27": 3, "wedge": 3, "wedge15": 3, "pyramid": 3, "pyramid13": 3}


def _named(key: Column, names: Mapping) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key)


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def _node(parts: Column, kind: str = "double") -> list[Column]:
    return [F.get(parts, F.lit(0)).cast("long").alias("node_id"), *[F.coalesce(F.get(parts, F.lit(i)).cast(kind), F.lit(0.0)).alias(a) for i, a in enumerate("xyz", 1)]]


def read_msh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and cells of Gmsh's text format, version 2; ``set_name`` is a cell's first tag, by its name where the file has one."""
    files = spark.read.text(path, wholetext=True)
    section = lambda name: F.slice(_lines(F.regexp_extract("value", rf"(?s)\${name}\s*\n(.*?)\$End{name}", 1)), 2, 1 << 30)
    nodes = files.select(F.explode(section("Nodes")).alias("line")).select(F.split("line", r"\s+").alias("p")).select(*_node(F.col("p")))
    names = F.transform(section("PhysicalNames"), lambda x: F.struct(F.regexp_extract(x, r"^\d+\s+(\d+)", 1).alias("tag"), F.regexp_extract(x, r'"(.*)"', 1).alias("name")))
    rows = files.select(F.map_from_entries(names).alias("names"), F.explode(section("Elements")).alias("line")).select("names", F.split("line", r"\s+").alias("p"))
    tags = F.get("p", F.lit(2)).cast("int")
    tag = F.when(tags > 0, F.get("p", F.lit(3)))
    conn = F.transform(F.slice("p", tags + 4, F.greatest(F.size("p") - tags - 3, F.lit(0))), lambda x: x.cast("long"))
    cells = rows.select(F.get("p", F.lit(0)).cast("long").alias("cell_id"), _named(F.get("p", F.lit(1)).cast("int"), MSH_TYPES).alias("cell_type"), conn.alias("conn"),
                        F.coalesce(F.try_element_at("names", tag), tag).alias("set_name"))
    return nodes, cells


def read_inp(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and cells of Abaqus' text format; ``set_name`` is the ELSET of an element's block. Unknown types have a null ``cell_type``."""
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?m)^(?=\*[A-Za-z])")).alias("block"))
    head, body = F.upper(F.substring_index("block", "\n", 1)), F.slice(_lines(F.col("block")), 2, 1 << 30)
    parts = lambda: F.transform(F.split("line", ","), lambda x: F.trim(x))
    data = blocks.select(head.alias("head"), F.explode(body).alias("line")).filter(~F.col("line").startswith("**"))
    nodes = data.filter(F.col("head").rlike(r"^\*NODE\s*(,|\r?$)")).select(parts().alias("p")).select(*_node(F.col("p")))
    value = lambda key: F.regexp_extract("head", rf"{key}\s*=\s*([^,\s]+)", 1)
    rows = data.filter(F.col("head").rlike(r"^\*ELEMENT\b")).select("head", parts().alias("p"))
    conn = F.transform(F.filter(F.slice("p", 2, 1 << 30), lambda x: x != ""), lambda x: x.cast("long"))
    cells = rows.select(F.get("p", F.lit(0)).cast("long").alias("cell_id"), _named(value("TYPE"), INP_TYPES).alias("cell_type"), conn.alias("conn"), F.when(value("ELSET") != "", value("ELSET")).alias("set_name"))
    return nodes, cells


def named(sets: DataFrame, keep: Sequence[str] | None = None, rename: Mapping[str, str] | None = None) -> DataFrame:
    """``sets`` (set_name, ...) filtered by their old names, then under their new ones as ``boundary``; sets that share one are merged."""
    chosen = sets if keep is None else sets.filter(F.col("set_name").isin(*keep))
    name = F.coalesce(_named(F.col("set_name"), rename), F.col("set_name")) if rename else F.col("set_name")
    return chosen.withColumn("boundary", name).drop("set_name")


def boundary_nodes(point_sets: DataFrame, cells: DataFrame, keep: Sequence[str] | None = None, rename: Mapping[str, str] | None = None, use_cells: bool = True) -> DataFrame:
    """(boundary, node_id) without repeats, from point sets (set_name, node_id) and from the nodes of the cells of a set.

    Cells count where some point set is kept, or else if ``use_cells``.
    """
    points = named(point_sets, keep, rename).select("boundary", "node_id")
    of_cells = named(cells.filter(F.col("set_name").isNotNull()).select("set_name", F.explode("conn").alias("node_id")), keep, rename).select("boundary", "node_id")
    return (points.unionByName(of_cells) if use_cells or points.limit(1).count() else points).distinct()


def boundary_faces(cells: DataFrame, dimension: int, keep: Sequence[str] | None = None, rename: Mapping[str, str] | None = None) -> DataFrame:
    """(boundary, facet): the facets of each named set, edges in two dimensions and triangles in three.

    Cells of one dimension less are facets themselves (quads are split); cells of full dimension give the facets that just one
    cell of the set has. Cells of other types and dimensions give none. Quadratic cells count with their corners.
    """
    chosen = named(cells.filter(F.col("set_name").isNotNull()).select("set_name", "cell_type", "conn"), keep, rename)
    corners = lambda n: F.slice("conn", 1, n)
    if dimension == 2:
        direct = chosen.filter(F.col("cell_type").isin("line", "line3")).select("boundary", corners(2).alias("facet"))
        solid = chosen.filter(F.col("cell_type").isin("triangle", "triangle6", "quad", "quad8", "quad9"))
    else:
        direct = surface_triangles(chosen)
        solid = chosen.filter(F.col("cell_type").isin("tetra", "tetra10"))
    kind = F.regexp_extract("cell_type", "^[a-z]+", 0)
    outer = boundary_facets(solid.select("boundary", kind.alias("cell_type"), "conn"), None, by=["boundary"])
    return direct.unionByName(outer)


def surface_triangles(cells: DataFrame) -> DataFrame:
    """(boundary, facet) of triangles and of quads, split in two; other cells are left out."""
    c = lambda i: F.get("conn", F.lit(i))
    tri, quad = F.array(F.array(c(0), c(1), c(2))), F.array(F.array(c(0), c(1), c(2)), F.array(c(0), c(2), c(3)))
    facets = F.when(F.col("cell_type").startswith("triangle"), tri).when(F.col("cell_type").startswith("quad"), quad)
    return cells.filter(facets.isNotNull()).select("boundary", F.explode(facets).alias("facet"))


def checked_facets(facets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``facets`` itself; a facet with a node that doesn't exist is an error."""
    used = facets.select(F.explode("facet").alias("node_id"))
    stray = used.join(nodes.select("node_id"), "node_id", "left_anti").select("node_id").first()
    if stray is not None:
        raise ValueError(f"a facet uses node {stray['node_id']}, which doesn't exist")
    return facets


def dimension_of(cell_type: str) -> int:
    return DIMENSION[cell_type]
