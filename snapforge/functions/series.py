"""Places and later values of rows within ordered series of any length: a series is split by ranges of its order, so none is one task's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapforge.functions.matrix import free_name
from snapforge.sources.folders import write_table

#: Grid places that one task's window covers at most, when the grid has one row a place.
PLACES = 4096


def with_steps(rows: DataFrame, series: str, order: list[str], name: str = "step", ranges: int | None = None, later: tuple[str, str, int] | None = None) -> DataFrame:
    """Add ``name``, each row's place (from 0) in its series by ``order``; a null series is one too, and null order comes first.

    With ``later`` (value, target, horizon), ``target`` is the value ``horizon`` rows later and ``target``_exists tells whether there is
    such a row. Rows are parted by ranges of series and order together. A part numbers its own rows; only the
    second and later parts of a series are moved up, by the counts of those before: a table with at most as many rows as there are
    parts. Likewise at most ``horizon`` first rows of each such part are handed back to the part before. Equal orders are in
    one part, in any order. Columns called ``name`` or ``target`` are replaced.
    """
    target = later[1] if later else None
    rows = rows.drop(name) if target is None else rows.drop(*{name, target, f"{target}_exists"} - {later[0], series, *order})
    part, before, n, other, place, ahead, exists = (free_name(rows, x) for x in ("_part", "_before", "_n", "_series", "_place", "_ahead", "_exists"))
    keys = [series, *order]
    ranged = rows.repartitionByRange(ranges, *keys) if ranges else rows.repartitionByRange(*keys)
    parts = write_table(ranged.withColumn(part, F.spark_partition_id()), "ranges")
    sofar = Window.partitionBy(series).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy(series, part).agg(F.count(F.lit(1)).alias(n)).withColumn(before, F.sum(n).over(sofar)).filter(F.col(before) > 0)
    firsts = F.broadcast(counts.select(F.col(series).alias(other), F.col(part).alias(n), before))  # fewer rows than parts
    along = Window.partitionBy(series, part).orderBy(*order)
    numbered = parts.withColumn(place, F.row_number().over(along).cast("long") - 1)
    if later:
        numbered = numbered.withColumn(ahead, F.lead(later[0], later[2]).over(along)).withColumn(exists, F.lead(F.lit(True), later[2]).over(along))
    numbered = numbered.join(firsts, F.col(series).eqNullSafe(F.col(other)) & (F.col(part) == F.col(n)), "left").drop(other, n)
    step = F.col(place) + F.coalesce(F.col(before), F.lit(0))
    if not later:
        return numbered.withColumn(name, step).drop(part, before, place)
    numbered = write_table(numbered.withColumn(name, step), "steps")  # ties have one order from here on
    heads = numbered.filter(F.col(before).isNotNull() & (F.col(place) < later[2]))
    heads = F.broadcast(heads.select(F.col(series).alias(other), (F.col(name) - later[2]).alias(n), F.col(later[0]).alias(f"{other}_v")))  # at most horizon rows a part
    met = numbered.join(heads, F.col(series).eqNullSafe(F.col(other)) & (F.col(name) == F.col(n)) & F.col(exists).isNull(), "left")
    value = F.when(F.col(exists), F.col(ahead)).otherwise(F.col(f"{other}_v"))
    met = met.withColumn(target, value).withColumn(f"{target}_exists", F.col(exists).isNotNull() | F.col(n).isNotNull())
    return met.drop(other, n, f"{other}_v", part, before, place, ahead, exists)


def with_later(rows: DataFrame, series: str, order: list[str], value: str, horizon: int = 1, target: str = "target", ranges: int | None = None) -> DataFrame:
    """``with_steps`` and ``target``; see there."""
    if horizon < 1:
        raise ValueError("the horizon must be at least one step")
    return with_steps(rows, series, order, ranges=ranges, later=(value, target, horizon))


def grid_blocks(rows: DataFrame, place: str, name: str, own: str, width: int = PLACES) -> DataFrame:
    """Rows with their block of places as ``name``; those within 1 of a block's edge come a second time, in the next block, with ``own`` false."""
    block = lambda shift: F.floor((F.col(place) + shift) / F.lit(width)).cast("long")
    home = free_name(rows, "_home")
    each = rows.withColumn(home, block(0)).withColumn(name, F.explode(F.array_distinct(F.array(block(-1), block(0), block(1)))))
    return each.withColumn(own, F.col(name).eqNullSafe(F.col(home))).drop(home)

