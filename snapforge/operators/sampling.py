"""Deterministic sampling of table rows by hashes of their ids: apportioned counts, strata, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapforge.functions.matrix import free_name, ordered_rank

#: Multiplier and modulus of the hash, which any SQL engine can compute on whole numbers.
MULTIPLIER, MODULUS = 2654435761, 4294967296
#: Ranges of hashes in which a stratum's rows are counted.
RANGES = 4096


def id_hash(key: str, kind: str = "bigint") -> Column:
    """A number below ``MODULUS``. Keys of ``kind`` string, date or timestamp count as a number made of their text's bytes (its first 60 bits of MD5)."""
    if kind in ("string", "date", "timestamp", "binary"):
        whole = F.conv(F.substring(F.md5(F.col(key).cast("binary") if kind == "string" else F.col(key).cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
        return F.pmod(whole, F.lit(MODULUS))
    return F.pmod(F.col(key).cast("decimal(38,0)") * F.lit(MULTIPLIER).cast("decimal(20,0)"), F.lit(MODULUS).cast("decimal(20,0)")).cast("long")


def key_hash(rows: DataFrame, key: str) -> Column:
    """``id_hash`` of a column of ``rows`` of whatever type."""
    return id_hash(key, rows.schema[key].dataType.simpleString())


def valid_weights(weights: DataFrame, name: str, weight: str) -> DataFrame:
    """``weights`` itself; an empty table, a null, negative or infinite weight and a sum of zero are errors."""
    value = F.col(weight).cast("double")
    bad = value.isNull() | F.isnan(value) | (value < 0) | (value == float("inf"))
    found = weights.agg(F.count(F.lit(1)).alias("n"), F.sum(bad.cast("int")).alias("bad"), F.sum(value).alias("total")).first()
    if not found["n"]:
        raise ValueError("there are no weights")
    if found["bad"]:
        raise ValueError(f"{found['bad']} weights are null, negative or not finite")
    if not found["total"] > 0:
        raise ValueError("the sum of weights must be positive")
    return weights


def apportion(weights: DataFrame, name: str, weight: str, total: int) -> DataFrame:
    """Add ``count``: the largest-remainder split of ``total`` by weight, ties by name. One row per stratum."""
    if total < 0:
        raise ValueError("the number of samples must not be negative")
    raw, floor = free_name(weights, "_raw"), free_name(weights, "_floor")
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = valid_weights(weights, name, weight).withColumn(raw, F.round(F.col(weight) / F.sum(weight).over(whole) * total, 9)).withColumn(floor, F.floor(raw))
    rest = F.lit(total) - F.sum(floor).over(whole)
    rank = F.row_number().over(Window.orderBy(F.desc(F.round(F.col(raw) - F.col(floor), 9)), name))
    return share.withColumn("count", (F.col(floor) + (rank <= rest).cast("long")).cast("long")).drop(raw, floor)


def expand(counts: DataFrame, name: str) -> DataFrame:
    """One row per sample, numbered from 1 within its stratum; strata without samples have none."""
    return counts.filter("count > 0").withColumn("sample", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))))


def sample_strata(rows: DataFrame, counts: DataFrame, stratum: str, key: str) -> DataFrame:
    """The ``count`` rows of each stratum (null is one too) that are least by hash of their id.

    Rows are counted per stratum and range of hashes; ranges after the one in which the running count reaches
    ``count`` hold no chosen row, so they are left out before ranking. Equal hashes are ranked by the key, null keys last.
    """
    hashed, span, size, before, bound, rank, wanted, name = (free_name(rows, x) for x in ("_hash", "_range", "_size", "_before", "_bound", "_rank", "_wanted", "_stratum"))
    each = rows.withColumn(hashed, key_hash(rows, key)).withColumn(span, F.coalesce(F.floor(F.col(hashed) / (MODULUS // RANGES)), F.lit(RANGES)).cast("long"))
    sizes = each.groupBy(F.col(stratum).alias(name), span).agg(F.count(F.lit(1)).alias(size))
    sofar = F.coalesce(F.sum(size).over(Window.partitionBy(name).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    asked = counts.select(F.col(stratum).alias(wanted), F.col("count").alias(rank))
    bounds = sizes.withColumn(before, sofar).join(asked, F.col(name).eqNullSafe(F.col(wanted))).filter(F.col(before) < F.col(rank))
    bounds = bounds.groupBy(name, F.col(rank).alias(wanted)).agg(F.max(span).alias(bound))
    drawn = each.join(bounds, F.col(stratum).eqNullSafe(F.col(name))).filter(F.col(span) <= F.col(bound))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(F.asc_nulls_last(hashed), F.asc_nulls_last(key)))
    return drawn.withColumn(rank, place).filter(F.col(rank) <= F.col(wanted)).select(*rows.columns)


def sample_with_replacement(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` draws of rows with replacement, all equally likely: ``sample`` (0 .. n - 1) and the row drawn.

    Rows get places 1, 2, ... in the order of their hashes; each draw is a place, so one join by place deals rows out.
    """
    total = rows.count()
    if not total:
        raise ValueError("there are no rows to draw from")
    place, other = free_name(rows, "_place"), free_name(rows, "_drawn")
    ranked = ordered_rank(rows, key_hash(rows, key), MODULUS, [key], name=place)
    draws = rows.sparkSession.range(n).select(F.col("id").alias("sample"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(total)) + 1).alias(other))
    return draws.join(ranked, F.col(other) == F.col(place)).drop(place, other)


def train_validation_split(rows: DataFrame, key: str, share: float = 0.2) -> DataFrame:
    """Add ``split``: the first round(n * share) rows by hash (at least 1, at most n - 1; null keys first) validate, the others train."""
    n = rows.count()
    held = min(max(round(n * share), 1), n - 1) if n > 1 else 0
    rank = free_name(rows, "_rank")
    ranked = ordered_rank(rows, key_hash(rows, key), MODULUS, [key], name=rank)
    return ranked.withColumn("split", F.when(F.col(rank) <= held, "validation").otherwise("train")).drop(rank)


def concat_batches(*batches: DataFrame) -> DataFrame:
    """All rows of all batches; a column that a batch lacks is null there."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out


def region_batch(rows: DataFrame, counts: DataFrame, region: str, key: str, seed: int = 0) -> DataFrame:
    """A batch with ``count`` rows of each region: without repeats where the region has as many, else drawn with replacement.

    Counts of zero or less are left out; if none is left, or a region with a count has no rows, that is an error. All columns stay, so
    normals that only some regions have are null elsewhere. Column ``sample`` numbers the batch's rows within a region.
    """
    place, size, other, n = (free_name(rows, x) for x in ("_place", "_size", "_region", "_n"))
    asked = counts.select(F.col(region).alias(other), F.col("count").cast("long").alias(n)).filter(F.col(n) > 0)
    sizes = rows.groupBy(F.col(region).alias(region)).agg(F.count(F.lit(1)).alias(size))
    plan = asked.join(sizes, F.col(other).eqNullSafe(F.col(region)), "left").drop(region)
    state = plan.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(size).isNull().cast("int")).alias("empty")).first()
    if not state["n"] or state["empty"]:
        raise ValueError("every region with a count needs rows, and some count must be positive")
    least = plan.select(F.col(other).alias(region), F.least(n, size).alias("count"))
    kept = sample_strata(rows, least, region, key)  # as many rows as asked for, at most
    ranked = kept.withColumn(place, F.row_number().over(Window.partitionBy(region).orderBy(F.asc_nulls_last(key_hash(kept, key)), F.asc_nulls_last(key))).cast("long"))
    draws = plan.withColumn("sample", F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))))
    draws = draws.withColumn(place, F.when(F.col(n) <= F.col(size), F.col("sample")).otherwise(F.pmod(F.xxhash64("sample", F.lit(seed)), F.col(size)) + 1))
    draws = draws.select(F.col(other).alias(n), "sample", F.col(place).alias(size))
    return ranked.join(draws, F.col(region).eqNullSafe(F.col(n)) & (F.col(place) == F.col(size))).select(*rows.columns, "sample")


def weighted_batch(rows: DataFrame, weights: DataFrame, region: str, weight: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows, shared out among regions by weight (largest remainders); ``weight`` is the region's normalised weight on each row."""
    counts = apportion(weights.select(region, weight), region, weight, n)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one row a region
    name, share = free_name(rows, "_name"), free_name(rows, "_share")
    shares = counts.select(F.col(region).alias(name), (F.col(weight) / F.sum(weight).over(whole)).alias(share))
    batch = region_batch(rows, counts, region, key, seed)
    return batch.join(shares, F.col(region).eqNullSafe(F.col(name))).withColumn("weight", F.col(share)).drop(name, share)
