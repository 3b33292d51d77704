"""Losses and metrics as aggregate columns, and decisions over a metric's history as window queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapforge.functions.matrix import free_name
from snapforge.functions.series import grid_blocks, with_later, with_steps


def mse(prediction: Column, target: Column) -> Column:
    return F.avg((prediction - target) * (prediction - target))


def squared_error(prediction: Column, target: Column) -> Column:
    """Of two arrays, within a row."""
    return F.aggregate(F.zip_with(prediction, target, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)


def vae(reconstruction: Column, mean: Column, log_variance: Column, kl_weight: float = 1.0) -> Column:
    """Squared reconstruction error and weighted divergence from the standard normal, per row."""
    divergence = -0.5 * F.sum(1 + log_variance - mean * mean - F.exp(log_variance))
    return (F.sum(reconstruction) + kl_weight * divergence) / F.count(F.lit(1))


def relative_error(error: Column, target: Column) -> Column:
    return F.sqrt(F.sum(error)) / F.greatest(F.sqrt(F.sum(target)), F.lit(1e-12))


def rollout(rows: DataFrame, series: str, order: list[str], error: str, gamma: float) -> DataFrame:
    """Mean of gamma^step times the error over all series and steps."""
    return with_steps(rows, series, order, "_step").agg(F.avg(F.pow(F.lit(gamma), F.col("_step")) * F.col(error)).alias("loss"))


def early_stop(history: DataFrame, epoch: str, loss: str, patience: int, min_delta: float = 0.0, warmup: int = 0, mode: str = "min") -> DataFrame:
    """(epoch, loss, best, wait, stopped) of a metric's history, one row per epoch.

    An epoch is better when its metric undercuts (mode ``max``: exceeds) the last accepted best by more than ``min_delta``;
    only then it becomes ``best``. ``wait`` counts epochs since the last better one, from ``warmup`` on, and a
    history has stopped once that reaches ``patience``. What is best depends on what was accepted before, so it is a fold
    over the history, which is one number per epoch. A null or NaN metric is never better.
    """
    if mode not in ("min", "max"):
        raise ValueError("mode must be min or max")
    sign = 1.0 if mode == "min" else -1.0
    step = F.struct(F.col(epoch).alias("epoch"), F.col(loss).cast("double").alias("loss"))
    ordered = history.agg(F.array_sort(F.collect_list(step)).alias("h"))
    nothing = F.lit(None).cast("double")
    start = F.struct(nothing.alias("best"), F.lit(-1).alias("last"), F.lit(-1).alias("n"), F.lit(False).alias("stopped"), F.array().cast("array<struct<best:double,wait:bigint,stopped:boolean>>").alias("out"))

    def fold(s: Column, x: Column) -> Column:
        n = s["n"] + 1
        better = F.coalesce(~F.isnan(x["loss"]) & (s["best"].isNull() | (sign * x["loss"] < sign * s["best"] - min_delta)), F.lit(False))
        best, last = F.when(better, x["loss"]).otherwise(s["best"]), F.when(better, n).otherwise(s["last"])
        wait = F.greatest(n - F.greatest(last, F.lit(warmup - 1)), F.lit(0)).cast("long")
        stopped = s["stopped"] | (wait >= patience)
        row = F.struct(best.alias("best"), wait.alias("wait"), stopped.alias("stopped"))
        return F.struct(best.alias("best"), last.alias("last"), n.alias("n"), stopped.alias("stopped"), F.concat(s["out"], F.array(row)).alias("out"))

    kind = history.schema
    folded = ordered.select(F.explode(F.arrays_zip(F.col("h"), F.aggregate("h", start, fold, lambda s: s["out"]).alias("out"))).alias("r"))
    return folded.select(F.col("r.h.epoch").cast(kind[epoch].dataType).alias(epoch), F.col("r.h.loss").cast(kind[loss].dataType).alias(loss), "r.out.best", "r.out.wait", "r.out.stopped")


def one_step_fit(rows: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """Least-squares slope and intercept of each next value on the current one, over all series."""
    ahead = with_later(rows, series, order, value, target="_next").filter(F.col("_next").isNotNull())
    return ahead.agg(F.regr_slope("_next", value).alias("slope"), F.regr_intercept("_next", value).alias("intercept"), F.count(F.lit(1)).alias("n"))


def step_pairs(rows: DataFrame, series: str, order: list[str], value: str, horizon: int = 1) -> DataFrame:
    """All rows that have a row ``horizon`` steps later in their series, with its value as ``target`` and their place as ``step`` (from 0)."""
    return with_later(rows, series, order, value, horizon).filter("target_exists").drop("target_exists")


def grid_derivatives(rows: DataFrame, line: list[str], place: str, value: str, width: float = 1.0) -> DataFrame:
    """Adds ``first`` and ``second``: central differences along each grid line; null at its ends and beside gaps.

    The analogue on gridded data of a function's derivatives; sums of ``second`` over axes are the Laplacian. Lines are windowed in blocks of
    places, whose edge rows meet both, so a long line is many tasks'.
    """
    block, own = free_name(rows, "_block"), free_name(rows, "_own")
    along = Window.partitionBy(*line, block).orderBy(place)
    beside = (F.lag(place).over(along) == F.col(place) - 1) & (F.lead(place).over(along) == F.col(place) + 1)
    low, high = F.lag(value).over(along), F.lead(value).over(along)
    rows = grid_blocks(rows, place, block, own).withColumn("first", F.when(beside, (high - low) / (2 * width)))
    rows = rows.withColumn("second", F.when(beside, (high - 2 * F.col(value) + low) / (width * width)))
    return rows.filter(F.col(own)).drop(block, own)
