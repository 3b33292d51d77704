"""Texts, free names and size-checked broadcasts for the jobs of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapforge.sources.folders import new_folder, shared_folder, write_table

__all__ = ["BROADCAST_ROWS", "free_name", "join_hot", "maybe_broadcast", "new_folder", "shared_folder", "text_of", "write_table"]

#: Rows that a semi or anti join may broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 100_000


def text_of(column: str | Column) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that no column of ``df`` bears (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df``, whose counted size is ``rows``, for broadcast only while that is under ``limit``."""
    return F.broadcast(df) if rows <= limit else df


def join_hot(left: DataFrame, right: DataFrame, key: str, count: str, parts: int = 1000) -> DataFrame:
    """Inner join on ``key``, which is unique in ``right``; ``count`` says there how many rows of ``left`` have it.

    A key with more than 1/``parts`` of all rows would fill a task by itself. There are fewer than ``parts`` such keys,
    whatever the data, so their rows of ``right`` are broadcast; all other keys are small and shuffled. ``left``
    is read twice, so it should be a written table.
    """
    total = right.agg(F.sum(count).alias("n")).first()["n"] or 0
    hot = right.filter(F.col(count) > F.lit(total / parts))
    cold = right.filter(F.col(count) <= F.lit(total / parts))
    keys = F.broadcast(hot.select(key))
    return left.join(F.broadcast(hot), key).unionByName(left.join(keys, key, "left_anti").join(cold, key))
