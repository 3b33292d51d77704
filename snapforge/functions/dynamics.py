"""Linear dynamics x' = K x of vector states, fitted on pairs of neighbouring states and rolled out over several steps."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapforge.functions.matrix import as_matrix, dense, free_name, gram
from snapforge.functions.series import with_steps


@dataclass(frozen=True)
class LinearDynamics:
    """The matrix of one step, and its eigenvalues by magnitude, largest first."""

    k: np.ndarray

    @property
    def eigenvalues(self) -> np.ndarray:
        values = np.linalg.eigvals(self.k)
        return values[np.argsort(-np.abs(values), kind="stable")]


def with_successor(rows: DataFrame, series: str, time: str, state: str, name: str = "successor") -> DataFrame:
    """Add the state that follows in the same series, null for the last; a column called ``name`` is replaced."""
    place = free_name(rows, "_step")
    return with_steps(rows, series, [time], place, later=(state, name, 1)).drop(place, f"{name}_exists")


def fit(pairs: DataFrame, state: str, successor: str, ridge: float = 0.0) -> LinearDynamics:
    """Least squares over all pairs that have both states, with ``ridge`` added to the states' Gram matrix.

    Two Gram sums are all that the driver sees. States that don't span their space need a ridge; without one they are an error.
    """
    both = pairs.filter(F.col(state).isNotNull() & F.col(successor).isNotNull())
    own, cross = dense(gram(both, state)), dense(gram(both, state, successor))
    if not own.size:
        raise ValueError("there are no pairs of states")
    regular = own + ridge * np.eye(len(own))
    if np.linalg.matrix_rank(regular, hermitian=True) < len(regular):
        raise ValueError("the states don't span their space: give a ridge")
    return LinearDynamics(np.linalg.solve(regular, cross).T)


def rollout(starts: DataFrame, row_id: str, state: str, found: LinearDynamics, steps: int) -> DataFrame:
    """(id, step, predicted) for steps 0 to ``steps`` from each start; null states are left out."""
    k = found.k

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = as_matrix(batch.column(1))
                for step in range(steps + 1):
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), step, np.int32)), pa.array(list(x), pa.list_(pa.float64()))], [row_id, "step", "predicted"])
                    x = x @ k.T

    wanted = starts.filter(F.col(state).isNotNull()).select(row_id, F.col(state).cast("array<double>").alias(state))
    kind = wanted.schema[row_id].dataType.simpleString()
    return wanted.mapInArrow(roll, f"{row_id} {kind}, step int, predicted array<double>")


def rollout_loss(rows: DataFrame, series: str, time: str, state: str, found: LinearDynamics, steps: int) -> DataFrame:
    """(step, n, loss): the mean squared error after 1 to ``steps`` steps from each series' first state, over the series that reach so far.

    Series are numbered by their own rows, so a series without ``steps`` more states counts for those that it has.
    """
    place, predicted = free_name(rows, "_step"), free_name(rows, "_predicted")
    numbered = with_steps(rows.select(series, time, state), series, [time], place).select(series, state, F.col(place).cast("int").alias(place)).filter(F.col(place) <= steps)
    made = rollout(numbered.filter(F.col(place) == 0), series, state, found, steps).filter("step > 0")
    made = made.select(series, F.col("step").alias(place), F.col("predicted").alias(predicted))
    error = F.aggregate(F.zip_with(F.col(state), F.col(predicted), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, e: s + e) / F.size(predicted)
    return numbered.join(made, [series, place]).groupBy(F.col(place).alias("step")).agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("loss"))
