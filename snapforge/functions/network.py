"""Networks of dense layers, trained on tables: tasks sum gradients over their rows, the driver steps a vector of weights.

Rows never leave the executors. What travels is the weights, once a step, and at most ``GROUPS`` sums as long as they are; the weights' number
depends on the layers alone, and more than ``MOST_WEIGHTS`` are refused.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapforge.functions.matrix import as_matrix
from snapforge.functions.series import with_later
from snapforge.operators.sampling import train_validation_split
from snapforge.sources.folders import write_table

MOST_WEIGHTS = 4_000_000
GROUPS = 16


@dataclass(frozen=True)
class Network:
    """Dense layers of ``widths`` with rectifiers between them, but not after the layers in ``linear`` (numbered from 1) and the last."""

    widths: tuple[int, ...]
    weights: np.ndarray
    linear: frozenset[int] = frozenset()

    def layers(self, weights: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        flat, out, at = self.weights if weights is None else weights, [], 0
        for a, b in zip(self.widths, self.widths[1:], strict=False):
            out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def _bent(self, layer: int) -> bool:
        return layer < len(self.widths) - 1 and layer not in self.linear

    def values(self, x: np.ndarray, first: int = 0, last: int | None = None) -> list[np.ndarray]:
        """Of every layer from ``first`` (the input) to ``last``."""
        out = [x]
        for k, (w, b) in enumerate(self.layers()[first:last], first + 1):
            z = out[-1] @ w + b
            out.append(np.maximum(z, 0) if self._bent(k) else z)
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
        """Of the sum over rows of the mean squared error of a row, and that sum."""
        values, parts = self.values(x), []
        error = values[-1] - y
        back = 2 * error / y.shape[1]
        for k in range(len(values) - 1, 0, -1):
            if self._bent(k):
                back = back * (values[k] > 0)
            parts = [(values[k - 1].T @ back).ravel(), back.sum(axis=0), *parts]
            back = back @ self.layers()[k - 1][0].T
        return np.concatenate(parts), float((error * error).mean(axis=1).sum())


def network(widths: Sequence[int], seed: int = 0, linear: Sequence[int] = ()) -> Network:
    """With uniform weights within 1 / sqrt(inputs), as dense layers usually start."""
    if len(widths) < 2 or min(widths) < 1:
        raise ValueError("a network has at least one layer, and every layer a width")
    size = sum(a * b + b for a, b in zip(widths, widths[1:], strict=False))
    if size > MOST_WEIGHTS:
        raise ValueError(f"{size} weights are more than {MOST_WEIGHTS}")
    draw = np.random.default_rng(seed)
    parts = [draw.uniform(-1, 1, a * b + b) / math.sqrt(a) for a, b in zip(widths, widths[1:], strict=False)]
    return Network(tuple(widths), np.concatenate(parts), frozenset(linear))


def autoencoder(inputs: int, latent: int, hidden: Sequence[int] = (), seed: int = 0) -> Network:
    """Hidden layers down to ``latent``, which is linear, and the same ones back."""
    return network([inputs, *hidden, latent, *reversed(hidden), inputs], seed, [len(hidden) + 1])


def apply(rows: DataFrame, vec: str, net: Network, name: str, first: int = 0, last: int | None = None) -> DataFrame:
    """Add layer ``last``'s values (the output's by default) for layer ``first``'s in ``vec``; null for null. Encoders and decoders are parts of a network."""
    shared = rows.sparkSession.sparkContext.broadcast(net)  # at most MOST_WEIGHTS numbers

    @F.arrow_udf("array<double>")
    def run(x: pa.Array) -> pa.Array:
        there = x.is_valid()
        if not there.true_count:
            return pa.nulls(len(x), pa.list_(pa.float64()))
        found = shared.value.values(as_matrix(x.filter(there)), first, last)[-1]
        out = iter(found.tolist())
        return pa.array([next(out) if ok else None for ok in there.to_pylist()], pa.list_(pa.float64()))

    return rows.withColumn(name, run(F.col(vec).cast("array<double>")))


@dataclass(frozen=True)
class Training:
    """``batches`` a pass deal rows out anew by a hash of key, seed and epoch; ``schedule`` maps an epoch to a factor of ``rate``."""

    epochs: int = 100
    rate: float = 1e-3
    optimiser: str = "adam"
    decay: float = 0.0
    momentum: float = 0.9
    clip: float | None = None
    batches: int = 1
    schedule: Callable[[int], float] = field(default=lambda epoch: 1.0)
    patience: int | None = None
    warmup: int = 0
    min_delta: float = 0.0
    seed: int = 0


def stepped(milestones: Sequence[int], gamma: float = 0.1) -> Callable[[int], float]:
    return lambda epoch: gamma ** sum(epoch >= m for m in milestones)


def cosine(length: int, least: float = 0.0) -> Callable[[int], float]:
    return lambda epoch: least + (1 - least) * (1 + math.cos(math.pi * epoch / length)) / 2


def _optimiser(kind: str, size: int, momentum: float, decay: float) -> Callable[[np.ndarray, np.ndarray, float], np.ndarray]:
    if kind not in ("sgd", "adam", "adamw", "rmsprop", "adagrad"):
        raise ValueError(f"there is no optimiser {kind}")
    mean, square, n = np.zeros(size), np.zeros(size), 0

    def step(w: np.ndarray, g: np.ndarray, rate: float) -> np.ndarray:
        nonlocal mean, square, n
        n += 1
        if kind == "adamw":
            w = w * (1 - rate * decay)
        else:
            g = g + decay * w
        if kind == "sgd":
            mean = g if n == 1 else momentum * mean + g
            return w - rate * mean
        if kind == "adagrad":
            square = square + g * g
            return w - rate * g / (np.sqrt(square) + 1e-10)
        if kind == "rmsprop":
            square = 0.99 * square + 0.01 * g * g
            return w - rate * g / (np.sqrt(square) + 1e-8)
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        return w - rate * (mean / (1 - 0.9**n)) / (np.sqrt(square / (1 - 0.999**n)) + 1e-8)

    return step


def summed(rows: DataFrame, net: Network, slope: bool) -> tuple[np.ndarray | None, float, int]:
    """Gradient (or none), loss and number of all ``rows`` (x, y): one record a task, added up in at most ``GROUPS`` before the driver."""
    shared = rows.sparkSession.sparkContext.broadcast(net)  # at most MOST_WEIGHTS numbers
    schema = pa.schema([("part", pa.int32()), ("g", pa.list_(pa.float64())), ("loss", pa.float64()), ("n", pa.int64())])

    def record(part: int, g: np.ndarray, loss: float, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([g], pa.list_(pa.float64())), pa.array([loss]), pa.array([n], pa.int64())], schema=schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, g, loss, n = shared.value, 0.0, 0.0, 0
        for batch in batches:
            if not len(batch):
                continue
            x, y = as_matrix(batch.column(0)), as_matrix(batch.column(1))
            if x.shape[1] != own.widths[0] or y.shape[1] != own.widths[-1]:
                raise ValueError(f"rows of {x.shape[1]} and {y.shape[1]} numbers meet a network of {own.widths[0]} and {own.widths[-1]}")
            if slope:
                more, e = own.gradient(x, y)
                g = g + more
            else:
                e = float(((own.values(x)[-1] - y) ** 2).mean(axis=1).sum())
            loss, n = loss + e, n + len(x)
        if n:
            yield record(0, g if slope else np.zeros(0), loss, n)

    def add(records: pa.Table) -> pa.Table:
        g = np.sum(as_matrix(records.column("g").combine_chunks()), axis=0) if slope else np.zeros(0)
        return pa.Table.from_batches([record(0, g, float(np.sum(records.column("loss").to_numpy())), int(np.sum(records.column("n").to_numpy())))])

    parts = rows.select("x", "y").mapInArrow(each, "part int, g array<double>, loss double, n bigint").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    found = parts.groupBy("part").applyInArrow(add, "part int, g array<double>, loss double, n bigint").collect()
    g = np.sum([r["g"] for r in found], axis=0) if slope and found else None
    return g, sum(r["loss"] for r in found), sum(r["n"] for r in found)


@dataclass(frozen=True)
class Trained:
    """The best network by validation loss, its epoch, and (epoch, rate, train, validation) of every epoch that ran."""

    net: Network
    best: int
    history: tuple[tuple[int, float, float, float], ...]


def train(rows: DataFrame, net: Network, how: Training = Training(), validation: DataFrame | None = None, key: str = "key") -> Trained:  # noqa: B008 (frozen)
    """Fit ``net`` to ``rows`` (key, x, y); an epoch's ``train`` loss is the mean over its batches as they came, and ``validation`` is measured after them.

    Rows with a null vector are left out; no rows at all is an error. Without ``validation``, training rows stand in. Stops once ``patience`` epochs,
    counted from ``warmup`` on, brought nothing better by more than ``min_delta``; the best epoch's network is returned.
    """
    number = F.xxhash64(F.col(key).cast("string"))
    ready = lambda t: write_table(t.select(number.alias("k"), *[F.col(c).cast("array<double>").alias(c) for c in "xy"]).dropna(subset=["x", "y"]), "training")
    rows = ready(rows)
    held = rows if validation is None else ready(validation)
    step = _optimiser(how.optimiser, len(net.weights), how.momentum, how.decay)
    best, history = (math.inf, -1, net), []
    for epoch in range(how.epochs):
        rate, losses = how.rate * how.schedule(epoch), []
        for b in range(how.batches):
            batch = rows if how.batches == 1 else rows.filter(F.pmod(F.xxhash64("k", F.lit(how.seed), F.lit(epoch)), F.lit(how.batches)) == b)
            g, loss, n = summed(batch, net, True)
            if not n:
                continue
            g = g / n
            if how.clip is not None:
                g = g * min(1.0, how.clip / (float(np.linalg.norm(g)) + 1e-6))
            net = replace(net, weights=step(net.weights, g, rate))
            losses.append(loss / n)
        _, loss, n = summed(held, net, False)
        if not losses or not n:
            raise ValueError("there are no rows to train on or to validate with")
        history.append((epoch, rate, sum(losses) / len(losses), loss / n))
        if best[1] < 0 or loss / n < best[0] - how.min_delta:
            best = (loss / n, epoch, net)
        if how.patience is not None and epoch - max(best[1], how.warmup - 1) >= how.patience:
            break
    return Trained(best[2], best[1], tuple(history))


def metrics(rows: DataFrame, net: Network) -> DataFrame:
    """(n, mse, relative_error) of the network's output for x against y, over all rows with both."""
    both = apply(rows.select(*[F.col(c).cast("array<double>").alias(c) for c in "xy"]).dropna(), "x", net, "_out")
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e)
    error, size = square(F.zip_with("_out", "y", lambda a, b: a - b)), square(F.col("y"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg(error / F.size("y")).alias("mse"), (F.sqrt(F.sum(error)) / F.greatest(F.sqrt(F.sum(size)), F.lit(1e-12))).alias("relative_error"))


def learn_representation(rows: DataFrame, key: str, vec: str, net: Network, how: Training = Training(), share: float = 0.2) -> tuple[Trained, DataFrame]:  # noqa: B008
    """An autoencoder of ``vec``: rows are split by a hash of ``key``, ``share`` of them validate; the metrics of its best epoch on those."""
    split = write_table(train_validation_split(rows.select(F.col(key).alias("key"), F.col(vec).alias("x"), F.col(vec).alias("y")), "key", share), "split")
    held = split.filter("split = 'validation'")
    found = train(split.filter("split = 'train'"), net, how, held)
    return found, metrics(held, found.net)


def learn_dynamics(rows: DataFrame, series: str, order: list[str], state: str, net: Network, how: Training = Training(), validation: DataFrame | None = None) -> tuple[Trained, DataFrame]:  # noqa: B008
    """A network from each state to the next of its series; without validation series, the training ones stand in."""

    def pairs(of: DataFrame) -> DataFrame:
        ahead = with_later(of.select(series, *order, state), series, order, state).filter("target_exists")
        return write_table(ahead.select(F.concat_ws("/", series, *order).alias("key"), F.col(state).alias("x"), F.col("target").alias("y")), "pairs")

    own = pairs(rows)
    held = own if validation is None else pairs(validation)
    found = train(own, net, how, held)
    return found, metrics(held, found.net)
