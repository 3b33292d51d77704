"""Networks: gradients against differences, training against least squares, pipelines."""

from dataclasses import replace

import numpy as np
import pytest

from snapforge.functions import network as nn


def table(spark, x, y):
    return spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [(-1, None, y[0].tolist())], "key bigint, x array<double>, y array<double>")


def test_gradients(spark):
    r = np.random.default_rng(0)
    net, x, y = nn.network([4, 6, 3, 5], seed=2, linear=[2]), r.normal(size=(30, 4)), r.normal(size=(30, 5))
    g, loss = net.gradient(x, y)
    loss_at = lambda w: float(((replace(net, weights=w).values(x)[-1] - y) ** 2).mean(axis=1).sum())
    slope = [(loss_at(net.weights + 1e-6 * e) - loss_at(net.weights - 1e-6 * e)) / 2e-6 for e in np.eye(len(net.weights))]
    assert loss == pytest.approx(loss_at(net.weights)) and np.allclose(g, slope, atol=1e-4)
    total, sum_, n = nn.summed(table(spark, x, y).dropna().repartition(7), net, True)
    assert n == 30 and sum_ == pytest.approx(loss) and np.allclose(total, g)
    assert nn.summed(table(spark, x, y).limit(0), net, True)[2] == 0


@pytest.mark.parametrize("kind,rate,epochs", [("sgd", 0.1, 25), ("adam", 0.15, 25)])
def test_a_layer_becomes_least_squares(spark, kind, rate, epochs):
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 3))
    y = x @ r.normal(size=(3, 2)) + 0.5
    found = nn.train(table(spark, x, y), nn.network([3, 2]), nn.Training(epochs, rate, kind))
    assert found.history[-1][3] < 0.1 * found.history[0][3] and found.history[found.best][3] == min(h[3] for h in found.history)
    m = nn.metrics(table(spark, x, y), found.net).first()
    assert m["n"] == 200 and m["mse"] == pytest.approx(found.history[found.best][3])


@pytest.mark.parametrize("kind", ["adamw", "rmsprop", "adagrad"])
def test_steps_by_hand(kind):
    w, g = np.array([1.0, -2.0]), np.array([0.5, 4.0])
    found = nn._optimiser(kind, 2, 0.9, 0.1)(w, g, 0.01)
    pulled = g + 0.1 * w
    wanted = {"adamw": w * 0.999 - 0.01 * np.sign(g), "rmsprop": w - 0.01 * np.sign(pulled) / 0.1, "adagrad": w - 0.01 * np.sign(pulled)}[kind]
    assert np.allclose(found, wanted, atol=1e-6)


def test_representation_of_a_plane(spark):
    """States on a plane are told by two numbers; batches, clipping, schedule and an early stop on the way."""
    r = np.random.default_rng(3)
    x = r.normal(size=(150, 2)) @ r.normal(size=(2, 6))
    rows = table(spark, x, x)
    how = nn.Training(12, 0.05, batches=2, clip=5.0, schedule=nn.stepped([8], 0.5))
    found, scores = nn.learn_representation(rows, "key", "x", nn.autoencoder(6, 2), how)
    assert [h[1] for h in found.history] == [0.05] * 8 + [0.025] * 4
    assert scores.first()["n"] == 30 and scores.first()["mse"] < 0.3 * (x * x).mean()
    codes = nn.apply(rows, "x", found.net, "code", last=1)
    back = nn.apply(codes, "code", found.net, "again", first=1).orderBy("key").collect()
    assert back[0]["again"] is None and len(back[1]["code"]) == 2
    assert np.allclose([b["again"] for b in back[1:]], found.net.values(x)[-1])
    stopped = nn.train(rows, nn.autoencoder(6, 2), nn.Training(20, 0.0, patience=3))
    assert len(stopped.history) == 4 and stopped.best == 0


def test_dynamics(spark):
    k = np.array([[0.9, -0.2], [0.1, 0.8]])
    rows = []
    for s in ("a", "b", None):
        state = np.random.default_rng(len(rows)).normal(size=2)
        for t in range(40):
            rows.append((s, t, state.tolist()))
            state = k @ state
    found, scores = nn.learn_dynamics(spark.createDataFrame(rows, "s string, t int, v array<double>"), "s", ["t"], "v", nn.network([2, 2]), nn.Training(20, 0.2))
    assert scores.first()["n"] == 117 and found.history[-1][3] < 0.2 * found.history[0][3]


def test_refusals(spark):
    x = np.ones((3, 2))
    for bad in (lambda: nn.network([3]), lambda: nn.network([3000, 3000]), lambda: nn.train(table(spark, x, x).limit(0), nn.network([2, 2]), nn.Training(1)), lambda: nn.train(table(spark, x, x), nn.network([2, 2]), nn.Training(1, optimiser="none"))):
        with pytest.raises(ValueError):
            bad()
    assert nn.cosine(10)(0) == 1 and nn.cosine(10)(10) == pytest.approx(0)


def test_representation_query_against_one_table(spark):
    """The same passes over NumPy arrays: batches by Spark's hashes, gradients of whole batches."""
    from pyspark.sql import functions as F

    from snapforge.jobs import networks
    from snapforge.operators.sampling import train_validation_split

    sf = "/root/testdata/sf0.001"
    split = train_validation_split(spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("key"), "embedding"), "key")
    deal = [F.pmod(F.xxhash64(F.xxhash64(F.col("key").cast("string")), F.lit(0), F.lit(e)), F.lit(2)).alias(f"b{e}") for e in range(networks.EPOCHS)]
    rows = split.select("*", *deal).collect()
    x = np.array([r["embedding"] for r in rows], float)
    own = np.array([r["split"] == "train" for r in rows])
    net, how = nn.autoencoder(64, 8, [24], seed=4), nn.cosine(networks.EPOCHS)
    step = nn._optimiser("adam", len(net.weights), 0.9, 0.0)
    for h in networks.representation_history(spark, sf).orderBy("epoch").collect():
        losses = []
        for b in range(2):
            batch = x[own & np.array([r[f"b{h['epoch']}"] == b for r in rows])]
            g, loss = net.gradient(batch, batch)
            net = replace(net, weights=step(net.weights, g / len(batch), 0.01 * how(h["epoch"])))
            losses.append(loss / len(batch))
        held = x[~own]
        assert h["train"] == pytest.approx(np.mean(losses), rel=1e-6)
        assert h["validation"] == pytest.approx(((net.values(held)[-1] - held) ** 2).mean(), rel=1e-6)
