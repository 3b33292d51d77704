"""Queries on networks that are trained on the tables."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from snapforge.functions import network
from snapforge.jobs.registry import query
from snapforge.sources.folders import table

EPOCHS = 6


@query("""WITH v AS (SELECT unnest(range(len(embedding))) AS j, unnest(embedding)::DOUBLE AS v, label FROM embeddings),
w AS (SELECT j, 0.25 * 2 * avg(v * label) AS w FROM v GROUP BY j UNION ALL SELECT 64, 0.5 * avg(label) FROM embeddings),
p AS (SELECT vec_id, label, sum(u.v * w.w) + (SELECT w FROM w WHERE j = 64) AS p FROM (SELECT vec_id, label, unnest(range(len(embedding))) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings) u JOIN w USING (j) GROUP BY vec_id, label),
e AS (SELECT avg((p - label) ** 2) AS after FROM p), b AS (SELECT avg(label ** 2) AS before FROM embeddings)
SELECT j::INT AS j, round(w, 6) + 0.0 AS w, round(before, 4) AS before, round(after, 4) AS after FROM w, b, e""")
def network_first_step(spark, d):
    """One step down the slope of a single layer from embeddings to labels that starts at zero; the bias is row 64, losses are before and after."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("x"), F.array(F.col("label").cast("double")).alias("y"))
    start = network.network([64, 1])
    found = network.train(rows, replace(start, weights=np.zeros(65)), network.Training(1, 0.25, "sgd"))
    _, _, before, after = found.history[0]
    made = spark.createDataFrame([(j, float(w), before, after) for j, w in enumerate(found.net.weights)], "j int, w double, before double, after double")
    return made.select("j", *[(F.round(c, n) + 0.0).alias(c) for c, n in (("w", 6), ("before", 4), ("after", 4))])


@query()
def representation_history(spark, d):
    """Losses of an autoencoder from 64 to 8 numbers on all embeddings, a fifth of them held out, in two batches a pass."""
    rows = table(spark, d, "embeddings")
    found, _ = network.learn_representation(rows, "vec_id", "embedding", network.autoencoder(64, 8, [24], seed=4), network.Training(EPOCHS, 0.01, batches=2, schedule=network.cosine(EPOCHS)))
    return spark.createDataFrame([(*h, h[0] == found.best) for h in found.history], "epoch int, rate double, train double, validation double, best boolean")
