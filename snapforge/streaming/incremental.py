"""Incremental decomposition of arriving snapshots: as a Gram matrix, which is additive, or as factors that each batch is folded into."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from snapforge.functions.matrix import gram
from snapforge.operators import svd
from snapforge.sources.folders import shared_folder


def stream_gram(spark: SparkSession, path: str, schema: StructType, vec: str, checkpoint: str | None = None, files_per_batch: int = 64) -> DataFrame:
    """(i, j, v) over all files under ``path`` so far; a later call with the same ``checkpoint`` adds new files only.

    Each micro-batch is reduced to one table per task and written under its number, so a repeated batch replaces
    itself; sums are independent of the order of files.
    """
    folder = checkpoint or f"{shared_folder(spark)}/gram-{uuid.uuid4().hex}"
    stored = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", "36500d").parquet(path)

    def add(batch: DataFrame, number: int) -> None:
        gram(batch, vec).coalesce(1).write.mode("overwrite").parquet(f"{folder}/parts/batch={number}")

    query = stored.select(vec).writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    parts = spark.read.schema("i bigint, j bigint, v double, batch bigint").option("basePath", f"{folder}/parts").parquet(f"{folder}/parts")
    return parts.groupBy("i", "j").agg(F.sum("v").alias("v"))


def stream_svd(spark: SparkSession, path: str, schema: StructType, vec: str, rank: int | None = None, variant: str = "standard",
               checkpoint: str | None = None, files_per_batch: int = 64) -> svd.Decomposition:
    """Sigma and V of all files under ``path`` so far; a later call with the same ``checkpoint`` folds in new files only.

    Spark reduces each micro-batch to a triangle, which is folded into the factors of the batch before (``svd.fold``).
    The factors, as large as one row squared at most, are written under the batch's number with each batch, so a
    repeated batch starts from the same factors and replaces its own.
    """
    folder = checkpoint or f"{shared_folder(spark)}/svd-{uuid.uuid4().hex}"
    stored = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", "36500d").parquet(path)

    def factors(number: int | None) -> svd.Decomposition | None:
        """Of the last batch before ``number`` (of all)."""
        try:
            kept = spark.read.schema("factors string, batch bigint").option("basePath", f"{folder}/factors").parquet(f"{folder}/factors")
            kept = kept if number is None else kept.filter(F.col("batch") < number)
            last = kept.orderBy(F.desc("batch")).first()
        except AnalysisException:  # no batch yet
            last = None
        if last is None:
            return None
        plain = json.loads(last["factors"])
        return svd.Decomposition(np.array(plain["sigma"]), np.array(plain["basis"]).reshape(-1, len(plain["sigma"])))

    def add(batch: DataFrame, number: int) -> None:
        found = svd.fold(factors(number), svd.triangle(batch, vec), rank, variant)
        plain = json.dumps({"sigma": found.sigma.tolist(), "basis": found.basis.tolist()})
        spark.createDataFrame([(plain,)], "factors string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/factors/batch={number}")

    stored.select(vec).writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return factors(None) or svd.Decomposition(np.zeros(0), np.zeros((0, 0)))
