"""Exact deduplication as a stateful stream over a content store.

The stream reads a Parquet content store. Its state, in RocksDB on disk and without a watermark, never expires: for
each digest of a normalised text it keeps the best row so far (most code points, then the smallest doc_id) as a
stable identifier with a content locator (file and row in the store), and the number of rows. Spark adds the rows up
within each task before it shuffles them to the state, so a text with a third of all rows is one record per
task. A later run over the same checkpoint goes on with new files only.

Wherever a digest was hit more than once, the full bytes are compared, with a minimum and a maximum of the normalised
texts that again are taken within each task first. Digests whose bytes differ are resolved by the bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from snapforge.llm.common import BROADCAST_ROWS, free_name, join_hot, maybe_broadcast, new_folder, text_of, write_table

#: Settings of the stream: state in RocksDB, which must not reserve disk ahead for each of its many small stores.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Bytes of new files in a micro-batch.
MAX_BYTES = 1 << 40
SPACE = " \t\n\x0b\f\r"


def normalised(text: str = "text") -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(text_of(text), SPACE, "")


def sha256_digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def content_rows(store: DataFrame, digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """doc_id, digest, the order of preference ``best`` (with the locator) of each row of a Parquet-backed frame."""
    locator = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    best = F.struct((-F.char_length(text_of("text"))).alias("shorter"), F.col("doc_id"), locator.alias("locator"))
    return store.select("doc_id", digest(normalised()).alias("digest"), best.alias("best"))


def run_stream(spark: SparkSession, path: str, schema: StructType, checkpoint: str, updates: str,
               digest: Callable[[Column], Column] = sha256_digest, max_bytes: int = MAX_BYTES) -> None:
    """Bring the keyed state up to date with all files under ``path`` and write the keys that changed to ``updates``.

    Each micro-batch takes up to ``max_bytes`` of new files. A batch that is repeated after a failure replaces its
    own folder, so updates are written exactly once.
    """
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    stored = spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes).option("maxFileAge", "36500d").parquet(path)
    state = content_rows(stored, digest).groupBy("digest").agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("n"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")

    query = state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def winners(spark: SparkSession, updates: str, kind: str = "bigint") -> DataFrame:
    """digest, best, n as of the last batch: the best row only improves and the count only grows. ``kind`` is doc_id's type."""
    schema = f"digest binary, best struct<shorter:int, doc_id:{kind}, locator:struct<file:string, row:bigint>>, n bigint, batch bigint"
    found = spark.read.schema(schema).option("basePath", updates).parquet(updates)
    return found.groupBy("digest").agg(F.min("best").alias("best"), F.max("n").alias("n"))


def collisions(store: DataFrame, hits: DataFrame, n_hits: int, digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """digest of each hit group whose texts aren't the same in all bytes."""
    texts = store.select(digest(normalised()).alias("digest"), normalised().alias("norm"))
    texts = texts.join(maybe_broadcast(hits.select("digest"), n_hits), "digest", "left_semi")
    return texts.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).filter(F.col("low") != F.col("high")).select("digest")


def deduplicate(spark: SparkSession, path: str, schema: StructType, digest: Callable[[Column], Column] = sha256_digest,
                checkpoint: str | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, locator, digest, keep_id, group_size and kept of every row under ``path``.

    Texts are equal when the same after white space is deleted; null counts as empty, so null, empty and blank
    texts are one group. The row with the most code points stays, then the smallest doc_id (null first), then the
    first in the store, so of repeated rows exactly one is kept. doc_id may have any type that has an order. Empty tables
    give an empty result; other columns are ignored.
    """
    folder = checkpoint or new_folder(spark, "dedup")
    updates = f"{folder}/updates"
    store, kind = spark.read.schema(schema).parquet(path), schema["doc_id"].dataType.simpleString()
    if store.isEmpty():
        return spark.createDataFrame([], f"doc_id {kind}, locator struct<file:string, row:bigint>, digest binary, keep_id {kind}, group_size bigint, kept boolean")
    run_stream(spark, path, schema, f"{folder}/state", updates, digest, max_bytes)
    best = write_table(winners(spark, updates, kind), "winners")
    hits = best.filter(F.col("n") > 1)
    n_hits = hits.count()
    groups = best.select("digest", F.col("best").alias("keep"), F.col("n").alias("group_size"))
    rows = write_table(content_rows(store, digest), "digests")
    mixed = collisions(store, hits, n_hits, digest) if n_hits else None
    n_mixed = mixed.count() if n_hits else 0
    found = join_hot(rows, groups, "digest", "group_size")
    if n_mixed:
        mixed = maybe_broadcast(mixed, n_mixed)
        texts = rows.join(mixed, "digest", "left_semi").select("best.locator").join(
            store.select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("locator"), normalised().alias("norm")), "locator")
        again = rows.join(mixed, "digest", "left_semi").join(texts, F.col("best.locator") == texts["locator"]).select("doc_id", "digest", "best", "norm")
        by_bytes = again.groupBy("norm").agg(F.min("best").alias("keep"), F.count(F.lit(1)).alias("group_size"))
        found = found.join(mixed, "digest", "left_anti").unionByName(again.join(by_bytes, "norm").drop("norm"))
    return found.select("doc_id", F.col("best.locator").alias("locator"), "digest", F.col("keep.doc_id").alias("keep_id"), "group_size",
                        (F.col("best.locator") == F.col("keep.locator")).alias("kept"))


def keep_first(docs: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    ``docs`` is written to the shared folder as the content store first. While the rows to drop number at most
    ``limit``, they are broadcast as locators; beyond that the rows that stay are joined by locator.
    """
    spark = docs.sparkSession
    path = new_folder(spark, "content")
    docs.write.parquet(path)
    store = spark.read.schema(docs.schema).parquet(path)
    judged = deduplicate(spark, path, docs.schema)
    where, file, row = free_name(docs, "_where"), F.col("_metadata.file_path"), F.col("_metadata.row_index")
    rows = store.withColumn(where, F.struct(file.alias("file"), row.alias("row")))
    losers = judged.filter(~F.col("kept")).select(F.col("locator").alias(where))
    losers = maybe_broadcast(losers, losers.count(), limit)
    return rows.join(losers, where, "left_anti").select(*docs.columns)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/documents.parquet"
    found = deduplicate(spark, f"{sf_dir}/documents.parque[t]", spark.read.parquet(path).schema)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER same AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER same = 1 AS kept, text_sha256
FROM rows WINDOW same AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS FIRST)
"""
