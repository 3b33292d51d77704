"""Rendezvous hashing of stable record keys over weighted shards (native: SQL functions only).

Every (key, shard) pair has a pseudo-random ``u`` in (0, 1); a record goes to the shard with the least
``-ln(u) / weight``. A shard's share is proportional to its weight, and a further shard takes records only
into itself, since the other pairs' values don't change.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapforge.llm.common import free_name, text_of

#: Each shard's rows are numbered in this many independent runs, so no task sorts a whole shard.
SLOT_RUNS = 1024


def _draw(key: Column, shard: int) -> Column:
    """-ln(u) for 52 bits of MD5, which other engines have too."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f"/{shard}"))), 1, 13)
    return -F.log((F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52)))


def least_cost(key: Column, weights: Mapping[int, float]) -> Column:
    """struct(cost, shard) of the winning shard; the lower shard wins a tie."""
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("at least one shard is needed, and weights must be positive")
    costs = [F.struct((_draw(key, s) / F.lit(float(w))).alias("cost"), F.lit(s).alias("shard")) for s, w in sorted(weights.items())]
    return F.array_min(F.array(*costs)) if len(costs) > 1 else costs[0]


def assign_shards(df: DataFrame, key: str, weights: Mapping[int, float], grown: Mapping[int, float] | None = None) -> DataFrame:
    """Add ``shard`` and, where further shards ``grown`` are given, ``grown_shard``.

    A null key is hashed as the empty string, so it has a place too; columns named ``shard`` or
    ``grown_shard`` are replaced.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    now = free_name(df, "_now")
    df = df.withColumn(now, least_cost(name, weights))
    out = df.withColumn("shard", F.col(f"{now}.shard"))
    if grown is not None:
        later = least_cost(name, grown)
        out = out.withColumn("grown_shard", F.array_min(F.array(F.col(now), later)).getField("shard"))
    return out.drop(now)


def number_slots(df: DataFrame, key: str, order: list[str], runs: int = SLOT_RUNS) -> DataFrame:
    """Add ``slot``: 0, 1, 2, ... without gaps within each ``shard``.

    A shard's rows are dealt by a hash of the key into ``runs`` runs. Each run is numbered by itself, and the
    rows of earlier runs are added from a table of counts that has at most shards x runs rows: that bound
    holds at every input size, so the table is broadcast. Counting reads only the key. Rows with one key lie in
    one run; equal rows get different slots. Texts are not read, however long.
    """
    run, first, n = (free_name(df, x) for x in ("_run", "_first", "_n"))
    digits = F.substring(F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("/run"))), 1, 8)
    df = df.withColumn(run, (F.conv(digits, 16, 10).cast("long") % runs).cast("int"))
    counts = df.groupBy("shard", run).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy("shard").orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", run, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    numbered = df.withColumn("slot", F.row_number().over(Window.partitionBy("shard", run).orderBy(*order)).cast("long"))
    return numbered.join(F.broadcast(firsts), ["shard", run]).withColumn("slot", F.col("slot") + F.col(first) - 1).drop(run, first)


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, with equal weights.

    A null text has size 1 and the checksum of the empty string. A null doc_id is a key like any other.
    Repeated rows go to one shard with slots of their own. An empty table gives an empty result; other
    columns are ignored.
    """
    rows = docs.select("doc_id", (F.octet_length(text_of("text")) + 1).cast("long").alias("size"), F.crc32(text_of("text")).alias("text_crc32"))
    rows = assign_shards(rows, "doc_id", {s: 1.0 for s in range(shards)}, {shards: 1.0})
    rows = number_slots(rows, "doc_id", ["doc_id", "size", "text_crc32"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The checksum's table comes from its rule (eight halvings with the polynomial), the checksum itself from a fold over the bytes.
ORACLE_SQL = """
WITH RECURSIVE bits(n, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL
  SELECT n, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS steps FROM bits WHERE k = 8),
rows AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS name, strlen(coalesce(text, '')) + 1 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
sums AS (
  SELECT doc_id, name, size, xor(4294967295, list_reduce(bytes, lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1]), 4294967295)) AS text_crc32
  FROM rows, crc),
costs AS (
  SELECT name, s, -ln((('0x' || substr(md5(name || '/' || s), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) AS cost
  FROM (SELECT DISTINCT name FROM rows), range(17) r(s)),
picks AS (
  SELECT name, arg_min(s, (cost, s)) FILTER (s < 16) AS shard, arg_min(s, (cost, s)) AS grown FROM costs GROUP BY name)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(name || '/run'), 1, 8))::BIGINT % 1024,
                          doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown::INT AS grown_shard
FROM sums JOIN picks USING (name)
"""
