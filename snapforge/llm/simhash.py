"""SimHash near-duplicates, found by the generalised pigeonhole principle.

Fingerprints at ``tau`` or fewer differing bits are linked. The bits are grouped, correlated ones together, into
``m`` partitions with thresholds ``t_1 .. t_m`` whose sum is ``tau - m + 1``: two fingerprints that differ by
more than ``t_i`` bits in every partition differ in more than ``tau`` bits, so each link shows up in some
partition at ``t_i`` or fewer bits (``t_i`` = -1: that partition isn't probed). Dynamic programming picks the
partitions' thresholds with the fewest rows, on candidate counts taken over all fingerprints. Every fingerprint
is put into its partitions' buckets, probes the buckets around it, and the pairs met there are verified.

A bucket with more than ``BUCKET`` fingerprints makes no pairs. Whatever touches such a bucket is linked by shared
midpoints instead: two values differ in at most two bits just if one value lies within one bit of both, and at
most 65 fingerprints lie around a value. So rows grow in proportion to the input, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapforge.llm.common import join_hot, text_of, write_table
from snapforge.llm.components import connected_components

BITS = 64
#: Fingerprints in a bucket up to which pairs are made; around it, a midpoint join costs as many rows.
BUCKET = 64
#: Shingle hashes whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: str, shingle: int = 3) -> int:
    """SimHash of one text over its word shingles, repeats included; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    size = min(shingle, len(words))
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    stops = ends[size - 1 :].tolist()
    digest, count = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), CHUNK):
        pairs = zip(starts[at : at + CHUNK], stops[at : at + CHUNK], strict=True)
        hashes = np.array([digest(joined[a:b], 42) for a, b in pairs], "<u8")
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(starts), bitorder="little").view("<u8")[0])


def with_fingerprints(df: DataFrame, text: str = "text", shingle: int = 3, name: str = "fp") -> DataFrame:
    """Add the signed 64-bit fingerprint of the whole text; a null text counts as empty."""

    @F.arrow_udf("bigint")
    def simhash(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
        return pa.array(found.view(np.int64))

    return df.withColumn(name, simhash(text_of(text)))


def bit_counts(values: DataFrame) -> tuple[int, np.ndarray]:
    """How many values there are, and for each pair of bits in how many both are set (the diagonal: a bit's own count).

    Each task sums its own 64 x 64 table, and Spark adds the tables up: 4,096 numbers reach the driver.
    """

    def partial(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            for at in range(0, len(fp), CHUNK):
                x = np.unpackbits(fp[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
                total += x.T @ x
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(total.ravel(), n))], ["cell", "n"])

    cells = values.select("fp").mapInArrow(partial, "cell bigint, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    table = np.zeros(BITS * BITS + 1)
    for row in cells:
        table[row["cell"]] = row["n"]
    return int(table[-1]), table[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Split the 64 bits into ``parts`` groups of like width, strongly correlated bits in one group.

    Bits that repeat each other add little to a bucket's selectivity, so they are better kept together than
    spread, which would weaken every partition.
    """
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for i in range(parts):
        width = len(left) // (parts - i)
        group = [max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())]
        left.remove(group[0])
        while len(group) < width:
            group.append(max(sorted(left), key=lambda b: corr[b, group].sum()))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def _mask(bits: Sequence[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def allocate(costs: Sequence[Sequence[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up, one for each partition, whose sum is ``budget``, with the least total cost.

    ``costs[i][t + 1]`` is partition i's cost at threshold t.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        reached: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t, more in enumerate(options, -1):
                if total + t not in reached or cost + more < reached[total + t][0]:
                    reached[total + t] = (cost + more, [*chosen, t])
        best = reached
    return best[budget]


def plan(values: DataFrame, tau: int, layouts: Sequence[int] = (2, 3)) -> list[tuple[int, list[int]]]:
    """(threshold, bits) of each partition to probe, for the cheapest layout.

    Pairs that agree on a whole partition are counted exactly, over all fingerprints; pairs at one or two more
    bits follow from the bits' own frequencies. At ``tau`` 0 all bits are one partition.
    """
    n, both = bit_counts(values)
    if n < 2:
        return []
    layouts = [m for m in layouts if m <= tau + 1] or [1]
    parts = [(m, bits) for m in layouts for bits in group_bits(n, both, m)]
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(bits))).alias("key")) for i, (_, bits) in enumerate(parts)]))
    sizes = values.select(keys.alias("k")).groupBy("k.part", "k.key").agg(F.count(F.lit(1)).alias("n"))
    pairs = dict(sizes.groupBy("part").agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("pairs")).collect())
    p = np.diag(both) / n
    found = []
    for m in layouts:
        costs, groups = [], []
        for i, (layout, bits) in enumerate(parts):
            if layout != m:
                continue
            odds = 2 * p[bits] * (1 - p[bits]) / (p[bits] ** 2 + (1 - p[bits]) ** 2)
            near, probes = pairs.get(i, 0.0), 1.0
            options = [0.0, n + near]
            levels = np.poly(-odds)  # elementary symmetric sums: pairs at exactly 1, 2, ... bits, as multiples of those at 0
            for t in range(1, tau + 1):
                near += pairs.get(i, 0.0) * levels[t] if t < len(levels) else 0.0
                probes = sum(_choose(len(bits), k) for k in range(t + 1))
                options.append(n * (1 + probes) + near)
            costs.append(options)
            groups.append(bits)
        cost, chosen = allocate(costs, tau - m + 1)
        found.append((cost, [(t, bits) for t, bits in zip(chosen, groups, strict=True) if t >= 0]))
    return min(found, key=lambda x: x[0])[1]


def _choose(n: int, k: int) -> int:
    return int(np.prod([(n - i) / (i + 1) for i in range(k)])) if k else 1


def links(values: DataFrame, tau: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(a, b) with a < b: enough pairs of ``values`` at ``tau`` or fewer bits to connect all that are linked.

    ``values`` holds distinct fingerprints ``fp``. Each pair returned is verified; a pair may be left out only where
    others connect its ends. ``tau`` may be 0, 1 or 2 (the midpoint argument for full buckets needs that).
    """
    if not 0 <= tau <= 2:
        raise ValueError("tau must be 0, 1 or 2")
    chosen = plan(values, tau)
    if not chosen:
        return values.sparkSession.createDataFrame([], "a bigint, b bigint")
    homes, visits = [], []
    for i, (t, bits) in enumerate(chosen):
        key = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        flips = [_mask(c) for k in range(t + 1) for c in combinations(bits, k)]
        homes.append(F.struct(F.lit(i).alias("part"), key.alias("key")))
        visits += [F.struct(F.lit(i).alias("part"), key.bitwiseXOR(F.lit(f)).alias("key")) for f in flips]
    home = values.select("fp", F.explode(F.array(*homes)).alias("k")).select("fp", "k.part", "k.key")
    visit = values.select("fp", F.explode(F.array(*visits)).alias("k")).select(F.col("fp").alias("probe"), "k.part", "k.key")
    sizes = home.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"))
    full = sizes.filter(F.col("n") > bucket).select("part", "key")
    members = home.join(sizes.filter((F.col("n") <= bucket)), ["part", "key"], "left_semi")
    apart = F.bit_count(F.col("probe").bitwiseXOR(F.col("fp")))
    met = members.join(visit, ["part", "key"]).filter((F.col("probe") != F.col("fp")) & (apart <= tau))
    direct = met.select(F.least("probe", "fp").alias("a"), F.greatest("probe", "fp").alias("b"))
    touching = visit.join(full, ["part", "key"], "left_semi").select(F.col("probe").alias("fp")).distinct()
    return direct.unionByName(midpoint_links(touching, tau)).distinct()


def midpoint_links(values: DataFrame, tau: int) -> DataFrame:
    """Links among ``values`` without making pairs: each value meets those that share a midpoint with it.

    With tau 2, a value's midpoints are itself and its 64 neighbours; with 1, a neighbour's link passes over a
    masked bit; with 0, distinct values have none.
    """
    if tau == 2:
        around = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(_mask([b]))) for b in range(BITS)]
    elif tau == 1:
        around = [F.struct(F.lit(b).alias("bit"), F.col("fp").bitwiseAND(F.lit(~_mask([b]))).alias("rest")) for b in range(BITS)]
    else:
        around = [F.col("fp")]
    met = values.select("fp", F.explode(F.array(*around)).alias("mid"))
    stars = met.groupBy("mid").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    return stars.select("a", F.explode("all").alias("b")).filter(F.col("a") != F.col("b"))


def near_duplicates(docs: DataFrame, shingle: int = 3, tau: int = 2, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp (signed) and component_id of every row.

    component_id is the smallest doc_id that a row reaches over links, its own included. Texts without words,
    null ones too, share fingerprint 0 and are linked like others. Rows with equal fingerprints are merged before
    anything is shuffled by fingerprint, so a group of copies costs one row per task. Repeated rows are returned
    as often as they come; a null doc_id takes part but is never the smallest unless there is no other. Other
    columns are ignored; an empty table gives an empty result.
    """
    prints = write_table(with_fingerprints(docs.select("doc_id", "text"), "text", shingle).select("doc_id", "fp"), "simhash")
    values = write_table(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "simhash-values")
    edges = write_table(links(values.select("fp"), tau, bucket), "simhash-links")
    label = connected_components(edges)
    linked = values.join(label, values["fp"] == label["node"]).select("fp", "first", "component")
    smallest = linked.groupBy("component").agg(F.min("first").alias("component_first"))
    reached = linked.select("fp", "component").join(smallest, "component").select(F.col("fp").alias("linked_fp"), "component_first")
    classes = values.join(reached, F.col("fp") == F.col("linked_fp"), "left").select("fp", "n", F.coalesce("component_first", "first").alias("component_id"))
    return join_hot(prints, write_table(classes, "simhash-classes"), "fp", "n").select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
