"""Near copies by SimHash: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

One SimHash of a whole text is too coarse for that: at a similarity of 0.8, 10 of 64 bits differ, and a radius of 10 bits
can't be probed in time proportional to the input. So the fingerprint is longer: ``BLOCKS`` SimHashes of 64 bits, each over
a sample of the text's shingles, chosen by their hashes alike in all texts. Bits of one block are correlated (they change
together, when the sample changes), bits of different blocks aren't, so the blocks are the partitions of the generalised
pigeonhole principle (see ``simhash``), and dynamic programming allocates their thresholds on counted candidates.
Fingerprints at fewer than ``BLOCKS`` differing bits agree in some block; and a pair at 0.8, though hundreds of bits apart,
agrees in one of the blocks too, with a probability over 0.99 (measured in the tests), as a sample is small and
often the same in both texts. Every candidate is verified on the two whole sets of shingle hashes.

The sampling rate is a power of two by the text's number of shingles, so that a block has ``SAMPLE`` to 2 ``SAMPLE``
shingles; a text whose near copies may have the next rate has blocks at both rates.

A bucket with more than ``BUCKET`` texts first makes pairs with its centre only, the text that most full buckets hold. What that
leaves apart from the centre's component is compared with all texts of the bucket by bitmaps of their shingles, which bound the
similarity from above, and the pairs that still may be similar enough are verified. So no link between components is lost, and
only pairs that pass the bound make rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapforge.llm.common import BROADCAST_ROWS, free_name, join_hot, maybe_broadcast, text_of, write_table
from snapforge.llm.components import connected_components
from snapforge.llm.simhash import BITS, allocate

SHINGLE, SIMILARITY = 5, 0.8
#: SimHashes of a text, and the shingles that each is taken over, at least on average.
BLOCKS, SAMPLE = 16, 4
#: Texts in a bucket up to which all pairs are made.
BUCKET = 32
#: Longs of a text's bitmap of shingles, a power of two; it prunes texts of up to some hundred shingles, and never loses a pair.
BITMAP = 32
_DRAWN = np.random.default_rng(7).integers(1, 1 << 63, (BLOCKS + 64, BLOCKS), dtype=np.uint64)
#: Multipliers that deal shingles into classes, and what tells keys of different rates and blocks apart.
_DEALS, _MARKS = _DRAWN[0] * np.uint64(2) + np.uint64(1), _DRAWN[1:65] * np.uint64(2)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text is one shingle, one without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    size = min(size, len(words))
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def block_keys(hashes: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The block and the key (the block's SimHash, told apart by rate and block) of each block that has shingles.

    At rate 2^-k, a deal of all shingles into 2^k classes gives as many blocks; where that is fewer than ``BLOCKS``, several
    deals do. All texts without shingles have one and the same key.
    """
    n = len(hashes)
    if not n:
        return [0], np.zeros(1, np.int64)
    rate = max(1, (n // SAMPLE).bit_length() - 1)
    rates = [rate, rate + 1] if n >= SIMILARITY * SAMPLE * 2 ** (rate + 1) else [rate]
    blocks, keys = [], []
    for k in rates:
        classes = min(1 << k, BLOCKS)
        for deal in range(BLOCKS // classes):
            dealt = (hashes * _DEALS[deal]) >> np.uint64(64 - k)
            chosen = np.flatnonzero(dealt < classes)
            if len(chosen):
                chosen = chosen[np.argsort(dealt[chosen], kind="stable")]
                found, starts, counts = np.unique(dealt[chosen], return_index=True, return_counts=True)
                bits = np.unpackbits(hashes[chosen].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
                prints = np.packbits(2 * sums > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()
                at = found.astype(np.int64) + deal * classes
                blocks += at.tolist()
                keys.append(prints ^ _MARKS[k, at])
    return blocks, np.concatenate(keys).view(np.int64)


def with_blocks(docs: DataFrame) -> DataFrame:
    """node (a number of its own), doc_id, text_hash, size (distinct shingles) and blocks (block and key) of each row."""

    @F.arrow_udf("struct<size: bigint, blocks: array<struct<block: int, key: bigint>>>")
    def fingerprints(texts: pa.Array) -> pa.Array:
        sizes, offsets, blocks, keys = [], [0], [], []
        for t in texts:
            found = shingles(t.as_py())
            at, own = block_keys(found)
            sizes.append(len(found))
            blocks += at
            keys.append(own)
            offsets.append(len(blocks))
        values = pa.StructArray.from_arrays([pa.array(blocks, pa.int32()), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)]), pa.int64())], ["block", "key"])
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], ["size", "blocks"])

    rows = docs.select("doc_id", text_hash().alias("text_hash"), fingerprints(text_of("text")).alias("b"))
    return rows.select(F.monotonically_increasing_id().alias("node"), "doc_id", "text_hash", "b.size", "b.blocks")


def text_hash() -> Column:
    """Tells the texts of rows with one doc_id apart."""
    return F.xxhash64(text_of("text"))


def thresholds(keys: DataFrame) -> list[int]:
    """The blocks' thresholds: -1 (isn't probed), 0 or 1 (its neighbours at one bit are probed too), with the sum that the principle asks for.

    Costs are rows, and pairs counted over all texts; at threshold 1, pairs are taken to double.
    """
    sizes = keys.groupBy("block", "key").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n").cast("double")
    counted = {r["block"]: r for r in sizes.groupBy("block").agg(F.sum(n).alias("rows"), F.sum(n * (n - 1) / 2).alias("pairs")).collect()}
    costs = [[0.0, c["rows"] + c["pairs"], (BITS + 1) * c["rows"] + 2 * c["pairs"]] if (c := counted.get(i)) else [0.0, 0.0, 0.0] for i in range(BLOCKS)]
    return allocate(costs, 0)[1]


def bucket_rows(prints: DataFrame) -> DataFrame:
    """(node, size, key): the buckets of each text."""
    rows = prints.select("node", "size", F.explode("blocks").alias("b")).select("node", "size", "b.block", "b.key")
    chosen = thresholds(rows)
    home = rows.filter(F.get(F.array(*[F.lit(t) for t in chosen]), F.col("block")) >= 0).select("node", "size", "key")
    wide = [i for i, t in enumerate(chosen) if t > 0]
    if not wide:
        return home
    flips = F.array(*[F.lit(1 << b if b < BITS - 1 else -(1 << b)) for b in range(BITS)])
    around = rows.filter(F.col("block").isin(*wide)).select("node", "size", "key", F.explode(flips).alias("flip"))
    return home.unionByName(around.select("node", "size", F.col("key").bitwiseXOR(F.col("flip")).alias("key")))


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """A bit for each class of shingle hashes that the text has."""
    bits = np.zeros(64 * BITMAP, np.uint8)
    bits[hashes >> np.uint64(64 - (64 * BITMAP).bit_length() + 1)] = 1
    return np.packbits(bits, bitorder="little").view("<i8")


def may_be_similar(bits: str, size: str, other_bits: str, other_size: str, similarity: float = SIMILARITY) -> Column:
    """Whether two bitmaps and sizes allow so much similarity: each class that only one text has is a shingle that isn't shared."""
    only = lambda a, b: sum((F.bit_count(F.get(a, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(b, F.lit(i))))) for i in range(BITMAP)), F.lit(0))
    shared = F.least(F.col(size) - only(bits, other_bits), F.col(other_size) - only(other_bits, bits))
    return shared >= F.lit(similarity) * (F.col(size) + F.col(other_size) - shared)


def shingle_sets(docs: DataFrame, prints: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, set, bits) of the whole texts of ``nodes``, written once: all that comparing and verifying read."""

    @F.arrow_udf("struct<set: array<bigint>, bits: array<bigint>>")
    def hashes(texts: pa.Array) -> pa.Array:
        sets = [shingles(t.as_py()) for t in texts]
        own, bits = ([x.view(np.int64) for x in sets], [bitmap(x) for x in sets])
        return pa.StructArray.from_arrays([pa.array(own, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], ["set", "bits"])

    used = write_table(prints.select("node", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).join(nodes, "node"), "near-used")
    used = maybe_broadcast(used, used.count())  # else texts are shuffled, once
    rows = docs.select("doc_id", text_hash().alias("text_hash"), "text").join(used, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    return write_table(rows.select("node", hashes(text_of("text")).alias("s")).select("node", "s.set", "s.bits"), "near-sets")


def verified(sets: DataFrame, pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose whole shingle sets are similar enough; two texts without words are.

    ``sets`` and ``pairs`` are read more than once, so they should be written tables.
    """
    n_pairs = pairs.count()

    def side(end: str) -> DataFrame:
        ends = maybe_broadcast(pairs.groupBy(end).agg(F.count(F.lit(1)).alias(f"n_{end}")), n_pairs)
        return sets.join(ends, F.col(end) == F.col("node")).select(end, F.col("set").alias(f"set_{end}"), f"n_{end}")

    both = join_hot(join_hot(pairs, side("a"), "a", "n_a"), side("b"), "b", "n_b")
    shared, total = F.size(F.array_intersect("set_a", "set_b")), F.size("set_a") + F.size("set_b")
    return both.filter(shared >= F.lit(similarity) * (total - shared)).select("a", "b").distinct()


def near_copies(docs: DataFrame, prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(node, component) of all texts that have near copies, nodes being those of ``prints`` (written), one for each id and text."""
    rows = bucket_rows(prints)
    shared = write_table(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-shared")
    members = write_table(join_hot(rows, shared, "key", "n").select("key", "node", "size", "n"), "near-members")
    fit = F.least("size", "other_size") >= F.lit(SIMILARITY) * F.greatest("size", "other_size")
    ordered = (F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))

    few, full = members.filter(F.col("n") <= bucket), members.filter(F.col("n") > bucket)
    other = few.select("key", F.col("node").alias("other"), F.col("size").alias("other_size"))
    direct = few.join(other, "key").filter((F.col("node") < F.col("other")) & fit).select(*ordered)
    degrees = full.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    centres = write_table(full.join(degrees, "node").groupBy("key").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("centre")), "near-centres")
    stars = full.join(centres, "key").select("node", F.col("centre").alias("other")).filter("node <> other").select(*ordered)
    tried = write_table(direct.unionByName(stars).distinct(), "near-pairs")
    nodes = tried.select(F.explode(F.array("a", "b")).alias("node")).unionByName(full.select("node")).distinct()
    sets = shingle_sets(docs, prints, nodes)
    links = write_table(verified(sets, tried), "near-links")
    found = connected_components(links)
    if not centres.limit(1).count():
        return found
    label = found.select(F.col("node").alias("_node"), "component")
    now = full.join(label, F.col("node") == F.col("_node"), "left").select("key", "node", "size", F.coalesce("component", "node").alias("component"))
    now = write_table(now.join(sets.select("node", "bits"), "node"), "near-full")
    main = now.join(centres, "key").filter(F.col("node") == F.col("centre")).select("key", F.col("component").alias("main"))
    apart = now.join(main, "key").filter(F.col("component") != F.col("main")).drop("main")
    apart = apart.select("key", *[F.col(c).alias(f"other_{c}") for c in ("size", "component", "bits")], F.col("node").alias("other"))
    near = (F.col("component") != F.col("other_component")) & fit & may_be_similar("bits", "size", "other_bits", "other_size")
    pairs = write_table(now.join(apart, ["key"]).filter(near).select(*ordered).distinct().join(tried, ["a", "b"], "left_anti"), "near-pairs")
    more = write_table(verified(sets, pairs), "near-links")
    return connected_components(links.unionByName(more)) if more.limit(1).count() else found


def keep_one_of_near(docs: DataFrame, limit: int = BROADCAST_ROWS, bucket: int = BUCKET) -> DataFrame:
    """The rows of ``docs`` (with all columns) without near copies, of which the smallest doc_id of each group stays.

    A null text counts as empty; texts without words are one group. A null doc_id comes after all others. Rows with one
    doc_id and different texts are judged by themselves; rows that are the same in both stay or go together. ``docs`` is
    read more than once. Dropped rows are broadcast (id and hash) while they number at most ``limit``.
    """
    prints = write_table(with_blocks(docs), "near-blocks")
    if prints.groupBy("doc_id", "text_hash").count().filter("count > 1").limit(1).count():
        prints = write_table(prints.dropDuplicates(["doc_id", "text_hash"]), "near-blocks")
        texts = docs.select("doc_id", "text").dropDuplicates(["doc_id", "text"])
    else:
        texts = docs
    found = write_table(near_copies(texts, prints, bucket).join(prints.select("node", "doc_id", "text_hash"), "node"), "near-found")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "node")
    best = write_table(found.groupBy("component").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n")), "near-best")
    gone = join_hot(found, best, "component", "n").filter(F.col("node") != F.col("best.node"))
    own, hashed = free_name(docs, "_id"), free_name(docs, "_hash")
    gone = write_table(gone.select(F.col("doc_id").alias(own), F.col("text_hash").alias(hashed)), "near")
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (text_hash() == F.col(hashed))
    return docs.join(maybe_broadcast(gone, gone.count(), limit), same, "left_anti").select(*docs.columns)
