"""Substring deduplication: windows of words that occur in an earlier document too, merged into intervals to remove.

Each task takes the documents of its partition in blocks and rolls a Rabin-Karp hash over every window of every
document. A block keeps, of each hash, the windows of its smallest document; the others are repeats already.
What it keeps goes out by ranges of a second hash, a few bytes a window: the hash, and where it is as a difference to the
window before. Each range counts its hashes over all blocks and tells which windows have an earlier document. So the
most frequent passage is one window a block, and a document's windows are spread over all ranges. What they find is
gathered by documents' homes, again as one record for each range and home, and merged into intervals there.

Equality is by 64 bits of the first hash and the range of the second, about 80 bits at 100 TB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapforge.llm.common import free_name, text_of, write_table

WINDOW = 50
#: Words of a block, which a task holds at once, unless one document has more.
BLOCK = 1_000_000
#: Windows of a range. There are 4,096 ranges at most until they hold ``LARGEST``, so that at any size blocks send records of some length.
RANGE, LARGEST = 2_000_000, 32_000_000
#: Words whose hashes a Python worker remembers.
MEMORY = 200_000
#: Odd, so that they have inverses modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SENT = "part int, hashes binary, counts binary, ids binary, keys binary, places binary"
FOUND = "home int, counts binary, ids binary, keys binary, places binary"
SPANS = "doc_id bigint, key bigint, spans array<struct<start:int,end:int>>"


class WordHashes:
    """64-bit values of words (bytes), remembered while they are few enough."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        try:
            return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(self.known) > MEMORY:
                self.known.clear()
            self.known.update((w, xxhash.xxh3_64_intdigest(w)) for w in set(words).difference(self.known))
            return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def rolling(values: np.ndarray, window: int, base: int) -> np.ndarray:
    """The polynomial of every ``window`` values in a row, modulo 2^64: differences of one running sum, moved to the same power."""
    if len(values) < window:
        return np.zeros(0, np.uint64)
    up = np.full(len(values), base, np.uint64)
    down = np.full(len(values), pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * np.cumprod(down))])
    return (sums[window:] - sums[:-window]) * np.cumprod(up)[: len(values) - window + 1]


def pack_places(places: np.ndarray, first: np.ndarray) -> bytes:
    """Ascending places in each document as differences, byte by byte, so that what is zero compresses away."""
    before = np.concatenate([np.zeros(1, np.int64), places[:-1]])
    before[first] = 0
    return np.ascontiguousarray((places - before).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack_places(packed: bytes, counts: np.ndarray) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    sums, first = np.cumsum(steps), np.cumsum(counts, dtype=np.int64) - counts
    return sums - np.repeat(sums[first] - steps[first], counts)


class Block:
    """Documents until they are sent; each row (id and text) once."""

    def __init__(self, window: int, parts: int):
        self.window, self.parts, self.size, self.rows = window, parts, 0, {}

    def add(self, doc_id: int, key: int, values: np.ndarray) -> None:
        if len(values) >= self.window and (doc_id, key) not in self.rows:
            self.rows[doc_id, key] = values
            self.size += len(values)

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        labels = sorted(self.rows)  # places in the block follow doc_id
        lengths = np.array([len(self.rows[x]) for x in labels])
        values = np.concatenate([self.rows[x] for x in labels])
        self.rows, self.size = {}, 0
        ids, keys = np.array([x[0] for x in labels], np.int64), np.array([x[1] for x in labels], np.int64)
        doc = np.repeat(np.arange(len(labels), dtype=np.int32), lengths)
        place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        inside = np.flatnonzero(place <= np.repeat(lengths - self.window, lengths))
        doc, place = doc[inside], place[inside]
        hashes = rolling(values, self.window, BASES[0])[inside]
        order = np.argsort(hashes)
        starts = np.flatnonzero(np.concatenate([[True], hashes[order[1:]] != hashes[order[:-1]]]))
        least = np.minimum.reduceat(ids[doc[order]], starts)
        late = np.zeros(len(hashes), bool)
        late[order] = ids[doc[order]] > np.repeat(least, np.diff(np.append(starts, len(order))))
        part = ((rolling(values, self.window, BASES[1])[inside] >> np.uint64(32)) * np.uint64(self.parts) >> np.uint64(32)).astype(np.int64)
        del values, order
        out = [self.record(int(keys[0]) % self.parts, b"", np.flatnonzero(late), doc, place, ids, keys)] if late.any() else []
        kept = np.flatnonzero(~late)
        kept = kept[np.argsort(part[kept], kind="stable")]
        ends = np.flatnonzero(np.append(part[kept][1:] != part[kept][:-1], True)) + 1
        for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
            at = kept[a:b]
            out.append(self.record(int(part[at[0]]), hashes[at].tobytes(), at, doc, place, ids, keys))
        yield table(out, SENT)

    @staticmethod
    def record(part: int, hashes: bytes, at: np.ndarray, doc: np.ndarray, place: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> tuple:
        """One record of a range: windows ``at``, in the order of their documents."""
        d = doc[at]
        first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        counts = np.diff(np.append(first, len(at))).astype("<u4")
        return part, hashes, counts.tobytes(), ids[d[first]].tobytes(), keys[d[first]].tobytes(), pack_places(place[at], first)


def late_windows(records: list[tuple]) -> Iterator[tuple]:
    """ids, keys, numbers of windows and places of the documents in one range that have windows which a smaller document has too.

    ``records`` are (hashes, counts, ids, keys, places); those without hashes are known to be late.
    """
    open_ = [r for r in records if r[0]]
    numbers = lambda k, kind: np.concatenate([np.frombuffer(r[k], kind) for r in open_])
    for hashes, counts, ids, keys, places in records:
        if not hashes:
            counts = np.frombuffer(counts, "<u4")
            yield np.frombuffer(ids, np.int64), np.frombuffer(keys, np.int64), counts, unpack_places(places, counts)
    if not open_:
        return
    hashes, counts, ids, keys = numbers(0, np.uint64), numbers(1, "<u4"), numbers(2, np.int64), numbers(3, np.int64)
    order = np.argsort(hashes)
    starts = np.flatnonzero(np.concatenate([[True], hashes[order[1:]] != hashes[order[:-1]]]))
    del hashes
    doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    sizes = np.diff(np.append(starts, len(order)))
    least = np.minimum.reduceat(ids[doc[order]], starts)
    late = np.sort(order[ids[doc[order]] > np.repeat(least, sizes)])
    if len(late):
        places = np.concatenate([unpack_places(r[4], np.frombuffer(r[1], "<u4")) for r in open_])
        docs, counts = np.unique(doc[late], return_counts=True)
        yield ids[docs], keys[docs], counts, places[late]


def by_home(ids: np.ndarray, keys: np.ndarray, counts: np.ndarray, places: np.ndarray, homes: int) -> Iterator[tuple]:
    """Records of ``FOUND``: documents go to one of ``homes``, one record each."""
    home = ((ids.astype(np.uint64) * np.uint64(BASES[0]) ^ keys.astype(np.uint64)) * np.uint64(BASES[1]) >> np.uint64(33)).astype(np.int64) % homes
    order = np.argsort(home, kind="stable")
    window = np.argsort(np.repeat(home, counts), kind="stable")
    places, begins = places[window], np.concatenate([[0], np.cumsum(counts[order], dtype=np.int64)])
    cut = np.concatenate([[0], np.flatnonzero(np.diff(home[order])) + 1, [len(order)]])
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        own, n = order[a:b], counts[order[a:b]].astype("<u4")
        first = begins[a:b] - begins[a]
        yield int(home[own[0]]), n.tobytes(), ids[own].tobytes(), keys[own].tobytes(), pack_places(places[begins[a] : begins[b]], first)


def spans_of(records: list[tuple], window: int) -> pa.RecordBatch:
    """``SPANS`` of one home's documents: the longest intervals that late windows cover; windows that touch are one."""
    counts = [np.frombuffer(r[0], "<u4") for r in records]
    ids, keys = (np.concatenate([np.frombuffer(r[k], np.int64) for r in records]) for k in (1, 2))
    place = np.concatenate([unpack_places(r[3], n) for r, n in zip(records, counts, strict=True)])
    pairs = np.lexsort((keys, ids))
    fresh = np.concatenate([[True], (ids[pairs[1:]] != ids[pairs[:-1]]) | (keys[pairs[1:]] != keys[pairs[:-1]])])
    number = np.empty(len(ids), np.int64)
    number[pairs] = np.cumsum(fresh) - 1
    doc = np.repeat(number, np.concatenate(counts))
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    first = np.concatenate([[True], (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + window)])
    starts = np.flatnonzero(first)
    last = np.append(starts[1:], len(place)) - 1
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[starts], minlength=int(fresh.sum())))])
    both = [pa.array(x.astype(np.int32)) for x in (place[starts], place[last] + window)]
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(both, ["start", "end"]))
    return pa.RecordBatch.from_arrays([pa.array(ids[pairs[fresh]]), pa.array(keys[pairs[fresh]]), lists], ["doc_id", "key", "spans"])


def intervals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``SPANS``: the words to remove from each document that has any. ``key`` is the text's XXH64, for ids that are not unique."""
    size = docs.agg(F.sum(F.octet_length(text_of("text"))).alias("n")).first()["n"] or 0
    windows = size // 6 + 1
    parts = max(1, min(windows // RANGE, 4096), windows // LARGEST)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, hashes = Block(window, parts), WordHashes()
        for batch in batches:
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                block.add(doc_id, key, hashes.of(text.as_buffer().to_pybytes().split()))
                if block.size >= BLOCK:
                    yield from block.send()
        yield from block.send()

    def count(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
        for late in late_windows(records):
            yield table(list(by_home(*late, parts)), FOUND)

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield spans_of([r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)], window)

    return keyed(docs).mapInArrow(send, SENT).groupBy("part").applyInArrow(count, FOUND).groupBy("home").applyInArrow(merge, SPANS)


def table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows of one number and binary columns."""
    names = [x.split()[0] for x in schema.split(", ")]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k else pa.int32()) for k, c in enumerate(columns)], names)


def number_of(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id (null as the least number), key and text (null as empty)."""
    return docs.select(number_of("doc_id").alias("doc_id"), F.xxhash64(text_of("text")).alias("key"), text_of("text").alias("text"))


def with_intervals(docs: DataFrame, window: int = WINDOW, name: str = "removed") -> DataFrame:
    """Add ``name``: the maximal intervals of words, array<struct<start int, end int>>, to be removed from each document.

    A word is what stands between white space (blank, tab, line feed, vertical tab, form feed, carriage return). An interval covers words of
    windows of ``window`` words that also start in a document with a smaller doc_id, both judged on the whole input. Null
    texts count as empty; these, blank texts and texts shorter than a window have no intervals. doc_id is a whole number; null is less than all others, and rows with one doc_id
    don't remove words from each other, so repeated rows stay alike. Very long texts are treated whole, by one task.
    Other columns stay; a column called ``name`` is replaced. Empty tables give empty results.
    """

    found = write_table(intervals(docs, window), "intervals")
    rest = docs.drop(name)
    names = [free_name(rest, x) for x in ("_id", "_key", "_spans")]
    found = found.toDF(*names)
    same = (number_of("doc_id") == F.col(names[0])) & (F.xxhash64(text_of("text")) == F.col(names[1]))
    return rest.join(found.hint("shuffle_hash"), same, "left").withColumn(name, F.coalesce(F.col(names[2]), F.array().cast("array<struct<start:int,end:int>>"))).drop(*names)


def keep_rest(words: list[bytes], spans: list[dict]) -> list[bytes]:
    kept, at = [], 0
    for span in spans:
        kept += words[at : span["start"]]
        at = span["end"]
    return kept + words[at:]


def without_repeats(docs: DataFrame, window: int = WINDOW, name: str = "kept") -> DataFrame:
    """Add ``name`` struct<n_words bigint, n_removed bigint, text string>: the words that stay, joined by one blank. See ``with_intervals``."""

    @F.arrow_udf("struct<n_words:bigint,n_removed:bigint,text:string>")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        totals, removed, kept = [], [], []
        for text, own in zip(texts, spans.to_pylist(), strict=True):
            words = text.as_buffer().to_pybytes().split()
            rest = keep_rest(words, own) if own else words
            totals.append(len(words))
            removed.append(len(words) - len(rest))
            kept.append(b" ".join(rest))
        return pa.StructArray.from_arrays([pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["n_words", "n_removed", "text"])

    spans = free_name(docs, "_removed")
    return with_intervals(docs, window, spans).withColumn(name, cut(text_of("text"), F.col(spans))).drop(spans)


def op12_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = without_repeats(docs)
    return kept.select("doc_id", "kept.n_words", "kept.n_removed", F.sha2("kept.text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, place, md5(array_to_string(words[place:place + 49], ' ')) AS digest
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS place FROM texts WHERE len(words) >= 50)),
late AS (SELECT doc_id, place FROM (SELECT doc_id, place, min(doc_id) OVER (PARTITION BY digest) AS least FROM windows) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, place + step AS place FROM late, (SELECT unnest(range(0, 50)) AS step)),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM texts),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT t.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (doc_id)
"""
