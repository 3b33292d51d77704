"""Runs of repeated word sequences inside a document: maximal stretches whose words repeat at a smallest period.

A run of period q starting at s is seen in the text's suffixes: those at s and s + q agree in all words up to the run's
end, and differ in the word to their left. So runs are the pairs of suffixes with unlike left words whose common prefix is
at least as long as their distance (and as the least length asks), and nothing needs extending. They are enumerated on
the tree of LCP intervals from the bottom: each interval keeps its suffixes in classes by left word, and where two
intervals meet, only places of unlike classes within reach are looked up.

Documents are independent, so Spark maps over rows. Suffixes of many documents are sorted together by prefix doubling in NumPy, and
only groups of suffixes that can hold a run (unlike left words, some two within reach) are enumerated in Python.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from snapforge.llm.common import free_name, text_of

LEAST = 12
#: Words of the documents that are sorted together, unless one has more.
GROUP = 400_000
#: Words that a Python worker numbers before it begins anew.
MEMORY = 300_000
#: Up to so many classes are looked through one by one.
FEW = 8
MIX = 0x9E3779B97F4A7C15
TYPE = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,text:string>"


def group_starts(keys: np.ndarray) -> np.ndarray:
    """Of sorted keys, whether each differs from the one before."""
    return np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)


def sort_suffixes(words: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of all suffixes (each ends with its document, and those of one word and document are together), and the ranks by 1, 2, 4, ... words.

    Only suffixes that still share a rank are sorted in each round.
    """
    key = doc.astype(np.uint64) << np.uint64(32) | words.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    new = group_starts(key[order])
    slots = np.arange(len(order))
    rank = np.empty(len(order), np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, slots, 0))
    levels, step = [rank.copy()], 1
    while True:
        open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(open_):
            return order, levels
        at = order[open_]
        ahead = at + step
        inside = ahead < ends[doc[at]]
        second = np.where(inside, rank[np.where(inside, ahead, 0)] + 1, 0)
        key = rank[at].astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)
        again = np.argsort(key, kind="stable")
        at, key = at[again], key[again]
        fresh = group_starts(key)
        order[open_], new[open_] = at, fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, open_, 0))
        levels.append(rank.copy())
        step *= 2


def common_prefixes(a: np.ndarray, b: np.ndarray, end: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """How many words the suffixes at ``a`` and ``b`` of the same documents share."""
    shared = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + shared, b + shared
        inside = (i < end) & (j < end)
        same = inside & (levels[k][np.where(inside, i, 0)] == levels[k][np.where(inside, j, 0)])
        shared += same.astype(np.int64) << k
    return shared


class Interval:
    """An LCP interval's suffixes in classes by their left word; each class is in order, and on demand all of them together."""

    __slots__ = ("classes", "size", "order")

    def __init__(self, place: int, left: int):
        self.classes, self.size, self.order = {left: [place]}, 1, None

    def absorb(self, other: Interval) -> None:
        for left, places in other.classes.items():
            own = self.classes.get(left)
            if own is None:
                self.classes[left] = places
            elif len(places) < 8:
                for p in places:
                    insort(own, p)
            else:
                own += places
                own.sort()
            if self.order is not None:
                for p in places:
                    insort(self.order, p)
        self.size += other.size

    def unlike(self, place: int, left: int, reach: int, left_of: dict[int, int]) -> Iterator[int]:
        """Places of other classes at most ``reach`` away."""
        if len(self.classes) > FEW:
            if self.order is None:
                self.order = sorted(p for places in self.classes.values() for p in places)
            a, b = bisect_left(self.order, place - reach), bisect_right(self.order, place + reach)
            if b - a <= len(self.classes):
                yield from (p for p in self.order[a:b] if left_of[p] != left)
                return
        for other, places in self.classes.items():
            if other != left:
                yield from places[bisect_left(places, place - reach) : bisect_right(places, place + reach)]


def maximal_pairs(places: list[int], lefts: list[int], prefixes: list[int]) -> Iterator[tuple[int, int, int]]:
    """(place, distance, common prefix) of all pairs with unlike left words at most a common prefix apart.

    ``places`` are suffixes in order, ``prefixes`` what each shares with the next. Intervals are open on a stack; a
    smaller one is looked up in the larger that it meets.
    """
    left_of = dict(zip(places, lefts, strict=True))

    def meet(a: Interval, b: Interval, reach: int) -> Iterator[tuple[int, int, int]]:
        small, large = (a, b) if a.size < b.size else (b, a)
        for left, own in small.classes.items():
            for p in own:
                for q in large.unlike(p, left, reach, left_of):
                    yield min(p, q), abs(p - q), reach
        large.absorb(small)
        return large

    stack: list[tuple[int, Interval]] = []
    node = Interval(places[0], lefts[0])
    for k, shared in enumerate([*prefixes, 0]):
        while stack and stack[-1][0] > shared:
            reach, top = stack.pop()
            node = yield from meet(top, node, reach)
        if shared == 0:
            return
        if stack and stack[-1][0] == shared:
            stack[-1] = (shared, (yield from meet(stack[-1][1], node, shared)))
        else:
            stack.append((shared, node))
        node = Interval(places[k + 1], lefts[k + 1])


def find_runs(words: list[np.ndarray], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each document, whose words are given as numbers, in order."""
    half = -(-least // 2)
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    active = _repeating([k for k, w in enumerate(words) if len(w) >= least], words, half)
    if not active:
        return out
    lengths = np.array([len(words[k]) for k in active])
    ends = np.cumsum(lengths)
    begins = ends - lengths
    whole = np.concatenate([words[k] for k in active])
    doc = np.repeat(np.arange(len(active)), lengths)
    order, levels = sort_suffixes(whole, doc, ends)
    rough = levels[min(len(levels) - 1, half.bit_length() - 1)]
    pairs = np.flatnonzero(rough[order[1:]] == rough[order[:-1]])
    a, b = order[pairs], order[pairs + 1]
    shared = common_prefixes(a, b, ends[doc[a]], levels)
    del levels, rough
    pairs, shared = pairs[shared >= half], shared[shared >= half]
    if not len(pairs):
        return out
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1] + 1]))
    sizes = np.diff(np.append(first, len(pairs)))
    member = np.repeat(np.arange(len(first)), sizes + 1)  # suffixes of each group of neighbours
    offset = np.cumsum(sizes + 1) - (sizes + 1)
    place = order[np.repeat(pairs[first], sizes + 1) + np.arange(len(member)) - np.repeat(offset, sizes + 1)]
    left = np.where(place > begins[doc[place]], whole[place - 1].astype(np.int64), -1)
    near = place[np.lexsort((place, member))]
    gaps = np.append(near[1:] - near[:-1], 0)
    gaps[offset + sizes] = np.iinfo(np.int64).max  # the last of a group has no next
    possible = (np.minimum.reduceat(left, offset) != np.maximum.reduceat(left, offset)) & (np.minimum.reduceat(gaps, offset) <= np.maximum.reduceat(shared, first))
    for g in np.flatnonzero(possible).tolist():
        at = slice(offset[g], offset[g] + sizes[g] + 1)
        k = int(doc[place[at.start]])
        found = maximal_pairs((place[at] - begins[k]).tolist(), left[at].tolist(), shared[first[g] : first[g] + sizes[g]].tolist())
        out[active[k]] += [(start, distance + common, distance) for start, distance, common in found if distance + common >= least]
    for k in active:
        periods: dict[tuple[int, int], int] = {}
        for start, length, period in out[k]:  # multiples of the period pair up too, over the same stretch
            periods[start, length] = min(period, periods.get((start, length), period))
        out[k] = sorted(((start, length, period) for (start, length), period in periods.items()), key=lambda r: (r[0], r[2]))
    return out


def _repeating(candidates: list[int], words: list[np.ndarray], half: int) -> list[int]:
    """Documents that may hold some sequence of ``half`` words twice: hashes that agree, so none is missed."""
    if not candidates:
        return []
    lengths = np.array([len(words[k]) for k in candidates])
    whole = np.concatenate([words[k] for k in candidates]).astype(np.uint64) + np.uint64(1)
    hashes = np.zeros(len(whole) - half + 1, np.uint64)
    for step in range(half):
        hashes = hashes * np.uint64(MIX) + whole[step : step + len(hashes)]
    doc = np.repeat(np.arange(len(candidates)), lengths)
    inside = np.arange(len(whole)) <= np.repeat(np.cumsum(lengths), lengths) - half
    at = np.flatnonzero(inside)
    doc = doc[at]
    keys = (hashes[at] ^ (hashes[at] >> np.uint64(29))) * np.uint64(MIX) + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(keys)
    twice = order[1:][keys[order[1:]] == keys[order[:-1]]]
    return [candidates[k] for k in np.unique(doc[twice]).tolist()]


def covered(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Whether each of ``n`` words lies in some run after that run's first period."""
    if not runs:
        return np.zeros(n, bool)
    start, length, period = np.array(runs).T
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    return np.cumsum(edges)[:n] > 0


class Reader:
    """Numbers for words, the same while a group of documents is read."""

    def __init__(self) -> None:
        self.known: defaultdict[bytes, int] = defaultdict(count().__next__)

    def read(self, texts: pa.Array, least: int) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
        """(number of words, runs, collapsed text) of each text, some at a time."""
        group, size = [], 0
        for text in texts:
            group.append(text.as_buffer().to_pybytes().split())
            size += len(group[-1])
            if size >= GROUP:
                yield from self.flush(group, least)
                group, size = [], 0
        yield from self.flush(group, least)

    def flush(self, group: list[list[bytes]], least: int) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
        if len(self.known) > MEMORY:
            self.known = defaultdict(count().__next__)
        numbers = [np.fromiter(map(self.known.__getitem__, words), np.int32, len(words)) for words in group]
        for words, runs in zip(group, find_runs(numbers, least), strict=True):
            rest = [w for w, gone in zip(words, covered(runs, len(words)).tolist(), strict=True) if not gone] if runs else words
            yield len(words), runs, b" ".join(rest)


def with_runs(docs: DataFrame, text: str = "text", least: int = LEAST, name: str = "found") -> DataFrame:
    """Add ``name``, struct<n_words bigint, runs array<struct<start, length, period>>, text string>.

    Words stand between white space (blank, tab, line feed, vertical tab, form feed, carriage return). A run is at least ``least`` words and two periods long; runs are
    in order of start, then period. ``text`` holds the words that no run has after its first period, joined by one blank.
    Null texts count as empty; these and blank texts have no words and no runs. Every row gives one row, repeated rows and null ids
    included; an empty table gives an empty result, and other columns stay (one called ``name`` is replaced). A very
    long text is treated whole by one task, with memory in proportion to its words times the logarithm of its longest repeat.
    """

    rest = docs.drop(name)
    own = free_name(rest, "_text")
    schema = StructType([*rest.schema.fields, StructField(name, _parse_datatype_string(TYPE))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            if not len(batch):
                continue
            found = list(reader.read(batch.column(batch.num_columns - 1), least))
            runs = [r for _, own, _ in found for r in own]
            columns = [pa.array([r[k] for r in runs], pa.int64()) for k in range(3)]
            offsets = pa.array(np.cumsum([0, *(len(own) for _, own, _ in found)]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, ["start", "length", "period"]))
            texts = pa.array([rest for _, _, rest in found], pa.binary()).cast(pa.string())
            column = pa.StructArray.from_arrays([pa.array([n for n, _, _ in found], pa.int64()), lists, texts], ["n_words", "runs", "text"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], [*batch.schema.names[:-1], name])

    return rest.withColumn(own, text_of(docs[text])).mapInArrow(find, schema)


def planted(doc_id: Column, text: Column) -> Column:
    """The text, made periodic from some word on where crc32(doc_id) is divisible by 10 and there are words; else unchanged."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def periodic(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        source = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, source(i))), " ")

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    made = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, periodic(w)).otherwise("")), 0)
    return F.when(h % 10 == 0, made).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_runs(docs.withColumn("text", planted(F.col("doc_id"), text_of("text"))))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("found.runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = F.array_min(F.transform("found.runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    return found.withColumn("best", best).select(
        "doc_id", F.size("found.runs").cast("long").alias("n_runs"), "best.start", (-F.col("best.shorter")).alias("length"), "best.period",
        F.floor(-1000 * F.col("best.shorter") / F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("found.text", 256).alias("collapsed_sha256"))
