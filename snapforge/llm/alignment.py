"""Alignment of two tokenizers' tokens of the same text, in fragments that compose.

A stretch of a text's bytes, tokenised by both, is a fragment: tokens before the first place where both end a token (open prefix), groups of
tokens between such places (closed), and tokens after the last (open suffix). Fragments compose: a suffix and the
prefix that follows it make one group. Composition is associative, with the empty fragment as its unit, so a very
long document is cut into chunks that different tasks tokenise, and its fragments are composed in rounds, ``FAN_IN`` neighbours at a time.

Chunks, and inside them segments that are tokenised once and remembered, begin where a blank follows something else than
white space. There neither tokenizer joins what is before and after: A's pattern never matches white space after other
characters, and B has no piece with a blank after another character, which is checked when it is loaded.

How often a pair of ids is linked is counted over all documents by Spark. Documents keep their pairs with counts in a
written table; the corpus-wide counts come back to them by a join, broadcast only while the counted pairs are few.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapforge.llm.common import maybe_broadcast, text_of, write_table

#: Bytes above which a document is cut into chunks of about as many.
CHUNK = 1 << 15
FAN_IN = 8
#: Segments that a Python worker remembers, and the longest one.
MEMORY, LONG = 120_000, 64
#: Characters of the texts that are aligned together, unless one has more.
GROUP = 1 << 19
#: Bytes of a row group where rows are as long as chunks. Spark decodes a row group's rows up to 4,096 at once, and a task holds them.
ROW_GROUP = 1 << 24
#: Pairs of ids that may be broadcast, at 24 bytes each.
PAIRS = 1_000_000
#: White space to either tokenizer: where a blank follows one of these, nothing is cut.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
DOUBLE = re.compile(f"[{SPACE}] | $")
#: Below this character, all versions of the pattern's classes agree; other segments are left to the tokenizer itself.
PLAIN = "ɐ"


@dataclass
class Fragment:
    """Ids of A and B in an open prefix, closed groups (as ``a,a|b``) and an open suffix; without a common end all is in the prefix."""

    prefix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    groups: list[str] = field(default_factory=list)
    suffix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    #: Links, each as A id * 2^32 + B id in eight bytes, and whether any common end was met.
    links: list[bytes] = field(default_factory=list)
    closed: bool = False

    def __add__(self, other: Fragment) -> Fragment:
        if not self.closed:
            return Fragment(_both(self.prefix, other.prefix), other.groups, other.suffix, other.links, other.closed)
        if not other.closed:
            return Fragment(self.prefix, self.groups, _both(self.suffix, other.prefix), self.links, True)
        return Fragment(self.prefix, [*self.groups, written(_both(self.suffix, other.prefix)), *other.groups], other.suffix, self.links + other.links, True)

    def all_groups(self) -> list[str]:
        """Of a whole text, which starts and ends at a common end."""
        return [written(self.prefix), *self.groups] if self.closed else []


def _both(one: tuple[list[int], list[int]], two: tuple[list[int], list[int]]) -> tuple[list[int], list[int]]:
    return one[0] + two[0], one[1] + two[1]


def written(group: tuple[list[int], list[int]]) -> str:
    return f"{','.join(map(str, group[0]))}|{','.join(map(str, group[1]))}"


def fragment(a: list[int], a_ends: list[int], b: list[int], b_ends: list[int]) -> Fragment:
    """The fragment of the tokens that end in some stretch of bytes, with the places of their ends, which ascend."""
    out, i, j, p, q = Fragment(), 0, 0, 0, 0
    while p < len(a) and q < len(b):
        if a_ends[p] != b_ends[q]:
            p, q = (p + 1, q) if a_ends[p] < b_ends[q] else (p, q + 1)
            continue
        p, q = p + 1, q + 1
        if out.closed:
            out.groups.append(written((a[i:p], b[j:q])))
        else:
            out.prefix, out.closed = (a[:p], b[:q]), True
        out.links.append((a[p - 1] << 32 | b[q - 1]).to_bytes(8, "little"))
        i, j = p, q
    if out.closed:
        out.suffix = (a[i:], b[j:])
    else:
        out.prefix = (a, b)
    return out


class Tokenizers:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        chars = byte_of_char()
        self.a_bytes = {i: bytes(map(chars.__getitem__, token)) for token, i in model["vocab"].items() if all(c in chars for c in token)}
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        self.fast = None
        if [model["vocab"][m] for m in merges] == list(range(256, 256 + len(merges))):  # ids are ranks
            ranks = {self.a_bytes[i]: i for i in range(256 + len(merges))}
            self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = pieces_of(self.b)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts = may_cut(pieces)

        n = max(self.a_bytes) + 1
        self.a_sizes, self.b_sizes = np.zeros(n, np.int64), np.array([len(t) for t in self.b_bytes])
        self.a_sizes[list(self.a_bytes)] = [len(t) for t in self.a_bytes.values()]
        table = lambda n, after: np.array([f"{i}{after}" for i in range(n)], object)
        #: Ids as text, with what follows them inside and at the end of a group's part.
        self.a_text, self.b_text = (table(n, ","), table(n, "|")), (table(len(pieces), ","), table(len(pieces), ";"))

    def tokens(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of blank + text by A and of text by B; None where the bytes of either aren't those of blank + text."""
        fast, slow, of_a, of_b = self.fast and self.fast._core_bpe.encode_ordinary, self.a.encode, self.a_bytes.__getitem__, self.b_bytes.__getitem__
        whole = [" " + t for t in texts]
        a = [fast(w) if fast is not None and max(w) < PLAIN else slow(w, add_special_tokens=False).ids for w in whole]
        b = self.b.encode(texts, num_threads=1)
        want = [w.encode() for w in whole]
        if all(texts) and all(b"".join(map(of, chain.from_iterable(ids))) == b"".join(want) for of, ids in ((of_a, a), (of_b, b))):
            ends = np.cumsum(np.fromiter(map(len, want), np.int64, len(want)))
            flat = [(np.fromiter(chain.from_iterable(ids), np.int64), np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))) for ids in (a, b)]
            if all((np.cumsum(sizes[ids])[last - 1] == ends).all() for (ids, last), sizes in zip(flat, (self.a_sizes, self.b_sizes), strict=True)):
                return list(zip(a, b, strict=True))
        same = lambda t, w, x, y: bool(t) and b"".join(map(of_a, x)) == w == b"".join(map(of_b, y))
        return [(x, y) if same(t, w, x, y) else None for t, w, x, y in zip(texts, want, a, b, strict=True)]

    def fragment(self, a: list[int], b: list[int]) -> Fragment:
        """Of all tokens of some stretch of bytes."""
        return fragment(a, np.cumsum(self.a_sizes[a]).tolist(), b, np.cumsum(self.b_sizes[b]).tolist())

    def whole_groups(self, tokens: list[tuple[list[int], list[int]]]) -> Iterator[tuple[int, int, str, bytes]]:
        """Numbers of A's and B's tokens, groups and links of whole texts: the texts laid end to end are one, so their common ends are found together."""
        if not tokens:
            return
        counts = [np.array([len(x[k]) for x in tokens]) for k in (0, 1)]
        a, b = (np.fromiter(chain.from_iterable(x[k] for x in tokens), np.int64, counts[k].sum()) for k in (0, 1))
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        common, a_last, b_last = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
        links = (a[a_last] << 32 | b[b_last]).tobytes()
        n_links = np.searchsorted(common, a_ends[np.cumsum(counts[0]) - 1], "right").tolist()
        text = []
        for ids, last, words in ((a, a_last, self.a_text), (b, b_last, self.b_text)):
            part = words[0][ids]
            part[last] = words[1][ids[last]]
            text.append(part)
        order = np.argsort(np.concatenate([2 * np.searchsorted(common, a_ends), 2 * np.searchsorted(common, b_ends) + 1]), kind="stable")
        text = np.concatenate(text)[order].tolist()
        at = link = 0
        for n_a, n_b, n in zip(counts[0].tolist(), counts[1].tolist(), n_links, strict=True):
            yield n_a, n_b, "".join(text[at : at + n_a + n_b])[:-1], links[8 * link : 8 * n]
            at, link = at + n_a + n_b, n


def pieces_of(model) -> list[str]:
    return [model.id_to_piece(i) for i in range(model.get_piece_size())]


def may_cut(pieces: list[str]) -> bool:
    """Whether no piece has a blank after another character."""
    return not any("▁" in p.lstrip("▁") for p in pieces)


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 up."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def segments(text: str, cuts: bool = True) -> list[str]:
    """The text cut at blanks that follow something else than white space; each segment lacks its first blank, and none but a whole empty text is empty."""
    if not cuts:
        return [text]
    parts = text.split(" ")
    if DOUBLE.search(text) is None and parts[0]:
        return parts
    out = [parts[0]]
    for part in parts[1:]:
        if part and out[-1] and out[-1][-1] not in SPACE:
            out.append(part)
        else:
            out[-1] += " " + part
    return out


def chunks(text: str, cuts: bool = True, size: int = CHUNK) -> list[str]:
    """Runs of whole segments of at least ``size`` bytes, the last one shorter; each lacks its first blank."""
    out, part, n = [], [], 0
    for s in segments(text, cuts):
        part.append(s)
        n += len(s.encode()) + 1
        if n >= size:
            out.append(" ".join(part))
            part, n = [], 0
    return [*out, " ".join(part)] if part or not out else out


class Aligner:
    """Alignments of segments, remembered: ids' numbers, groups and links.

    When there are too many, those met since the last time stay within reach, and the others go.
    """

    def __init__(self, a_path: str, b_path: str):
        self.of = Tokenizers(a_path, b_path)
        self.known: dict[str, tuple[int, int, str, bytes] | None] = {}
        self.older: dict[str, tuple[int, int, str, bytes] | None] = {}

    def learn(self, wanted: set[str]) -> None:
        if len(self.known) > MEMORY:
            self.older, self.known = self.known, {}
        known, older, new = self.known, self.older, []
        for s in wanted:
            if s in older:
                known[s] = older[s]
            elif s not in known:
                new.append(s)
        if new:
            tokens = self.of.tokens(new)
            known.update((s, None) for s, t in zip(new, tokens, strict=True) if t is None)
            good = [(s, t) for s, t in zip(new, tokens, strict=True) if t is not None]
            known.update(zip([s for s, _ in good], self.of.whole_groups([t for _, t in good]), strict=True))

    def align(self, texts: list[str]) -> list[tuple[int, int, str, bytes] | None]:
        """Numbers of A's and B's tokens, the groups and the links of whole texts or chunks; None where they have no tokens."""
        split = [segments(t, self.of.cuts) for t in texts]
        wanted = set().union(*split)
        if not wanted <= self.known.keys():
            self.learn(wanted)
        out, known = [], self.known
        for parts in split:
            found = [known[s] for s in parts]
            if None in found:
                out.append(None)
            else:
                a, b, groups, links = zip(*found, strict=True)
                out.append((sum(a), sum(b), ";".join(groups), b"".join(links)))
        for s in wanted:
            if len(s) > LONG:
                del known[s]
        return out

    def align_all(self, texts: list[str]) -> Iterator[tuple[int, int, str, bytes] | None]:
        """The same for any number of texts, some at a time."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size > GROUP:
                yield from self.align(group)
                group, size = [], 0
        if group:
            yield from self.align(group)


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """One per Python worker and pair of tokenizers."""
    return Aligner(a_path, b_path)


def counted(links: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct links, in order, and how often each occurs."""
    return np.unique(np.frombuffer(links, np.int64), return_counts=True)


def finished(kind: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    """Rows (doc_id, tokens of A, of B, groups as text, links) as a batch of ``ALIGNED``."""
    ids, n_a, n_b, groups, links = zip(*rows, strict=True)
    pairs = [counted(x) for x in links]
    offsets = pa.array(np.cumsum([0, *(len(x) for x, _ in pairs)]), pa.int32())
    flat = pa.StructArray.from_arrays([pa.array(np.concatenate([x for x, _ in pairs])), pa.array(np.concatenate([n for _, n in pairs]).astype(np.int64))], ["pair", "n"])
    n_links = [len(x) // 8 for x in links]
    digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
    columns = [pa.array(ids, kind), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_links, n_links)), pa.ListArray.from_arrays(offsets, flat), pa.array(digests, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "pairs", "groups_sha256"])


#: A document without tokens.
NOTHING = (0, 0, "", b"")
ALIGNED = "doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, pairs array<struct<pair:bigint,n:bigint>>, groups_sha256 string"
FRAGMENT = "row bigint, no bigint, doc_id {kind}, n_a bigint, n_b bigint, prefix_a array<int>, prefix_b array<int>, groups binary, suffix_a array<int>, suffix_b array<int>, links binary, times binary, closed boolean, same boolean"
#: Rows that a task hands on at once.
FLUSH = 1000


def align_short(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``ALIGNED`` rows of documents that one task each tokenises."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in batches:
            for at in range(0, len(batch), FLUSH):
                part = batch.slice(at, FLUSH)
                found = own.align_all(part.column(1).to_pylist())
                rows = [(i, *(x or NOTHING)) for i, x in zip(part.column(0).to_pylist(), found, strict=True)]
                yield finished(batch.schema.field(0).type, rows)

    return docs.mapInArrow(work, ALIGNED.format(kind=docs.schema["doc_id"].dataType.simpleString()))


def cut_long(docs: DataFrame, cuts: bool, size: int = CHUNK) -> DataFrame:
    """(row, no, doc_id, text): the chunks of each document, under a number that no other row has once the table is written."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                parts = chunks(text.as_py(), cuts, size)
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([doc_id.as_py()] * n, doc_id.type), pa.array(parts)], ["row", "no", "doc_id", "text"])
                row += 1

    return docs.mapInArrow(work, f"row bigint, no bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")


def fragments(parts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One ``FRAGMENT`` row for each chunk."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path).of
        for batch in batches:
            for at in range(len(batch)):  # one at a time: ids as Python numbers take many times the text's bytes
                (row,), (no,), (doc_id,), (text,) = (c.to_pylist() for c in batch.slice(at, 1).columns)
                (tokens,) = own.tokens([text])
                a, b = tokens or ([], [])
                yield stored(batch.schema.field(2).type, [((row, no, doc_id, len(a), len(b)), own.fragment(a, b), tokens is not None)])

    return parts.mapInArrow(work, FRAGMENT.format(kind=parts.schema["doc_id"].dataType.simpleString()))


def write_long(df: DataFrame, name: str) -> DataFrame:
    """``write_table`` for rows as long as chunks, in row groups of about ``ROW_GROUP`` bytes.

    Without compression, since the writer goes by compressed bytes; looking at them after each row, as rows are of unlike length.
    """
    options = {"compression": "none", "parquet.block.size": ROW_GROUP, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
    return write_table(df, name, **options)


def stored(kind: pa.DataType, rows: list[tuple[tuple, Fragment, bool]]) -> pa.RecordBatch:
    """Groups are compressed, and links are stored once with their numbers, so that Spark moves about as many bytes as the texts have."""
    pairs = [counted(b"".join(f.links)) for _, f, _ in rows]
    columns = [pa.array([labels[k] for labels, _, _ in rows], kind if k == 2 else pa.int64()) for k in range(5)]
    lists = lambda of: pa.array([of(f) for _, f, _ in rows], pa.list_(pa.int32()))
    columns += [lists(lambda f: f.prefix[0]), lists(lambda f: f.prefix[1]), pa.array([zlib.compress(";".join(f.groups).encode(), 1) for _, f, _ in rows], pa.binary()), lists(lambda f: f.suffix[0]), lists(lambda f: f.suffix[1])]
    columns += [pa.array([x.tobytes() for x, _ in pairs], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in pairs], pa.binary()), pa.array([f.closed for _, f, _ in rows]), pa.array([same for _, _, same in rows])]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in FRAGMENT.split(", ")])


def read(batch: pa.RecordBatch) -> Iterator[tuple[tuple, Fragment, bool]]:
    for row in batch.to_pylist():
        labels = tuple(row[k] for k in ("row", "no", "doc_id", "n_a", "n_b"))
        groups, links = zlib.decompress(row["groups"]).decode(), np.repeat(np.frombuffer(row["links"], np.int64), np.frombuffer(row["times"], np.int32))
        found = Fragment((row["prefix_a"], row["prefix_b"]), [groups] if groups else [], (row["suffix_a"], row["suffix_b"]), [links.tobytes()], row["closed"])
        yield labels, found, row["same"]


def finish(kind: pa.DataType, row: tuple[tuple, Fragment, bool]) -> pa.RecordBatch:
    """The ``ALIGNED`` row of a document that is one fragment."""
    (_, _, doc_id, n_a, n_b), found, same = row
    return finished(kind, [(doc_id, n_a, n_b, ";".join(found.all_groups()), b"".join(found.links)) if same else (doc_id, *NOTHING)])


def compose(parts: DataFrame, last: bool, fan_in: int = FAN_IN) -> DataFrame:
    """One round: every ``fan_in`` neighbouring fragments of a document become one, the ``last`` time an ``ALIGNED`` row. A task holds one of them at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kind, give = None, None, finish if last else lambda kind, row: stored(kind, [row])
        for batch in batches:
            kind = batch.schema.field(2).type
            for at in range(len(batch)):
                for (row, no, doc_id, n_a, n_b), found, same in read(batch.slice(at, 1)):
                    if now is not None and now[0][:2] == (row, no // fan_in):
                        (_, _, _, a, b), before, good = now
                        now = (row, no // fan_in, doc_id, a + n_a, b + n_b), before + found, good and same
                    else:
                        if now is not None:
                            yield give(kind, now)
                        now = (row, no // fan_in, doc_id, n_a, n_b), found, same
        if now is not None:
            yield give(kind, now)

    together = parts.repartition("row", F.floor(F.col("no") / fan_in)).sortWithinPartitions("row", "no")
    return together.mapInArrow(work, ALIGNED.format(kind=parts.schema["doc_id"].dataType.simpleString()) if last else parts.schema)


def align_long(docs: DataFrame, a_path: str, b_path: str, size: int = CHUNK) -> DataFrame:
    """``ALIGNED`` rows of documents that several tasks tokenise, chunk by chunk.

    Each step's result is written, so that a stage has one kind of Python worker and only those that tokenise hold the vocabularies.
    """
    import sentencepiece

    cuts = may_cut(pieces_of(sentencepiece.SentencePieceProcessor(model_file=b_path)))
    parts = write_long(cut_long(docs, cuts, size), "chunks")
    left = (parts.agg(F.max("no").alias("n")).first()["n"] or 0) + 1
    found = write_long(fragments(parts.repartition("row", "no"), a_path, b_path), "fragments")
    while left > FAN_IN:
        found, left = write_long(compose(found, False), "fragments"), -(-left // FAN_IN)
    return compose(found, True)


def align(docs: DataFrame, a_path: str, b_path: str, size: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and ``pairs``, the distinct links (A id * 2^32 + B id) with their numbers.

    A text that is null or empty, or whose tokens' bytes by A or by B aren't those of a blank and the text, has no
    tokens: zeros, no pairs, an empty digest. Texts over ``size`` bytes are cut into chunks, so a very long text is many
    records until its last round; one without a blank after another character stays whole. Every row gives one row, repeated rows and null ids
    included; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select("doc_id", text_of("text").alias("text"))
    long = F.octet_length("text") > size
    return align_short(rows.filter(~long), a_path, b_path).unionByName(align_long(rows.filter(long), a_path, b_path, size))


def with_counts(aligned: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """Add count_sum, the corpus-wide counts of a document's links, and n_best, its links whose count is the highest of their B id; without ``pairs``.

    ``aligned`` is read twice, so it should be a written table. More pairs than ``pairs`` are joined by a shuffle.
    """
    linked = aligned.select(F.inline("pairs")).groupBy("pair").agg(F.sum("n").alias("total"))
    counts = write_table(linked.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))), "pair-counts")
    highest = counts.groupBy("b").agg(F.max("total").alias("highest"))
    judged = counts.join(highest, "b").select("pair", "total", (F.col("total") == F.col("highest")).cast("long").alias("best"))
    names = [c for c in aligned.columns if c != "pairs"]
    each = aligned.withColumn("_row", F.monotonically_increasing_id()).select("_row", *names, F.inline_outer("pairs"))
    found = each.join(maybe_broadcast(judged, counts.count(), pairs), "pair", "left").groupBy("_row", *names)
    sums = (F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0)).alias(name) for c, name in (("best", "n_best"), ("total", "count_sum")))
    return found.agg(*sums).drop("_row")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    aligned = align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return with_counts(write_table(aligned, "aligned")).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
