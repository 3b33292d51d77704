"""Harmonic packing of tokenised documents into sequences of fixed capacity.

A piece of length L with capacity/(k+1) < L <= capacity/k is of class k, and a sequence of class k takes k such
pieces, so filling it needs no search. Documents are cut so that pieces nearly fill their share: whole sequences
first, and a remainder that would waste more than ``WASTE`` of its share gives off a piece of exactly the next smaller
share. Workers pack independently, each its own partition. The pieces of classes above ``CLASSES``, and at the end those
of sequences that a worker couldn't fill, are laid end to end and cut at the capacity, so that a worker pads one
sequence at most, besides the little padding inside filled ones.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapforge.llm.common import text_of

CAPACITY = 2048
#: Classes with sequences of their own.
CLASSES = 32
#: Part of its share that a piece may leave empty.
WASTE = 0.02
#: Pieces that a task hands on at once.
FLUSH = 2048
#: Words whose ids a Python worker remembers.
CACHE = 150_000
END_ID = 1


#: Appended to a pre-token's bytes for the end of the word; UTF-8 has no such byte.
END_OF_WORD = b"\xff"
#: Below this character, composition and lower-casing change a character by itself, the same way everywhere.
PLAIN = "\u0130"


def _byte_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 up."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class WordEncoder:
    """Ids of words between white space, remembered.

    Words of plain characters are merged by tiktoken over the same vocabulary, many times faster for short strings
    than a call of the tokenizer: with the end of a word as a byte of its own, the vocabulary's ids are ranks in
    the order of its merges. All other words, those that hold an added token (which has an id of its own wherever it
    occurs in a text), and all words where ids don't follow the merges, are left to the tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        self.added = [token["content"] for token in whole["added_tokens"]]
        model, splits = whole["model"], whole["pre_tokenizer"]["pretokenizers"]
        pairs = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        vocab, end, chars = model["vocab"], model["end_of_word_suffix"], _byte_chars()
        self.plain = bool(end) and [vocab[p] for p in pairs] == list(range(512, 512 + len(pairs)))
        if self.plain:
            ranks = {}
            for token, i in vocab.items():
                if i < 512 + len(pairs):
                    word = token.removesuffix(end)
                    ranks[bytes(map(chars.__getitem__, word)) + END_OF_WORD * (word != token)] = i
            self.split = regex.compile(splits[0]["pattern"]["Regex"])
            self.merge = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def encode_plain(self, word: str) -> bytes:
        word, merge = word.lower(), self.merge
        if word.isalpha():
            return array("I", merge(word.encode() + END_OF_WORD)).tobytes()
        return array("I", [i for piece in self.split.findall(word) for i in merge(piece.encode() + END_OF_WORD)]).tobytes()

    def learn(self, words: set[bytes]) -> None:
        rest = []
        for raw in words:
            word = raw.decode("utf-8", "replace")
            if self.plain and max(word) < PLAIN and not any(token in word for token in self.added):
                self.known[raw] = self.encode_plain(word)
            else:
                rest.append((raw, word))
        if rest:
            coded = self.tokenizer.encode_batch([w for _, w in rest], add_special_tokens=False)
            self.known.update((raw, array("I", c.ids).tobytes()) for (raw, _), c in zip(rest, coded, strict=True))

    def encode(self, text: str) -> bytes:
        """The whole text's ids, packed as little-endian unsigned 32-bit numbers."""
        words = text.encode("utf-8", "surrogatepass").split()
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            pass
        if len(self.known) > CACHE:
            self.known.clear()
        self.learn({w for w in words if w not in self.known})
        return b"".join(map(self.known.__getitem__, words))


@cache
def word_encoder(path: str) -> WordEncoder:
    """One per Python worker and tokenizer."""
    return WordEncoder(path)


def cut(length: int, capacity: int = CAPACITY, classes: int = CLASSES, waste: float = WASTE) -> list[int]:
    """Lengths of the pieces of a document, in order."""
    pieces = [capacity] * (length // capacity)
    left = length % capacity
    while left:
        k = capacity // left
        if k <= classes and left < (1 - waste) * (capacity // k) and capacity // (k + 1) > 0:
            pieces.append(capacity // (k + 1))
            left -= pieces[-1]
        else:
            pieces.append(left)
            left = 0
    return pieces


class Packer:
    """Open sequences of one worker: at most a few pieces of each class, and the lane's position."""

    def __init__(self, worker: int, capacity: int, classes: int):
        self.capacity, self.classes = capacity, classes
        self.next = worker << 32
        self.open: dict[int, list[tuple]] = {}
        self.lane, self.at = None, 0
        self.rows: list[tuple] = []

    def number(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, piece: tuple) -> None:
        """``piece``: document, start, ids (packed), tokens of the document."""
        k = self.capacity // (len(piece[2]) // 4)
        if k > self.classes:
            self.lay(piece)
            return
        bin_ = self.open.setdefault(k, [])
        bin_.append(piece)
        if len(bin_) == k:
            sequence, at = self.number(), 0
            for doc, start, ids, total in bin_:
                self.rows.append((doc, start, len(ids) // 4, ids, total, sequence, at))
                at += len(ids) // 4
            bin_.clear()

    def lay(self, piece: tuple) -> None:
        """End to end after the lane's last piece, cut where a sequence ends."""
        doc, start, ids, total = piece
        while ids:
            if self.lane is None or self.at == self.capacity:
                self.lane, self.at = self.number(), 0
            part = ids[: 4 * (self.capacity - self.at)]
            self.rows.append((doc, start, len(part) // 4, part, total, self.lane, self.at))
            self.at += len(part) // 4
            start += len(part) // 4
            ids = ids[len(part) :]

    def close(self) -> None:
        for k in sorted(self.open):
            for piece in self.open[k]:
                self.lay(piece)
        self.open.clear()


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, classes: int = CLASSES) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset of every piece.

    Each task is a worker that packs the documents of its partition as they come, so nothing is shuffled, and a task
    that runs again gives its own sequences anew. A null or empty text is a document of the end id alone. Repeated
    rows are packed as often as they come, and a null doc_id is an id like any other. An empty table gives an empty
    result; other columns are ignored.
    """
    rows = docs.select("doc_id", text_of("text").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, encoder, types = Packer(TaskContext.get().partitionId(), capacity, classes), word_encoder(path), None

        def flush() -> pa.RecordBatch:
            columns = zip(*packer.rows, strict=True)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
            packer.rows = []
            return batch

        for batch in batches:
            types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py()) + array("I", [END_ID]).tobytes()
                at, total = 0, len(ids) // 4
                for size in cut(total, capacity, classes):
                    packer.add((doc, at, ids[4 * at : 4 * (at + size)], total))
                    at += size
                if len(packer.rows) >= FLUSH:
                    yield flush()
        packer.close()
        if packer.rows:
            yield flush()

    return rows.mapInArrow(work, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
