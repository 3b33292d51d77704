"""Byte-level BPE by a sentencepiece model that is serialised straight from a rank vocabulary.

A token of rank r becomes piece r with score -r. Its bytes are mapped to one character each, and the normaliser is
the identity, so sentencepiece merges the pair with the lowest rank, leftmost first, within each pre-token. Tokens that
the merges alone don't reach as one piece are looked up before encoding, as rank encoders do. Decoding maps pieces
back to bytes.
"""

from __future__ import annotations

import base64
import re
import struct
from array import array
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapforge.llm.common import text_of

#: Byte b is the character with this number plus b: assigned, and changed by no normalisation here.
FIRST_CHAR = 0x100
#: Text segments whose ids a Python worker remembers.
CACHE = 200_000
#: Longer segments aren't remembered.
LONG = 64
#: Characters of text that are encoded together.
GROUP = 1 << 20
NEWLINE = chr(FIRST_CHAR + 10)
_SPACE = "\t-\r \x85\xa0  -     　"
#: Whole pre-tokens, some together: what is between white space, with the one space before it, or white space.
_SEGMENT = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol buffer field: bytes, a number or a 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def map_bytes(data: bytes) -> str:
    return "".join(chr(FIRST_CHAR + b) for b in data)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto with piece id = rank; the unknown piece, which never occurs, comes last."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every single byte needs a rank")
    pieces = b""
    parts = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts.append(_field(1, _field(1, map_bytes(token).encode()) + _field(2, -float(rank)) + _field(3, 1)))
    parts.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    pieces = b"".join(parts)
    bpe, absent = 2, (1 << 64) - 1
    trainer = _field(3, bpe) + _field(4, len(ranks) + 1) + _field(40, len(ranks)) + b"".join(_field(n, absent) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + _field(2, trainer) + _field(3, normaliser)


class ByteBPE:
    """Encoder and decoder over one vocabulary; ids are packed as little-endian 32-bit numbers."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        import sentencepiece

        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.ranks))
        self.pattern = regex.compile(pattern)
        self.tokens = [t for t, _ in sorted(self.ranks.items(), key=lambda x: x[1])]
        self.chars = str.maketrans({b: FIRST_CHAR + b for b in range(256)})
        self.known: dict[str, bytes] = {}
        coded = self.model.encode([map_bytes(t) for t in self.tokens], num_threads=1)
        self.whole = {map_bytes(t): [i] for i, (t, ids) in enumerate(zip(self.tokens, coded, strict=True)) if ids != [i]}

    def learn(self, segments: set[str]) -> dict[str, bytes]:
        """Ids of each segment, all their pre-tokens encoded in one call."""
        order = list(segments)
        cuts = [[x] if x.isascii() and x[x[0] == " " :].isalpha() else self.pattern.findall(x) for x in order]
        distinct = {p for cut in cuts for p in cut}
        lines = [p for p in distinct if "\n" in p]
        rest = list(distinct.difference(lines))
        mapped = "\n".join(rest).encode("utf-8", "surrogatepass").decode("latin-1").translate(self.chars).split(NEWLINE) if rest else []
        mapped += [map_bytes(p.encode("utf-8", "surrogatepass")) for p in lines]
        ids = self.model.encode(mapped, num_threads=1)
        coded = {p: array("i", self.whole.get(m) or i).tobytes() for p, m, i in zip(rest + lines, mapped, ids, strict=True)}
        return {x: b"".join(map(coded.__getitem__, cut)) for x, cut in zip(order, cuts, strict=True)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, for texts that fit into memory together."""
        split = [_SEGMENT.findall(t) for t in texts]
        known = self.known
        new = {x for segments in split for x in segments if x not in known}
        if len(known) + len(new) > CACHE:
            known.clear()
            new = {x for segments in split for x in segments}
        found = self.learn(new)
        known.update(found)
        out = [b"".join(map(known.__getitem__, segments)) for segments in split]
        for x in found:
            if len(x) > LONG:
                del known[x]
        return out

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The same for any number of texts, some at a time."""
        out, group, size = [], [], 0
        for text in texts:
            group.append(text.as_py())
            size += len(group[-1])
            if size > GROUP:
                out += self.encode(group)
                group, size = [], 0
        return out + self.encode(group)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids; ids outside the vocabulary, negative ones too, are an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.tokens)):
            raise ValueError(f"ids must lie in 0 .. {len(self.tokens) - 1}, found {ids.min()} .. {ids.max()}")
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@cache
def bpe(path: str) -> ByteBPE:
    """One per Python worker and vocabulary."""
    return ByteBPE(path)


def with_tokens(df: DataFrame, path: str, text: str = "text", name: str = "ids") -> DataFrame:
    """Add the ids of the whole text as ``array<int>``: null counts as empty, an empty text has none."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        packed = bpe(path).encode_all(texts)
        offsets = np.cumsum([0, *(len(p) // 4 for p in packed)])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))

    return df.withColumn(name, encode(text_of(text)))


def with_decoded(df: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Add the bytes that ``ids`` stand for; a null list, and a null in a list, stand for none."""

    @F.arrow_udf("binary")
    def decode(lists: pa.Array) -> pa.Array:
        values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        return pa.array([bpe(path).decode(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())

    return df.withColumn(name, decode(F.coalesce(F.array_compact(F.col(ids)), F.array().cast("array<int>"))))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row gives one row, repeated and null ids included; other columns are ignored."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_decoded(with_tokens(docs, path).drop("text"), path)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
