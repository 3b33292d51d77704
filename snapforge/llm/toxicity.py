"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on words of toxic documents and one on words of ordinary documents. A
document's windows (words) are compressed with either. Differences of the lengths below a threshold, set on training
documents, are one class; above it, each is a class. A class weighs the log ratio of its rates in toxic and in
ordinary documents. A logistic curve, fitted on training documents, turns a document's sum into a score with the threshold at one half.

zstandard's headers outweigh a word's few bytes, so a window is written out first: every six consecutive characters
become four bytes of a hash. Text that one dictionary knows then shrinks by tens of bytes, other text not at all.
Dictionaries of plain text and windows of several words were tried and can't tell these documents apart: a toxic word is one
of hundreds, and saves no more bytes than a lucky match of ordinary syllables (README has figures).
The toxic dictionary is trained on words of toxic documents that hold character sequences met there far more often than
in ordinary documents; else it would fill up with common syllables.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapforge.llm.common import text_of, write_table

CONTEXT = 6
GRAM = 7
#: Labelled documents of each class that training reads, at most: those least by a hash of the id.
TRAIN_DOCS = 4000
#: A character sequence is telling when it is met at so many times ordinary documents' rate, and a likelihood-ratio test gives so much.
GRAM_RATIO, GRAM_TEST = 6.0, 20.0
#: Differences count from the least one that toxic documents' windows reach or exceed so many times as often as others'.
TAIL_RATIO = 10.0
#: Samples that a dictionary's training gets at least, by repetition.
SAMPLES = 20_000
TOXIC_BYTES, ORDINARY_BYTES = 8192, 32768
#: Differences are cut off at this number of bytes either way.
REACH = 40
LONG = 64
CACHE = 150_000
_PAD = "\x02" * (CONTEXT - 1)


def windows(text: str) -> list[str]:
    """Lower-cased words; a longer one is taken in parts of ``LONG`` characters."""
    words = text.lower().split()
    if max(map(len, words), default=0) <= LONG:
        return words
    return [w[i : i + LONG] for w in words for i in range(0, len(w), LONG)]


def expand(window: str, memo: dict[str, bytes]) -> bytes:
    padded, out = f"{_PAD}{window}\x03", []
    for i in range(len(padded) - CONTEXT + 1):
        gram = padded[i : i + CONTEXT]
        code = memo.get(gram)
        if code is None:
            code = xxhash.xxh32_digest(gram.encode("utf-8", "surrogatepass"))
            if len(memo) < CACHE:
                memo[gram] = code
        out.append(code)
    return b"".join(out)


@dataclass(frozen=True)
class ToxicityModel:
    """Dictionaries, weights of the classes of differences, and the logistic curve; a few tens of kB in all."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...] = ()
    slope: float = 1.0
    intercept: float = 0.0

    @cached_property
    def _tools(self):
        def compressor(content: bytes):
            options = zstandard.ZstdCompressionParameters.from_level(1, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, min_match=7)
            words = zstandard.ZstdCompressionDict(content) if content else None
            return zstandard.ZstdCompressor(dict_data=words, compression_params=options).compress

        return compressor(self.toxic), compressor(self.ordinary), {}, {}

    def classes(self, text: str) -> list[int]:
        """Each window's compressed length with the ordinary less that with the toxic dictionary, from 0 to 2 * REACH."""
        toxic, ordinary, memo, known = self._tools
        words = windows(text)
        new = {w for w in words if w not in known}
        if len(known) + len(new) > CACHE:
            known.clear()
            new = set(words)
        for w in new:
            data = expand(w, memo)
            known[w] = min(max(len(ordinary(data)) - len(toxic(data)), -REACH), REACH) + REACH
        return list(map(known.__getitem__, words))

    def evidence(self, text: str) -> float:
        found = np.bincount(np.array(self.classes(text), np.int64), minlength=2 * REACH + 1)
        return float(found @ np.array(self.weights))

    def score(self, text: str) -> float:
        x = self.slope * self.evidence(text) + self.intercept
        return 1 / (1 + math.exp(-min(max(x, -500.0), 500.0)))

    def __getstate__(self):  # compressors are built anew in each worker
        return {k: v for k, v in self.__dict__.items() if k != "_tools"}


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; what room training leaves is filled with samples that it misses, the most frequent last.

    ``samples`` come most frequent first. Content may follow a trained dictionary, whose header comes first.
    """
    try:
        base = zstandard.train_dictionary(size, samples, k=64, d=8, level=3).as_bytes()
    except zstandard.ZstdError:  # too few samples
        base = b""
    more, room = [], size - len(base)
    for sample in dict.fromkeys(samples):
        if len(sample) > room:
            break
        if sample not in base:
            more.append(sample)
            room -= len(sample)
    return base + b"".join(reversed(more))


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on x by Newton's method, lightly regularised, so separable data end too."""
    scale = max(float(np.abs(x).std()), 1e-9)
    a, b = 0.0, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    z = x / scale
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w, r = p * (1 - p), p - y
        hessian = np.array([[w @ z**2 + 1e-2, w @ z], [w @ z, w.sum() + 1e-6]])
        step = np.linalg.solve(hessian, [r @ z + 1e-2 * a, r.sum()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return a / scale, b


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, text, toxic of the training documents: at most ``limit`` of each class, none held out."""
    known = labels.select(F.col("doc_id").alias("label_id"), "toxic").filter(F.col("toxic").isin(0, 1) & ~held_out("label_id"))
    pick = known.withColumn("draw", F.md5(F.col("label_id").cast("string")))
    chosen = pick.filter("toxic = 0").orderBy("draw", "label_id").limit(limit).unionByName(pick.filter("toxic = 1").orderBy("draw", "label_id").limit(limit))
    return docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> ToxicityModel:
    """Fit dictionaries, weights and curve. Texts stay on the executors; the training rows' distinct words, which ``limit`` bounds, and sums reach the driver.

    Without training documents of both classes, the model scores every document 0 or 1, as its class is.
    """
    rows = training_rows(docs, labels, limit).persist()
    try:
        return _fit(rows)
    finally:
        rows.unpersist()


def _fit(rows: DataFrame) -> ToxicityModel:
    """The model of training ``rows`` (toxic, text), which are read several times."""
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_ordinary = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_ordinary:
        return ToxicityModel(b"", b"", (0.0,) * (2 * REACH + 1), 0.0, 30.0 if n_toxic else -30.0)

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(set(windows(t.as_py()))) for t in texts], pa.list_(pa.string()))

    @F.arrow_udf("array<string>")
    def grams(texts: pa.Array) -> pa.Array:
        padded = (f"{_PAD}{t.as_py()}\x03" for t in texts)
        return pa.array([sorted({p[i : i + GRAM] for i in range(len(p) - GRAM + 1)}) for p in padded], pa.list_(pa.string()))

    counts = rows.select("toxic", F.explode(split("text")).alias("word")).groupBy("word").agg(F.sum("toxic").alias("in_toxic"), F.sum(1 - F.col("toxic")).alias("in_ordinary"))
    counts = write_table(counts, "toxicity-words")  # bounded by the training rows
    per_gram = counts.select("word", "in_toxic", "in_ordinary", F.explode(grams("word")).alias("gram")).groupBy("gram").agg(F.sum("in_toxic").alias("in_toxic"), F.sum("in_ordinary").alias("in_ordinary"))
    a, b = F.col("in_toxic"), F.col("in_ordinary")
    rate, share = (a / n_toxic) / ((b + 1) / (n_ordinary + 1)), (a + b) / (n_toxic + n_ordinary)
    test = 2 * (a * F.log(a / (share * n_toxic)) + F.when(b > 0, b * F.log(b / (share * n_ordinary))).otherwise(0))
    telling = per_gram.filter((a > 0) & (rate >= GRAM_RATIO)).select("gram", test.alias("test")).filter(F.col("test") >= GRAM_TEST)
    toxic_words = counts.filter("in_toxic > 0").select("word", "in_toxic", F.explode(grams("word")).alias("gram")).join(telling, "gram", "left_semi").groupBy("word").agg(F.max("in_toxic").alias("n"))
    toxic_words = toxic_words.orderBy(F.desc("n"), "word").collect()
    ordinary_words = counts.filter("in_ordinary > 0").orderBy(F.md5("word"), "word").collect()
    memo: dict[str, bytes] = {}
    scale = SAMPLES / max(1, sum(r["n"] for r in toxic_words))
    toxic = train_dictionary([expand(r["word"], memo) for r in toxic_words for _ in range(max(1, round(scale * r["n"])))], TOXIC_BYTES)
    ordinary = train_dictionary([expand(r["word"], memo) for r in ordinary_words], ORDINARY_BYTES)
    draft = ToxicityModel(toxic, ordinary)

    @F.arrow_udf("array<bigint>")
    def histogram(texts: pa.Array) -> pa.Array:
        return pa.array([np.bincount(np.array(draft.classes(t.as_py()), np.int64), minlength=2 * REACH + 1) for t in texts], pa.list_(pa.int64()))

    found = rows.select("toxic", histogram("text").alias("h")).collect()  # 2 * limit rows of 81 numbers
    h, y = np.array([r["h"] for r in found], np.float64), np.array([r["toxic"] for r in found], np.float64)
    rates = [(h[y == c].sum(axis=0) + 1) / (h[y == c].sum() + h.shape[1]) for c in (1, 0)]
    tails = [np.cumsum(r[::-1])[::-1] for r in rates]
    above = np.arange(h.shape[1]) >= next((d for d in range(REACH, h.shape[1]) if tails[0][d] >= TAIL_RATIO * tails[1][d]), REACH)
    weights = np.where(above, np.log(rates[0] / rates[1]), np.log(rates[0][~above].sum() / rates[1][~above].sum()))
    slope, intercept = fit_curve(h @ weights, y)
    return ToxicityModel(toxic, ordinary, tuple(weights.tolist()), slope, intercept)


def with_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", name: str = "toxicity") -> DataFrame:
    """Add the score of the whole text, from 0 to 1; a null or empty text is scored without evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the dictionaries' sizes

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(t.as_py()) for t in texts], pa.float64())

    return docs.withColumn(name, score(text_of(text)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row gives one row, repeated and null ids included (a null id isn't held out); other columns are ignored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = with_toxicity(docs, model, name="score").drop("text")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
