"""Winnowing fingerprints of texts (native: SQL functions only).

Every ``GRAM`` consecutive bytes of the UTF-8 text are hashed, and from every ``w`` consecutive hashes the least is chosen,
the rightmost one of equal hashes. Two texts that share a run of ``GRAM + w - 1`` bytes share a chosen hash. A chosen
hash and its position are held in one 64-bit number: the hash's upper 33 bits, then ``POSITIONS`` minus the position,
so that the least number is the least hash at its rightmost place, and positions can be read back.

The hash moves along the text one byte at a time. SQL functions keep no running state, so each place's hash is taken by one
call over its twelve bytes: a polynomial that neighbouring grams share, built up by doubling from bytes to 2, 4 and 12, was
measured too and costs about twice as much (README), as each step over an array's elements costs more than hashing twelve bytes.
The least of each window comes from log2(w) element-wise minima of an array with itself, shifted by 1, 2, 4, ...;
a long text is taken in blocks of ``BLOCK`` windows, so arrays stay short.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapforge.llm.common import text_of

#: Bytes of a gram, and grams of a window.
GRAM = 12
WINDOW = 16
BLOCK = 1024
POSITIONS = (1 << 31) - 1
#: Documents in an ordered run, about; how many runs there are at most, whose bounds are sent to all tasks; and ids that bounds are taken from.
RUN_DOCS = 2048
RUNS = 1 << 16
BOUND_IDS = 1 << 19
#: The key of a null id, which has runs of its own.
NO_ID = -(1 << 63)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once (an expression named inside a lambda is computed at each step)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _upto(first: Column | int, last: Column) -> Column:
    first = F.lit(first) if isinstance(first, int) else first
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _hashes(data: Column, base: Column) -> Column:
    """The numbers of all grams of ``data``, which lies at ``base`` in its text; data shorter than a gram is one."""
    last = F.greatest(F.octet_length(data) - GRAM, F.lit(0))
    places = F.sequence(F.lit(POSITIONS) - base, F.lit(POSITIONS) - base - last, F.lit(-1))
    return F.transform(places, lambda p, i: F.xxhash64(F.substring(data, i + 1, F.lit(GRAM))).bitwiseAND(F.lit(~POSITIONS)).bitwiseOR(p.cast("long")))


def _minima(numbers: Column, window: int) -> Column:
    def halved(step: int) -> Callable[[Column], Column]:
        return lambda a: F.zip_with(a, F.slice(a, F.lit(1 + step), F.greatest(F.size(a) - step, F.lit(0))), lambda x, y: F.least(x, y))

    step = 1
    while step < window:
        numbers = let(numbers, halved(step))
        step *= 2
    return let(numbers, lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - window + 1, F.lit(0))))


def winnow(data: Column, window: int = WINDOW, block: int = BLOCK) -> Column:
    """The chosen numbers of a binary column, in the order of the text.

    Data with fewer than ``window`` grams is one window, data shorter than a gram is one gram, and empty data has none.
    ``window`` is a power of two.
    """
    if window & (window - 1) or window < 1:
        raise ValueError("window must be a power of two")
    span = GRAM + window - 1

    def long(b: Column) -> Column:
        blocks = F.transform(_upto(0, F.floor((F.octet_length(b) - span) / block).cast("int")), lambda i: F.struct((i * block).alias("base"), F.substring(b, i * block + 1, F.lit(block + span - 1)).alias("data")))
        return F.array_distinct(F.flatten(F.transform(blocks, lambda x: F.array_distinct(_minima(let(x.data, lambda d: _hashes(d, x.base)), window)))))

    def short(b: Column) -> Column:
        return F.when(F.octet_length(b) > 0, F.array(F.array_min(_hashes(b, F.lit(0))))).otherwise(F.array().cast("array<bigint>"))

    return let(data, lambda b: F.when(F.octet_length(b) >= span, long(b)).otherwise(short(b)))


def chosen_hashes(numbers: Column) -> Column:
    """The set of hashes, without their positions."""
    return F.array_distinct(F.transform(numbers, lambda x: F.shiftright(x, 31)))


def positions(numbers: Column) -> Column:
    """Byte positions of the chosen grams."""
    return F.transform(numbers, lambda x: F.lit(POSITIONS) - x.bitwiseAND(F.lit(POSITIONS)))


def prefix(numbers: Column, length: Column, window: int = WINDOW) -> Column:
    """What windows that lie within the first ``length`` bytes have chosen, from the whole text's numbers.

    A number is first chosen either when its gram comes into the window, being less than the one chosen before,
    or when the one chosen before goes out.
    """
    at = lambda x: F.lit(POSITIONS) - x.bitwiseAND(F.lit(POSITIONS))

    def first(a: Column, i: Column) -> Column:
        x, before = F.get(a, i), F.get(a, i - 1)
        return F.when(i == 0, F.lit(0)).when(x < before, at(x) - window + 1).otherwise(at(before) + 1)

    return let(numbers, lambda a: F.filter(a, lambda x, i: first(a, i) <= length - (GRAM + window - 1)))


def splice(left: Column, left_numbers: Column, right: Column, right_numbers: Column, window: int = WINDOW) -> Column:
    """The numbers of ``left`` + ``right`` (binary), each the beginning of a text whose numbers are given.

    Only windows that reach over the seam are hashed anew.
    """
    span, a, b = GRAM + window - 1, F.octet_length(left), F.octet_length(right)
    begin = F.greatest(a - (span - 1), F.lit(0))
    seam = F.concat(F.substring(left, begin + 1, F.lit(span)), F.substring(right, F.lit(1), F.lit(span - 1)))
    seam_numbers = F.transform(winnow(seam, window), lambda x: x - begin)
    moved = F.transform(prefix(right_numbers, b, window), lambda x: x - a)
    own = prefix(left_numbers, a, window)
    none = F.array().cast("array<bigint>")
    whole = a + b >= span
    over = F.when(~whole | (F.octet_length(seam) >= span), seam_numbers).otherwise(none)
    return F.array_distinct(F.concat(F.when(whole & (a >= span), own).otherwise(none), over, F.when(whole & (b >= span), moved).otherwise(none)))


def fingerprint_string(numbers: Column) -> Column:
    """32 hex digits of the sequence of hashes; 'empty' for an empty text."""
    digits = let(F.transform(numbers, lambda x: F.shiftright(x, 31)), lambda h: F.concat(F.hex(F.xxhash64(h)), F.lit("-"), F.hex(F.xxhash64(h, F.lit(1)))))
    return F.when(F.size(numbers) == 0, F.lit("empty")).otherwise(F.lower(digits))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; two empty sets are alike."""
    common = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - common
    return F.when(total == 0, F.lit(1.0)).otherwise(common / total)


def ordered_runs(rows: DataFrame, docs_in_run: int = RUN_DOCS, runs: int = RUNS) -> DataFrame:
    """Add ``run``: 0, 1, ... in the order of (``key``, ``mark``), with about as many rows each.

    Bounds are quantiles of keys, taken from ``BOUND_IDS`` rows about, so gaps and far keys don't matter. An id that fills
    more than a run is one by itself, and is cut by ranges of ``mark`` (a hash of the text, evenly spread). Only rows that
    are the same in id and text can't be told apart and stay together. (Bounds are doubles, so a frequent id over 2^53
    may share its run with ids that round to the same double.)
    """
    n = rows.count()
    parts = max(1, min(runs, -(-n // docs_in_run)))
    some = rows.select("key").sample(min(1.0, BOUND_IDS / max(n, 1)), seed=1)
    shares = [k / parts for k in range(1, parts)] or [0.5]
    found = (some.agg(F.percentile_approx("key", shares, 10 * parts).alias("q")).first()["q"] or []) if parts > 1 else []
    again = {a for a, b in zip(found, found[1:], strict=False) if a == b}
    bounds = sorted({float(x) for x in found} | {float(x + 1) for x in again})
    if bounds:
        place = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="_key", outputCol="_place")
        rows = place.transform(rows.withColumn("_key", F.col("key").cast("double"))).drop("_key")
    else:
        rows = rows.withColumn("_place", F.lit(0))
    rows = rows.withColumn("_place", F.when(F.col("key") == NO_ID, -1).otherwise(F.col("_place").cast("int")))
    sizes = rows.groupBy("_place").agg(F.count(F.lit(1)).alias("_n"), (F.min("key") == F.max("key")).alias("_one"))
    cuts = F.when(F.col("_one"), F.least(F.ceil(F.col("_n") / docs_in_run), F.lit(runs))).otherwise(F.lit(1)).cast("long")
    before = Window.orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_place", cuts.alias("_cuts")).withColumn("_base", F.coalesce(F.sum("_cuts").over(before), F.lit(0)))
    rows = rows.join(F.broadcast(sizes), "_place")  # one row a place, at most 2 * runs
    within = F.floor(F.pmod(F.shiftright("mark", 32) + F.lit(1 << 31), F.lit(1 << 32)) * F.col("_cuts") / F.lit(float(1 << 32)))
    return rows.withColumn("run", (F.col("_base") + within).cast("long")).drop("_place", "_cuts", "_base")


def with_next(docs: DataFrame, docs_in_run: int = RUN_DOCS, runs: int = RUNS) -> DataFrame:
    """doc_id, text, numbers and next_text, next_numbers of the next row by doc_id; the last row's next is the first.

    doc_id is a whole number of up to 64 bits, null first; rows with one doc_id follow each other by a hash of their texts, then by
    text. Rows are dealt into ordered runs, and each run also gets the first row of the run after it. Texts are shuffled once.
    """
    key, mark = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64(text_of("text"))
    rows = ordered_runs(docs.select("doc_id", text_of("text").alias("text"), key.alias("key"), mark.alias("mark")), docs_in_run, runs)
    firsts = rows.groupBy("run").agg(F.min("key").alias("key"))
    firsts = rows.select("run", "key", "mark").join(F.broadcast(firsts), ["run", "key"]).groupBy("run", "key").agg(F.min("mark").alias("mark"))
    before = F.coalesce(F.lag("run").over(Window.orderBy("run")), F.max("run").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    hosts = F.broadcast(firsts.select("run", "key", "mark", before.alias("host")))  # one row a run: at most 3 * runs
    guests = rows.join(hosts, ["run", "key", "mark"]).groupBy("host").agg(F.min(F.struct("text", "doc_id", "key", "mark")).alias("g"))
    guests = guests.select("g.doc_id", "g.text", "g.key", "g.mark", F.col("host").alias("run"), F.lit(1).alias("guest"))
    dealt = rows.withColumn("guest", F.lit(0)).unionByName(guests).repartition("run")
    ordered = Window.partitionBy("run").orderBy("guest", "key", "mark", "text")
    dealt = dealt.withColumn("numbers", winnow(F.col("text").cast("binary")))
    dealt = dealt.withColumn("next_text", F.lead("text").over(ordered)).withColumn("next_numbers", F.lead("numbers").over(ordered))
    return dealt.filter("guest = 0").drop("guest", "key", "mark", "run")


def fingerprints_of_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, its edited text's, and how alike it is to that and to the next document's.

    The edited text's last floor(n_chars / 2) characters are replaced by the next document's first as many. A null
    text counts as empty; empty texts have an empty fingerprint, alike (1) only to another empty one. Rows with
    one doc_id follow each other by a hash of the text, a null doc_id comes first, and an only row is its own next. Other
    columns are ignored, and an empty table gives an empty result.
    """
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    left, right = F.left("text", F.col("n_chars").cast("int") - half), F.left("next_text", half)
    rows = rows.withColumn("left", left.cast("binary")).withColumn("right", right.cast("binary"))
    rows = rows.withColumn("edited_numbers", splice(F.col("left"), F.col("numbers"), F.col("right"), F.col("next_numbers")))
    sets = rows.select("doc_id", "n_chars", F.sha2(F.concat("left", "right"), 256).alias("edited_sha256"), "numbers", "edited_numbers",
                       *[chosen_hashes(F.col(c)).alias(f"set_{c}") for c in ("numbers", "edited_numbers", "next_numbers")])
    return sets.select("doc_id", "n_chars", "edited_sha256", fingerprint_string(F.col("numbers")).alias("fingerprint"), fingerprint_string(F.col("edited_numbers")).alias("edited_fingerprint"),
                       likeness(F.col("set_numbers"), F.col("set_edited_numbers")).alias("near_edited"), likeness(F.col("set_numbers"), F.col("set_next_numbers")).alias("near_next"))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_of_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
