"""Alignment of tokenizers, repeated windows and periodic runs against brute force; every query on the small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from snapforge.llm import alignment, catalogue, periodic_runs, repeated_windows, sharding, toxicity, url_filter

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, KEY string, places string, _row int, removed string, found int"
ODD = [None, "", " ", "  \n", "a", " a", "a ", "a  b", "x\n y", "one\ttwo three", "▁ x", "<|endoftext|> <s> <0x41>", "é日😀 \x1c\xa0x", "naïve’s  end\r\n", "a\u2003 b", "tail\n"]


def frame(spark, texts, first=0):
    rows = [(first + i, t, "k", "p", 1, "r", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


# 11

def aligned_by_hand(texts):
    """Each text's (tokens of A, of B, groups, links), by whole texts and one walk over both."""
    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    names, chars = {i: t for t, i in a_model.get_vocab().items()}, alignment.byte_of_char()
    out = []
    for text in texts:
        a, b = a_model.encode(" " + (text or ""), add_special_tokens=False).ids, b_model.encode(text or "")
        a_bytes = [bytes(chars[c] for c in names[i]) for i in a]
        b_bytes = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            out.append((0, 0, [], []))
            continue
        groups, links, one, two, ends = [], [], [], [], [0, 0]
        i = j = 0
        while i < len(a) or j < len(b):
            if ends[0] <= ends[1] and i < len(a):
                one.append(a[i])
                ends[0] += len(a_bytes[i])
                i += 1
            else:
                two.append(b[j])
                ends[1] += len(b_bytes[j])
                j += 1
            if ends[0] == ends[1]:
                groups.append((one, two))
                links.append((one[-1], two[-1]))
                one, two = [], []
        out.append((len(a), len(b), groups, links))
    return out


def digest(groups):
    return hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if groups else ""


def expected(texts):
    docs = aligned_by_hand(texts)
    counts, highest = Counter(link for d in docs for link in d[3]), {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    return [(d[0], d[1], len(d[2]), len(d[3]), sum(counts[x] == highest[x[1]] for x in d[3]), sum(counts[x] for x in d[3]), digest(d[2])) for d in docs]


def found_rows(frame_):
    return [tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in frame_.orderBy("doc_id").collect()]


@pytest.mark.parametrize("pairs", [0, alignment.PAIRS])
def test_alignment_in_chunks_equals_whole_texts(spark, pairs):
    """Chunks of 64 bytes are composed in several rounds; counts come back by broadcast or by shuffle."""
    r = random.Random(0)
    pools = ["abc de fgh ij", "the cat  sat, ", "\n\t ", "éß中😀’", "<s>09½", " "]
    texts = ODD + ["".join(r.choice(r.choice(pools)) for _ in range(r.randrange(1500))) for _ in range(30)] + ["x" * 3000, "nospace" * 300 + "▁ bad"]
    aligned = alignment.write_table(alignment.align(frame(spark, texts), A, B, size=64), "aligned")
    assert found_rows(alignment.with_counts(aligned, pairs)) == expected(texts)


def test_alignment_of_long_texts_writes_row_groups_of_bounded_bytes(spark, monkeypatch):
    """Also where texts compress well: what a task decodes at once is bounded, however many chunks there are."""
    files, write = {}, alignment.write_table
    monkeypatch.setattr(alignment, "ROW_GROUP", 1 << 14, raising=False)

    def recorded(df, name, **options):
        written = write(df, name, **options)
        files.setdefault(name, []).extend(f.removeprefix("file://") for f in written.inputFiles())
        return written

    monkeypatch.setattr(alignment, "write_table", recorded)
    r = random.Random(2)
    texts = [" ".join(r.choice(["the cat", "sat.", "on", "naïve mats"]) for _ in range(2000 + 100 * i)) for i in range(40)]
    aligned = alignment.write_table(alignment.align_long(frame(spark, texts), A, B, size=512), "aligned")
    assert found_rows(alignment.with_counts(aligned)) == expected(texts)
    for name in ("chunks", "fragments"):
        groups = [m.row_group(k).total_byte_size for f in files[name] for m in [pq.ParquetFile(f).metadata] for k in range(m.num_row_groups)]
        assert sum(groups) > 1 << 18 and max(groups) < 1 << 15, name


def test_fragments_compose_however_they_are_cut():
    """Of any cut of the tokens' ends into stretches, in any association."""
    r, of = random.Random(1), alignment.Tokenizers(A, B)
    for _ in range(30):
        text = " ".join("".join(r.choice("abcdeéß中,.'") for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(1, 20)))
        ((a, b),) = of.tokens([text])
        a_ends, b_ends = np.cumsum(of.a_sizes[a]).tolist(), np.cumsum(of.b_sizes[b]).tolist()
        cuts = sorted({0, a_ends[-1], *(r.randrange(1, a_ends[-1] + 1) for _ in range(r.randrange(6)))})
        parts = []
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            own = lambda ids, ends: zip(*[(i, e) for i, e in zip(ids, ends, strict=True) if low < e <= high], strict=True)  # noqa: B023, E731
            (x, xe), (y, ye) = (tuple(map(list, own(*s))) or ([], []) for s in ((a, a_ends), (b, b_ends)))
            parts.append(alignment.fragment(x, xe, y, ye))
        while len(parts) > 1:
            k = r.randrange(len(parts) - 1)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        whole = of.fragment(a, b)
        assert parts[0].all_groups() == whole.all_groups() and b"".join(parts[0].links) == b"".join(whole.links)
        assert parts[0] + alignment.Fragment() == parts[0]


def test_alignment_of_nulls_repeats_and_nothing(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "a b"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = alignment.with_counts(alignment.write_table(alignment.align(docs, A, B), "aligned")).collect()
    assert sorted((r["doc_id"] or 0, r["n_a"], r["count_sum"]) for r in found) == [(0, 2, 6), (1, 2, 6), (1, 2, 6), (2, 0, 0)]
    assert alignment.with_counts(alignment.write_table(alignment.align(docs.limit(0), A, B), "aligned")).count() == 0


# 12

def removed_by_hand(rows, window):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in split:
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return out


@pytest.mark.parametrize("block", [50, repeated_windows.BLOCK])
def test_repeated_windows_by_hand(spark, monkeypatch, block):
    """Small blocks and ranges, copies, overlaps, words in another order, one word over and over, and a long text."""
    monkeypatch.setattr(repeated_windows, "BLOCK", block)
    monkeypatch.setattr(repeated_windows, "RANGE", 500)
    r = random.Random(2)
    shared = [" ".join(r.choice("abcdefgh") * r.randrange(1, 4) for _ in range(30)) for _ in range(4)]
    texts = ODD + [" ".join(r.choice([*shared, *"xyzuvw"]) for _ in range(r.randrange(12))) for _ in range(60)] + ["w " * 200, "w\n" * 90, " ".join(["q"] * 20000), "a b " * 40, "b a " * 40]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "k", "p", 1, "r", 2) for i, t in rows], SCHEMA).repartition(5)
    found = repeated_windows.without_repeats(docs, window=10).collect()
    assert sorted((r_["doc_id"], *r_["kept"]) for r_ in found) == sorted(removed_by_hand(rows, 10))
    assert {r_["removed"] for r_ in found} == {"r"} and sum(r_["kept"]["n_removed"] > 0 for r_ in found) > 5


def test_repeated_windows_of_null_and_repeated_ids(spark):
    text = " ".join(map(str, range(60)))
    docs = spark.createDataFrame([(5, text), (5, text), (5, text + " more"), (7, text), (None, text[:-3])], "doc_id bigint, text string")
    found = sorted((r["doc_id"] or -1, r["kept"]["n_words"], r["kept"]["n_removed"]) for r in repeated_windows.without_repeats(docs).collect())
    assert found == [(-1, 59, 0), (5, 60, 59), (5, 60, 59), (5, 61, 59), (7, 60, 60)]
    spans = repeated_windows.with_intervals(docs, name="spans").filter("doc_id = 7").first()["spans"]
    assert [tuple(s) for s in spans] == [(0, 60)]
    assert repeated_windows.without_repeats(docs.limit(0)).count() == 0


# 13

def runs_by_hand(words, least):
    n, out = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, 2 * p):
                out.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted(((s, n_, p) for (s, n_), p in out.items()), key=lambda x: (x[0], x[2]))


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_by_hand(least):
    r, docs = random.Random(least), []
    for _ in range(600):
        words = [r.randrange(r.choice([1, 2, 3, 5])) for _ in range(r.randrange(70))]
        if r.random() < 0.5 and len(words) > 4:
            p, s = r.randrange(1, 12), r.randrange(len(words))
            for i in range(s + p, len(words)):
                words[i] = words[i - p]
        docs.append(words)
    found = periodic_runs.find_runs([np.array(d, np.int32) for d in docs], least)
    assert found == [runs_by_hand(d, least) for d in docs]


def test_runs_of_many_left_words_and_long_texts(monkeypatch):
    r = random.Random(3)
    words = []
    for _ in range(60):
        words += [r.randrange(10, 40), *([1, 2] * r.randrange(3, 9))]
    for few in (0, 8):
        monkeypatch.setattr(periodic_runs, "FEW", few)
        assert periodic_runs.find_runs([np.array(words, np.int32)]) == [runs_by_hand(words, 12)]
    assert periodic_runs.find_runs([np.zeros(100_000, np.int32)]) == [[(0, 100_000, 1)]]


def test_run_columns(spark):
    texts = [*ODD, "a b " * 10 + "c", "x " * 12]
    docs = frame(spark, texts)
    found = {r["doc_id"]: r["found"] for r in periodic_runs.with_runs(docs).collect()}
    assert len(found) == len(texts)
    n = len(ODD)
    assert [tuple(x) for x in found[n]["runs"]] == [(0, 20, 2)] and found[n]["text"] == "a b c" and found[n]["n_words"] == 21
    assert [tuple(x) for x in found[n + 1]["runs"]] == [(0, 12, 1)] and found[n + 1]["text"] == "x"
    assert found[0]["n_words"] == 0 and found[0]["text"] == ""
    assert periodic_runs.with_runs(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "y " * 20), (None, "y " * 20)], "doc_id bigint, text string")
    assert [r["found"]["text"] for r in periodic_runs.with_runs(nulls).collect()] == ["y", "y"]


def test_op13_by_hand(spark):
    found = {r["doc_id"]: tuple(r) for r in periodic_runs.op13_periodic_runs(spark, SF).collect()}
    for row in pq.read_table(f"{SF}/documents.parquet").to_pylist():
        words = row["text"].encode().split()
        h, n = zlib.crc32(str(row["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs, gone = runs_by_hand(words, 12), set()
        for s, size, p in runs:
            gone.update(range(s + p, s + size))
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        lines = "".join(f"{s},{size},{p}\n" for s, size, p in runs)
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        assert found[row["doc_id"]] == (row["doc_id"], len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


# All

def test_slots_with_clashing_columns(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(10)], "id int, shard int").selectExpr("*", "1 AS _first", "2 AS _n", "3 AS _run")
    found = sharding.number_slots(rows, "id", ["id"]).collect()
    assert sorted((r["shard"], r["slot"]) for r in found) == [(s, k) for s in (0, 1) for k in range(5)] and {r["_first"] for r in found} == {1}


def test_op11_by_hand(spark):
    texts = [r["text"] for r in pq.read_table(f"{SF}/documents.parquet").sort_by("doc_id").to_pylist()]
    assert found_rows(catalogue.QUERIES["op11_alignment"](spark, SF)) == expected(texts)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    wanted = c.execute(catalogue.ORACLE_SQL[name])
    names = [x[0] for x in wanted.description]
    found = catalogue.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(repr, map(tuple, found.select(*names).collect()))) == sorted(map(repr, wanted.fetchall()))


def slow_suffix(host, rules):
    """Public suffix by the format's own description."""
    labels = host.rsplit(":", 1)[0].split(".") if host.rsplit(":", 1)[-1].isdigit() else host.split(".")
    if host.startswith("[") or all(part.isdigit() for part in labels):
        return ".".join(labels)
    fits = []
    for rule in rules:
        parts = rule.lstrip("!").split(".")
        tail = labels[-len(parts):]
        if len(tail) == len(parts) and all(r in ("*", x) for r, x in zip(parts, tail, strict=True)):
            fits.append((rule.startswith("!"), len(parts)))
    n = max((length - 1 if but else length for but, length in fits if but or not any(b for b, _ in fits)), default=1)
    return ".".join(labels[-n:])


def test_suffixes_from_a_table(spark, tmp_path):
    (tmp_path / "suffixes.txt").write_text("// public\ncom\nco.uk\n*.ck  note\n!www.ck\n\ngithub.io\nGOV.br\na.b.c.d\n")
    rules = url_filter.read_suffixes(spark, str(tmp_path / "suffixes.txt"))
    assert set(rules) == {"com", "co.uk", "*.ck", "!www.ck", "github.io", "gov.br", "a.b.c.d"}
    hosts = ["", "com", "x.com", "y.x.com:80", "co.uk", "x.co.uk", "z.x.co.uk", "ck", "foo.ck", "x.foo.ck", "www.ck", "a.www.ck", "foo.github.io", "x.gov.br", "1.2.3.4", "1.2.3.4:8080",
             "x.a.b.c.d", "b.c.d", "un.known"]
    found = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", url_filter.suffix_of(F.col("host"), rules).alias("s"), url_filter.domain_of(F.col("host"), rules).alias("d")).collect()
    for r in found:
        assert r["s"] == slow_suffix(r["host"], rules), r
        bare = r["host"].split(":")[0]
        assert r["d"] in (r["s"], bare) or r["d"].split(".", 1)[1] == r["s"], r
    assert {r["host"]: r["d"] for r in found}["z.x.co.uk"] == "x.co.uk"
    with pytest.raises(ValueError):
        url_filter.read_suffixes(spark, str(tmp_path / "suffixes.txt"), most=3)


def test_scores_come_from_the_two_compressors(spark):
    """Each score again from the model's dictionaries, window by window."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    scored = toxicity.with_toxicity(docs.select("doc_id", "text"), model).collect()
    options = zstandard.ZstdCompressionParameters.from_level(1, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, min_match=7)
    size = lambda content, data: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content), compression_params=options).compress(data))
    for r in scored:
        total = 0.0
        for w in toxicity.windows(r["text"] or ""):
            data = toxicity.expand(w, {})
            difference = size(model.ordinary, data) - size(model.toxic, data)
            total += model.weights[min(max(difference, -toxicity.REACH), toxicity.REACH) + toxicity.REACH]
        assert math.isclose(r["toxicity"], 1 / (1 + math.exp(-(model.slope * total + model.intercept))), rel_tol=1e-9, abs_tol=1e-12)
