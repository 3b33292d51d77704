"""Each operator on edge cases, against brute force, exact round trips or the libraries that it has to equal."""

import hashlib
import random
import re
import time
import zlib
from html import unescape

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from snapforge.llm import byte_bpe, chat, common, components, exact_dedup, html_text, near_copies, packing, sharding, simhash, toxicity, url_filter, winnowing

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", "  \n", "a", "One two three four five six.", "one  two three four five six.", "é日😀 \x1c\xa0x", "word " * 3000, "x" * 5000, "One two three four five six."]
SCHEMA = "doc_id bigint, text string, DIGEST string, slot int, run int, fp string, ids string, score string, best string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "d", 1, 2, "f", "i", "s", "b") for i, t in enumerate(TEXTS)] + [(None, "null id", None, None, None, None, None, None, None), (3, "a", "d", 1, 2, "f", "i", "s", "b")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def text_by_id(d):
    return [(r["doc_id"], r["text"] or "") for r in d.collect()]


# 1

def test_bpe_equals_tiktoken_and_decodes(docs, empty):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    found = byte_bpe.with_decoded(byte_bpe.with_tokens(docs, RANKS, name="tokens"), RANKS, "tokens", "back").collect()
    assert len(found) == docs.count()
    for r in found:
        assert r["tokens"] == encoding.encode_ordinary(r["text"] or "")
        assert bytes(r["back"]) == (r["text"] or "").encode()
    assert byte_bpe.with_tokens(empty, RANKS, name="tokens").count() == 0


def test_bpe_on_random_texts():
    model, r = byte_bpe.ByteBPE(RANKS), random.Random(0)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=model.ranks, special_tokens={})
    pools = [" \t\n\r\x0b\x1c\x85\xa0\u2003", "abXY'sdm", "09½", "!?<|>_-", "éß中本😀\u0301\u200d"]
    texts = ["".join(r.choice(r.choice(pools)) for _ in range(r.randrange(60))) for _ in range(2000)] + ["<|endoftext|>", " " * 5000]
    for t, ids in zip(texts, model.encode(texts), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == encoding.encode_ordinary(t)


def test_bpe_refuses_ids_outside_the_vocabulary(spark):
    model = byte_bpe.ByteBPE(RANKS)
    for bad in (-1, len(model.tokens)):
        with pytest.raises(ValueError, match="must lie"):
            model.decode(np.array([0, bad]))
    lists = spark.createDataFrame([([1, None, 2],), (None,), ([],)], "ids array<int>")
    found = [bytes(r["decoded"]) for r in byte_bpe.with_decoded(lists, RANKS).collect()]
    assert found == [model.decode(np.array([1, 2])), b"", b""]


def test_bpe_needs_whole_vocabularies():
    with pytest.raises(ValueError, match="gaps"):
        byte_bpe.serialise_model({b"a": 1})
    with pytest.raises(ValueError, match="byte"):
        byte_bpe.serialise_model({b"a": 0})


# 2

def test_shards_follow_key_and_count(spark, docs, empty):
    found = sharding.shard_documents(docs).toPandas()
    assert len(found) == docs.count()
    for _, g in found.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert ((found["grown_shard"] == found["shard"]) | (found["grown_shard"] == 16)).all()
    sizes = sorted(len((t or "").encode()) + 1 for _, t in text_by_id(docs))
    assert sorted(found["size"]) == sizes
    assert sharding.shard_documents(empty).count() == 0
    many = spark.range(20000).select(F.col("id").alias("doc_id"))
    shares = dict(sharding.assign_shards(many, "doc_id", {0: 1.0, 1: 3.0}).groupBy("shard").count().collect())
    assert shares[1] / 20000 == pytest.approx(0.75, abs=0.02)


# 3

def test_escapes_are_reversible():
    r = random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice(["\\", *chat.CONTROLS, "<", "/", "a"]) for _ in range(r.randrange(9)))
        assert chat.unescape(chat.escape(t)) == t


def test_chats_read_back(spark):
    rows = [(1, 0, "user", r"\<turn> hi"), (1, 1, "assistant", "</turn>\\"), (1, 2, "assistant", None), (1, 2, "assistant", None), (2, None, None, "x"), (None, 0, "assistant", "n")]
    found = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), RANKS), RANKS).collect()}
    assert [(t["role"], t["text"]) for t in found[1]["back"]["turns"]] == [("user", r"\<turn> hi"), ("assistant", "</turn>\\"), ("assistant", ""), ("assistant", "")]
    assert found[1]["back"]["loss_text"] == "</turn>\\"
    assert found[2]["back"]["loss_text"] == ""
    assert found[None]["back"]["loss_text"] == "n"
    assert chat.format_conversations(spark.createDataFrame([], "conv_id int, turn int, role string, text string"), RANKS).count() == 0


def test_chats_with_long_texts_and_clashing_columns(spark):
    long = "a <turn> b " * 50_000
    rows = spark.createDataFrame([(1, 0, "user", "hi", 1, 2, "x"), (1, 1, "assistant", long, 1, 2, "x")], "conv_id int, turn int, role string, text string, ids int, turns int, CHAT string")
    found = chat.read_back(chat.format_conversations(rows, RANKS), RANKS).collect()
    assert [t["text"] for t in found[0]["back"]["turns"]] == ["hi", long] and found[0]["back"]["loss_text"] == long


# 4

def test_toxicity_learns_and_holds_out(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice(["ta", "ri", "mo", "el", "sun", "ka"]) for _ in range(r.randrange(1, 5)))
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = [word() for _ in range(40)]
        if toxic:
            words[r.randrange(40)] = r.choice(["wretched", "vermin", "dimwit"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (9001, None), (9002, "x" * 100_000)], "doc_id bigint, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    scored = toxicity.with_toxicity(docs, model).toPandas()
    held = scored[[zlib.crc32(str(i).encode()) % 5 == 0 and i < 600 for i in scored["doc_id"]]]
    assert ((held["toxicity"] >= 0.5) == (held["doc_id"] % 4 == 0)).mean() > 0.97
    assert scored["toxicity"].between(0, 1).all()


def test_toxicity_of_repeats_and_clashing_columns(spark):
    rows = [(i % 7, "some words of vermin" if i % 7 < 2 else "some words of nothing else") for i in range(60)] + [(None, "vermin"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("toxic", F.lit("own")).withColumn("TEXT_", F.lit(1))
    labels = spark.createDataFrame([(i, int(i < 2)) for i in range(7)] * 2 + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    scored = toxicity.with_toxicity(docs, toxicity.train(docs, labels), name="score")
    assert scored.columns == [*docs.columns, "score"] and scored.count() == 62
    assert all(len({r["score"] for r in scored.collect() if r["doc_id"] == i}) == 1 for i in range(7))


def test_toxicity_without_labels(spark, docs, empty):
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert toxicity.with_toxicity(docs, model).filter("toxicity >= 0.5").count() == 0
    assert toxicity.with_toxicity(empty, model).count() == 0


# 5

PAGE = """<html><head><title>t</title></head><body><header><p>Site, name.</p></header><nav><a href=x>Home</a></nav><div class="cookie-notice"><p>We, use.</p></div>
<main><h1>Title</h1><p>First, para &amp; text.<p>Second <b>bold</b>, text.</p><ul><li>One item.<li>Two</ul><div class=ad>Buy, now!</div><form><label>Mail</label></form></main>
<aside>Side, bar.</aside><section id="comments"><p>Nice, text.</p></section><footer>end</footer>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title\nFirst, para & text.\nSecond bold, text.\nOne item.\nTwo"
    assert html_text.main_text("") == ""
    assert html_text.main_text("plain &lt; text") == "plain < text"
    assert html_text.main_text("<script>a</script><nav>b</nav>") == ""
    assert html_text.main_text("<" * 3000 + "a'" * 3000) != ""


def test_main_text_keeps_the_whole_article():
    many = "".join(f"<p>Paragraph {i}, with some more words, and an end.</p>" for i in range(40))
    lines = html_text.main_text(f"<body><article><h1>T</h1><p class=lead>A lead, short.</p><div class=body>{many}<ul><li><a href=x>One reference</a></ul></div></article></body>").split("\n")
    assert lines[:2] == ["T", "A lead, short."] and lines[-1] == "One reference" and len(lines) == 43
    for wrapper in ("<div class='content with-sidebar'>", "<div id=social>", "<form action=x>"):
        page = html_text.main_text(f"<body>{wrapper}{many}<div class=sidebar>Side, bar.</div></div></form></body>")
        assert len(page.split("\n")) == 40 and "Side" not in page


def article_of(html):
    """The reference for the given pages: their article element, cut at block tags by hand."""
    inner = re.search(r"<article>(.*?)</article>", html, re.DOTALL)
    lines = re.split(r"</?(?:p|h1|div|ul|li)>", re.sub(r"<br>|<hr>", " ", inner[1])) if inner else []
    plain = (" ".join(unescape(re.sub(r"</?b>", "", x)).split()) for x in lines)
    return "\n".join(x for x in plain if x)


def test_main_text_of_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert len(pages) > 200
    assert [html_text.main_text(p["html"]) for p in pages] == [article_of(p["html"]) for p in pages]


def test_ratios_decide_without_articles(monkeypatch):
    """Pages of div elements alone, whose names say nothing: only lengths, punctuation and links tell text from the rest."""
    monkeypatch.setattr(html_text, "_NAMED", frozenset())
    body = "".join(f"<p>Paragraph {i}, with some more words, and an end.</p>" for i in range(12))
    page = f"<body><div class=x1><a href=a>Home</a> <a href=b>News</a></div><div class=x2>Buy now</div><div class=x3><div class=x4>{body}</div></div><div class=x5>All rights reserved</div></body>"
    text = html_text.main_text(page).split("\n")
    assert len(text) == 12 and len(html_text.blocks(page)[1]) == 15
    assert html_text.main_text(f"<footer>{body * 20}</footer><main><p>Skip</p></main>") == "Skip"


ARTICLE = "".join(f"<p>Paragraph {i}, with some more words, and an end of it.</p>" for i in range(8))
REMARKS = "".join(f"<p>Great post number {i}, thanks a lot, really!</p>" for i in range(10))


@pytest.mark.parametrize("name", "comments replies responses discussion Kommentare related notice banner promo".split())
@pytest.mark.parametrize("page", ["<article>{a}<section class={n}>{r}</section></article>", "<body><div class=c>{a}</div><div class={n}>{r}</div></body>"])
def test_named_parts_stay_out(name, page):
    text = html_text.main_text(page.format(a=ARTICLE, r=REMARKS, n=name))
    assert text.count("\n") == 7 and "Great" not in text


@pytest.mark.parametrize("page", ["<article>{a}<ul class=zz>{i}</ul></article>", "<body><div class=c>{a}</div><ul class=q>{i}</ul></body>"])
def test_repeated_siblings_with_names_and_dates_stay_out(page):
    items = "".join(f"<li><div class=m><a href=u>Ann {i}</a> <time>2 May</time></div><div>Great post number {i}, thanks a lot, really!</div></li>" for i in range(10))
    text = html_text.main_text(page.format(a=ARTICLE, i=items))
    assert text.count("\n") == 7 and "Great" not in text and "Ann" not in text


def test_footers_stay_out_while_another_path_passes():
    foot = f"<footer>{REMARKS * 3}</footer>"
    for page in (f"<article><p>One short paragraph.</p>{foot}</article>", f"<article><p>One short paragraph.</p></article>{foot}"):
        assert html_text.main_text(page) == "One short paragraph."
    assert html_text.main_text(foot).count("\n") == 29  # nothing else is there


def test_ratios_decide_inside_an_article():
    text = html_text.main_text(f"<article>{ARTICLE}<div class=x><a href=1>Buy this now</a> <a href=2>Sign in</a></div></article>")
    assert text.count("\n") == 7 and "Buy" not in text
    section = "<section><h2>A title</h2><p>" + "Text one, and two. " * 5 + "</p></section>"
    assert html_text.main_text(f"<article>{section * 4}</article>").count("\n") == 7  # sections are no comments


def test_deep_pages_take_no_longer():
    n = 10_000
    began = time.process_time()
    assert html_text.main_text("<div>" * n + "A text, here.") == "A text, here."
    assert html_text.main_text("<div><p>x, y.<b>" * n).count("\n") == n - 1
    html_text.main_text("<li><ul>" + "<div>" * n + "<li>a</li>" * n + "</z>" * n)
    assert time.process_time() - began < 10


def test_pages_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, "a"), (2, PAGE, "b"), (2, PAGE, "b"), (None, "", "c"), (3, "<article>" + "<p>Long, text.</p>" * 20_000, None)]
    pages = spark.createDataFrame(rows, "page_id int, html string, TEXT string")
    found = html_text.with_main_text(pages).collect()
    assert sorted(len(r["main_text"]) for r in found)[:2] == [0, 0]
    assert len({r["main_text"] for r in found if r["page_id"] == 2}) == 1
    assert [r["main_text"].count("\n") for r in found if r["page_id"] == 3] == [19_999]
    assert html_text.with_main_text(pages, name="text").columns == ["page_id", "html", "text"]
    assert html_text.with_main_text(pages.limit(0)).count() == 0


# 6

def test_urls(spark):
    urls = [None, "no host", "HTTP://A.Example.ORG/es/1?q", "x://example.org/en/17#f", "x://a.com/de", "x://a.com/de/", "x://org", "x://b.co.uk:80/p"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    labels = spark.createDataFrame([], "doc_id int, quality int, toxic int")
    found = url_filter.judge_urls(pages, labels).orderBy("page_id").collect()
    assert [r["rule"] for r in found] == [None, None, "example.org/es/", "example.org/en/1", None, "com/de/", None, None]
    assert [r["verdict"] for r in found] == ["allow", "allow", "block", "block", "allow", "block", "allow", "allow"]
    assert (found[0]["host"], found[0]["path"], found[2]["host"], found[2]["path"]) == ("", "", "a.example.org", "/es/1")
    assert url_filter.judge_urls(pages.limit(0), labels).count() == 0


def test_urls_with_repeats_hot_hosts_and_clashing_columns(spark):
    rows = [(i % 40, f"x://hot.net/{i % 40}") for i in range(3000)] + [(100 + i, f"x://h{i}.net/") for i in range(50)] + [(None, None), (None, None)]
    pages = spark.createDataFrame(rows, "page_id int, url string").withColumn("HOST", F.lit("c")).withColumn("pages", F.lit(1)).withColumn("verdict", F.lit("v"))
    labels = spark.createDataFrame([(i, 0, 1) for i in range(40)] + [(None, 0, 1)], "doc_id int, quality int, toxic int")
    found = url_filter.judge_urls(pages, labels).collect()
    assert len(found) == len(rows)
    assert {r["verdict"] for r in found if r["host"] == "hot.net"} == {"block"}
    assert sum(r["host"] == "" for r in found) == 2


def test_reputation_needs_evidence(spark):
    pages = spark.createDataFrame([(i, f"x://bad{i % 2}.net/p") for i in range(200)] + [(200 + i, f"x://good{i}.net/p") for i in range(200)], "page_id int, url string")
    labels = spark.createDataFrame([(i, 0 if i < 200 else 1, 0) for i in range(400)], "doc_id int, quality int, toxic int")
    verdicts = dict(url_filter.judge_urls(pages, labels).groupBy(F.substring("host", 1, 3).alias("h")).agg(F.min("verdict")).collect())
    assert verdicts == {"bad": "block", "goo": "allow"}


# 7

def test_fingerprint_by_definition():
    def slow(text):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    for t in TEXTS:
        assert simhash.fingerprint(t or "") == slow(t or "")


@pytest.mark.parametrize("bucket", [64, 3])
def test_links_connect_what_is_near(spark, bucket):
    r = np.random.default_rng(1)
    values = set(r.integers(0, 2**63, 60, dtype=np.uint64).tolist())
    hub = next(iter(values))
    values |= {hub ^ sum(1 << int(b) for b in r.choice(64, int(r.integers(1, 5)), replace=False)) for _ in range(250)}
    u = np.array(sorted(values), np.uint64)
    parent = list(range(len(u)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= 2):
            parent[root(i + 1 + int(j))] = root(i)
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in u.view(np.int64)], "fp bigint"), 2, bucket).toPandas()
    assert (np.bitwise_count(edges["a"].to_numpy().view(np.uint64) ^ edges["b"].to_numpy().view(np.uint64)) <= 2).all()
    found = dict(components.connected_components(spark.createDataFrame(edges)).collect())
    signed = u.view(np.int64).tolist()
    groups = pd.Series(signed).groupby([root(i) for i in range(len(u))]).min()
    assert all(found.get(x, x) == groups[root(i)] for i, x in enumerate(signed))


def test_thresholds_sum_to_the_principle():
    cost, chosen = simhash.allocate([[0, 5, 9], [0, 100, 500], [0, 1, 2]], 0)
    assert sum(chosen) == 0
    assert (cost, chosen) == (7, [0, -1, 1]) or cost == min(7, 106)


def test_near_duplicates_edge_cases(docs, empty):
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    by = {(r["doc_id"], r["fp"]): r["component_id"] for r in found}
    assert {c for (i, f), c in by.items() if f == 0} == {0}
    assert all(c is not None for (i, f), c in by.items() if i is not None)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("tau", [0, 1])
def test_links_at_small_radii(spark, tau):
    values = spark.createDataFrame([(x,) for x in (0, 1, 3, 1 << 40, -1)], "fp bigint")
    found = {(r["a"], r["b"]) for r in simhash.links(values, tau).collect()}
    assert found == (set() if tau == 0 else {(0, 1), (1, 3), (0, 1 << 40)})


def test_components_of_a_path_with_rising_and_falling_ids(spark):
    ids = [*range(0, 1000, 2), *range(999, 0, -2)]
    edges = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a bigint, b bigint")
    found = components.connected_components(edges, rounds=14).collect()
    assert len(found) == 1000 and {r["component"] for r in found} == {0}
    with pytest.raises(RuntimeError):
        components.connected_components(edges, rounds=3)


def jaccard_components(texts):
    sets = {i: set(near_copies.shingles(t).tolist()) for i, t in texts.items()}
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and label[a] != label[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    return label


def near_texts(seed):
    r = random.Random(seed)
    word = lambda: "w" + str(r.randrange(900))
    texts, at = {}, 0
    for size, copies, edits in [(200, 6, 3), (200, 6, 6), (60, 5, 1), (120, 40, 4), (7, 3, 1), (2, 2, 0), (90, 5, 20)]:
        base = [word() for _ in range(size)]
        for _ in range(copies):
            new = list(base)
            for _ in range(edits):
                new[r.randrange(size)] = word()
            texts[at] = " ".join(new)
            at += 1
    passage = " ".join(word() for _ in range(12))
    for _ in range(3):  # one passage, repeated more than the rest, isn't a copy
        texts[at] = (passage + " ") * 60 + " ".join(word() for _ in range(100))
        at += 1
    return texts


@pytest.mark.parametrize("bucket", [32, 2])
def test_near_copies_are_those_of_all_pairs(spark, bucket):
    texts = near_texts(5)
    docs = spark.createDataFrame([*texts.items(), (None, texts[0])], "doc_id bigint, text string")
    kept = [r["doc_id"] for r in near_copies.keep_one_of_near(docs, bucket=bucket).collect()]
    assert sorted(kept) == sorted(set(jaccard_components(texts).values()))


@pytest.mark.parametrize("limit", [0, 100])
def test_near_copies_with_repeated_ids_and_clashing_columns(spark, limit):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, long + " end", "a"), (2, long, "b"), (2, "another text with words of its own", "c"), (3, "x y", "d"), (3, "x y", "d"), (None, long, "e"), (5, None, "f"), (6, "", "g"), (7, "  ", "h")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, NODE string").withColumn("_id", F.lit(1)).withColumn("_hash", F.lit(2)).withColumn("count", F.lit(3))
    found = near_copies.keep_one_of_near(docs, limit)
    assert found.columns == docs.columns
    assert sorted(r["NODE"] for r in found.collect()) == ["a", "c", "d", "d", "f"]
    assert near_copies.keep_one_of_near(docs.limit(0), limit).count() == 0


def test_recall_of_blocks_at_the_limit():
    """Pairs at a similarity of just 0.8 or more share a block key with a probability over 0.99, at every length."""
    r = np.random.default_rng(3)
    for n in (5, 9, 15, 25, 63, 64, 200, 1000, 20_000):
        met = 0
        for _ in range(100):
            union = round(n / 0.9)
            common = -(-4 * union // 5)
            half = (union - common) // 2
            hashes = r.integers(0, 1 << 63, union, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, union, dtype=np.uint64)
            a, b = (near_copies.block_keys(np.sort(x))[1].tolist() for x in (hashes[: common + half], np.delete(hashes, slice(common, common + half))))
            met += not set(a).isdisjoint(b)
        assert met >= 97, n


def test_bitmaps_never_lose_a_pair(spark):
    r, rows = random.Random(9), []
    for n in [3, 30, 140, 400, 5000]:
        for _ in range(12):
            common = [r.getrandbits(64) for _ in range(n)]
            a, b = (np.unique(np.array(common + [r.getrandbits(64) for _ in range(r.randrange(n))], np.uint64)) for _ in range(2))
            similar = len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
            rows.append((near_copies.bitmap(a).tolist(), len(a), near_copies.bitmap(b).tolist(), len(b), bool(similar), n))
    d = spark.createDataFrame(rows, "p array<bigint>, m int, q array<bigint>, n int, similar boolean, size int")
    found = d.withColumn("may", near_copies.may_be_similar("p", "m", "q", "n")).collect()
    assert all(x["may"] for x in found if x["similar"])
    assert sum(x["may"] for x in found if not x["similar"] and x["size"] in (30, 140)) <= 4


def test_thresholds_spare_costly_blocks(spark):
    rows = spark.createDataFrame([(0, 1)] * 3000 + [(b, i) for b in range(1, 16) for i in range(3)], "block int, key bigint")
    found = near_copies.thresholds(rows)
    assert found[0] == -1 and sum(found) == 0 and len(found) == near_copies.BLOCKS


# 8

def check_groups(found, rows):
    key = lambda t: "".join(c for c in t if c not in " \t\n\x0b\x0c\r")
    groups = {}
    for i, t in rows:
        groups.setdefault(key(t), []).append((-len(t), i is not None, i or 0))
    assert sum(r["kept"] for r in found) == len(groups)
    assert sorted(r["group_size"] for r in found) == sorted(len(g) for g in groups.values() for _ in g)


@pytest.mark.parametrize("digest", [exact_dedup.sha256_digest, lambda n: F.unhex(F.substring(F.sha2(n, 256), 1, 1))])
def test_exact_dedup_also_when_digests_collide(spark, docs, tmp_path, digest):
    path = str(tmp_path / "docs")
    docs.repartition(3).write.parquet(path)
    found = exact_dedup.deduplicate(spark, path, docs.schema, digest).collect()
    assert len(found) == docs.count()
    check_groups(found, text_by_id(docs))


def test_exact_dedup_goes_on_with_new_files(spark, docs, tmp_path):
    path, checkpoint = str(tmp_path / "docs"), str(tmp_path / "state")
    docs.limit(5).write.parquet(path)
    exact_dedup.deduplicate(spark, path, docs.schema, checkpoint=checkpoint).count()
    docs.filter("doc_id > 4").write.mode("append").parquet(path)
    found = exact_dedup.deduplicate(spark, path, docs.schema, checkpoint=checkpoint).collect()
    check_groups(found, text_by_id(spark.read.parquet(path)))


def test_exact_dedup_of_text_ids(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x  y"), ("c", "xy"), (None, "z")], "doc_id string, text string")
    assert sorted(str(r["doc_id"]) for r in exact_dedup.keep_first(docs).collect()) == ["None", "a"]
    assert exact_dedup.keep_first(docs.limit(0)).count() == 0


def test_exact_dedup_keeps_columns_and_takes_empty_tables(docs, empty):
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert kept.count() == exact_dedup.keep_first(docs, limit=0).count()
    assert exact_dedup.keep_first(empty).count() == 0


# 9

def test_packing(docs, empty):
    tokenizer = Tokenizer.from_file(WORDS)
    found = packing.pack(docs.coalesce(2), WORDS).toPandas()
    for i, t in text_by_id(docs.filter("doc_id <> 3")):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()
        own = found[found["doc_id"] == i].sort_values("start")
        assert b"".join(map(bytes, own["ids"])) == ids
        assert (own["start"] == own["length"].cumsum() - own["length"]).all()
    for _, g in found.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all()
        assert g["length"].sum() <= 2048
    assert packing.pack(empty, WORDS).count() == 0


def test_word_encoder_equals_tokenizer():
    tokenizer, encoder, r = Tokenizer.from_file(WORDS), packing.WordEncoder(WORDS), random.Random(3)
    parts = ["ab", "The", "ing", "é", "Ñ", "tion", "ß", "İ", "Σ", "e\u0301", "0", ".", "***", "日", "½", "\x1c", "'s", "\u2003", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|"]
    assert encoder.encode("a<|endoftext|>b") == np.array([320, 49407, 321], "<u4").tobytes()
    for _ in range(5000):
        t = " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 9))) for _ in range(8))
        assert encoder.encode(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


# 10

def slow_winnow(data, k=winnowing.GRAM, w=winnowing.WINDOW):
    if not data:
        return []
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    hashes = [signed(xxhash.xxh64_intdigest(data[i : i + k], 42) & ~winnowing.POSITIONS & (1 << 64) - 1) | winnowing.POSITIONS - i for i in range(max(1, len(data) - k + 1))]
    return list(dict.fromkeys(min(hashes[i : i + w]) for i in range(max(1, len(hashes) - w + 1))))


def test_runs_hold_like_numbers_of_rows(spark):
    ids = [None] * 300 + [7] * 200 + [-(1 << 63) + 1, (1 << 63) - 1, 10**15, -7] + list(range(500))
    rows = spark.createDataFrame([(x, f"text {i}") for i, x in enumerate(ids)] + [(7, "same")] * 3, "doc_id bigint, text string")
    keyed = rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("mark"))
    found = winnowing.ordered_runs(keyed, 16).toPandas().sort_values(["key", "mark"])
    assert found["run"].is_monotonic_increasing and len(found) == len(ids) + 3
    assert found.groupby("run").size().max() <= 60
    order = sorted(rows.select("doc_id", "text", F.xxhash64("text").alias("h")).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["text"]))
    wanted = sorted((a["doc_id"] or -1, a["text"], b["text"]) for a, b in zip(order, order[1:] + order[:1], strict=True))
    assert sorted((r["doc_id"] or -1, r["text"], r["next_text"]) for r in winnowing.with_next(rows, 16).collect()) == wanted


def test_winnowing_of_texts_and_edits(spark, empty):
    r = random.Random(1)
    texts = ["", "a", "abc é", "x" * 26, "x" * 27, "x" * 3000] + ["".join(r.choice("abé 日😀") for _ in range(r.choice([5, 20, 27, 40, 1100, 2500]))) for _ in range(25)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    own = dict(d.select("doc_id", winnowing.winnow(F.col("text").cast("binary"))).collect())
    assert all(own[i] == slow_winnow(t.encode()) for i, t in enumerate(texts))
    edits = [t[: len(t) - len(t) // 2] + texts[(i + 1) % len(texts)][: len(t) // 2] for i, t in enumerate(texts)]
    x = winnowing.with_next(d, 8)
    half = F.floor(F.char_length("text") / 2).cast("int")
    x = x.withColumn("left", F.left("text", F.char_length("text") - half).cast("binary")).withColumn("right", F.left("next_text", half).cast("binary"))
    spliced = dict(x.select("doc_id", winnowing.splice(F.col("left"), F.col("numbers"), F.col("right"), F.col("next_numbers"))).collect())
    assert all(spliced[i] == slow_winnow(e.encode()) for i, e in enumerate(edits))
    found = {r["doc_id"]: r for r in winnowing.fingerprints_of_edits(d).collect()}
    assert all(found[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() for i, e in enumerate(edits))
    assert found[0]["fingerprint"] == "empty"
    assert winnowing.fingerprints_of_edits(empty).count() == 0


def test_winnowing_of_nulls_and_repeats(docs):
    found = winnowing.fingerprints_of_edits(docs).collect()
    assert len(found) == docs.count()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)


# The pipeline

SMALL = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    """Each stage on its own input, over the whole table: what goes and what stays."""
    import corpus_pipeline as pipeline

    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").filter("toxic = 1").collect()}
    clean = common.write_table(pipeline.drop_toxic(spark, docs, SMALL), "t1")
    dropped = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in clean.collect()}
    assert clean.columns == docs.columns and len(dropped - toxic) <= 0.02 * docs.count()

    single = common.write_table(pipeline.drop_copies(spark, clean, SMALL), "t2")
    best = {}
    for r in clean.collect():
        text = r["text"] or ""
        key = re.sub(r"[\x20\x09-\x0D]", "", text)
        best[key] = min(best.get(key, (1, 0)), (-len(text), r["doc_id"]))
    assert single.columns == docs.columns
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for _, i in best.values())

    apart = common.write_table(pipeline.drop_near_copies(spark, single, SMALL), "t3")
    texts = {r["doc_id"]: r["text"] or "" for r in single.collect()}
    assert apart.columns == docs.columns
    assert sorted(r["doc_id"] for r in apart.collect()) == sorted(set(jaccard_components(texts).values()))

    pieces = pipeline.pack(spark, apart, SMALL).toPandas()
    tokenizer = Tokenizer.from_file(WORDS)
    for i, own in pieces.groupby("doc_id"):
        assert own["length"].sum() == len(tokenizer.encode(texts[i], add_special_tokens=False).ids) + 1
    assert set(pieces["doc_id"]) == {r["doc_id"] for r in apart.collect()}

    whole = pipeline.run(spark, SMALL).toPandas()
    assert whole.groupby("doc_id")["length"].sum().to_dict() == pieces.groupby("doc_id")["length"].sum().to_dict()


def test_stages_on_odd_tables(spark, docs, empty):
    """Nulls, repeats, long texts, clashing columns and no rows at all."""
    import corpus_pipeline as pipeline

    odd = docs.withColumn("toxicity", F.lit("own")).withColumn("_where", F.lit(1)).withColumn("node", F.lit(2)).withColumn("component", F.lit(3))
    for table in (odd, odd.limit(0), empty):
        left = table
        for _, stage in pipeline.STAGES[:-1]:
            left = common.write_table(stage(spark, left, SMALL), "odd")
            assert left.columns == table.columns
        assert (left.count() > 0) == (table.count() > 0)
        assert (pipeline.pack(spark, left, SMALL).count() > 0) == (table.count() > 0)
    kept = pipeline.drop_toxic(spark, odd, SMALL)
    assert {r["toxicity"] for r in kept.collect()} == {"own"}
