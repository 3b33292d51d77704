"""Main text of web pages by tag-path ratios.

A page's text falls into blocks, each with the path of block-level tags (with their classes) from the root. For each path
the text length and the punctuation of its blocks are summed, link text left out. A path's two ratios (characters
and punctuation marks per block) are smoothed with its neighbours' in page order and fused by multiplication, with its
share of text outside of links and its weight. A path's blocks count up to three, so many short comments weigh no more than
few paragraphs. Paths that reach a part of the best
path's value are content nodes. The nearest element around all of them, or an article or main element around that, is
the content: its blocks stay, but for those of lower weight inside, and those that are mostly links outside of paragraphs and list items, whose own path must have passed.

Weights come from what HTML says of an element: what lies in navigation, footers, asides, forms and the like, or outside of a page's
article or main elements, is content only where no other path passes. Elements whose class or id names them as
comments, adverts and the like have a low weight, and so have repeated siblings that each hold a short line of links or dates and a
text, as comments and teasers do whatever they are called.
Only what is never running text (scripts, styles, the head, form controls) takes no part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapforge.llm.common import text_of

#: Part of the best path's fused ratio that a path needs, and what every content path needs.
THRESHOLD, LEAST = 0.15, 0.3
#: Blocks of a path that count: text comes in several, but thirty weigh no more than three.
COUNTED = 3
#: Weight of an element that HTML sets apart from the main text.
APART = 0.001
#: Weight of an element whose class or id names it as an advert, a notice or the like.
NAMED = 0.005

# Elements by their meaning in HTML; words of class or id names for parts that HTML has no element for.
RAW = "script style noscript template iframe svg math canvas object audio video textarea title"
CONTROLS = "head select datalist button map"
HEAD = "title meta link base style script noscript template"
ASIDE = "nav footer aside form dialog menu"
ROLES = "navigation banner contentinfo complementary search form dialog alert menu menubar"
NAMES = """ad ads advert advertisement sponsored promo promotion sidebar menu footer cookie consent notice banner newsletter related
comment comments kommentar kommentare commentaire commentaires comentario comentarios reply replies response responses discussion disqus"""
VOID = "area base br col embed hr img input link meta param source track wbr"
#: Repeated siblings of that many are comments or teasers; the longest line of links or dates in them.
ITEMS, LINE = 3, 80
HEADINGS = "h1 h2 h3 h4 h5 h6"
INLINE = "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var"
LEAVES = "p h1 h2 h3 h4 h5 h6 li blockquote pre"

_RAW, _CONTROLS, _HEAD, _ASIDE, _ROLES, _NAMED, _VOID, _INLINE, _LEAVES, _HEADINGS = (frozenset(x.split()) for x in (RAW, CONTROLS, HEAD, ASIDE, ROLES, NAMES, VOID, INLINE, LEAVES, HEADINGS))
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW.split()) + r")(?=[\s/>])(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[a-z/!?][^>]*>?", re.IGNORECASE | re.DOTALL)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_PUNCT = re.compile(r"[.,;:!?…。，、！？；：]")
#: What a start tag closes without saying so, and the elements beyond which it closes nothing.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = ("ul", "ol", "dl", "table")


@dataclass
class Paths:
    """The tag paths of one page, numbered so that a path's parent comes before it; path 0 is the empty one."""

    parent: list[int]
    tag: list[str]
    weight: list[float]
    article: list[int]  # the innermost article or main element's path that the path lies in, or -1
    apart: list[bool]  # whether the path lies in an element that HTML sets apart
    items: list[int]  # how many of the path's elements hold a line of links or dates, and a text
    known: dict[tuple[int, str, str], int]

    def child(self, path: int, tag: str, names: dict[str, str]) -> int:
        label = " ".join(sorted(names.get("class", "").split()))
        words = {w.lower() for w in _WORD.findall(names.get("class", "") + " " + names.get("id", ""))}
        role = names.get("role", "").lower()
        weight, apart = 1.0, self.apart[path]
        if tag not in ("html", "body", "article", "main"):
            if tag in _ASIDE or role in _ROLES or (tag == "header" and self.article[path] < 0):
                weight, apart = APART, True
            elif not words.isdisjoint(_NAMED):
                weight = NAMED
        key = (path, f"{tag} {label}", str(weight))
        if key not in self.known:
            self.known[key] = len(self.parent)
            self.parent.append(path)
            self.tag.append(tag)
            self.weight.append(self.weight[path] * weight)
            self.apart.append(apart)
            self.items.append(0)
            self.article.append(self.known[key] if tag in ("article", "main") or role == "main" else self.article[path])
        return self.known[key]


def blocks(html: str) -> tuple[Paths, list[tuple[int, str, int]]]:
    """The page's paths, and (path, text, characters in links) of each block of text in page order.

    Unclosed tags are closed as browsers do. The work grows in proportion to the page, however deep its tags are nested.
    """
    paths, found, parts = Paths([-1], [""], [1.0], [-1], [False], [0], {}), [], []
    tags, at_path, hidden = [""], [0], [False]  # the open elements: tag, path, whether no text
    where: dict[str, list[int]] = {}  # places of each open tag
    outer = [0]  # places of open block-level elements
    lines, texts = [0], [0]  # of each open element: blocks that are lines of links or dates, and others

    def flush() -> None:
        text = " ".join("".join(t for t, _ in parts).split())
        if text and not hidden[-1]:
            linked = sum(len(" ".join(t.split())) for t, link in parts if link)
            found.append((at_path[-1], text, sum(len(" ".join(t.split())) for t, link in parts if link == "a")))
            if len(text) <= LINE and 2 * linked >= len(text) and paths.tag[at_path[-1]] not in _HEADINGS:
                lines[-1] += 1
            elif paths.tag[at_path[-1]] not in _HEADINGS:
                texts[-1] += 1
        parts.clear()

    def pop(at: int) -> None:
        if outer[-1] >= at:
            flush()
        while len(tags) > at:
            place, tag = at_path.pop(), tags.pop()
            where[tag].pop()
            hidden.pop()
            n, m = lines.pop(), texts.pop()
            if tag not in _INLINE and tag not in ("html", "body", "article", "main"):
                paths.items[place] += bool(n and m)
            lines[-1] += n
            texts[-1] += m
        while outer[-1] >= at:
            outer.pop()

    def last(names: tuple[str, ...]) -> int:
        return max((where[n][-1] for n in names if where.get(n)), default=0)

    def add(raw: str) -> None:
        if raw and not hidden[-1]:
            parts.append((unescape(raw), "a" if where.get("a") else "time" if where.get("time") else ""))

    at = 0
    for m in _TOKEN.finditer(html):
        add(html[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            if where.get(tag):
                pop(where[tag][-1])
            elif tag not in _INLINE and tag not in _VOID:
                flush()
            continue
        if where.get("head") and tag not in _HEAD:
            pop(where["head"][-1])
        if tag in _VOID:
            parts.append((" ", ""))
            if tag == "hr":
                flush()
            continue
        if tag not in _INLINE:
            flush()
            place = last(_CLOSES.get(tag, ("p",)))
            if place and place >= (last(_SCOPE) if tag in _CLOSES else outer[-1]):
                pop(place)
        names = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(m["attrs"])} if m["attrs"] else {}
        if m["attrs"].endswith("/") and tag not in ("p", "div", "span", "b"):
            continue
        where.setdefault(tag, []).append(len(tags))
        if tag in _INLINE:
            at_path.append(at_path[-1])
        else:
            outer.append(len(tags))
            at_path.append(paths.child(at_path[-1], tag, names))
        tags.append(tag)
        lines.append(0)
        texts.append(0)
        hidden.append(hidden[-1] or tag in _CONTROLS)
    add(html[at:])
    flush()
    pop(1)
    for p in range(1, len(paths.parent)):  # what lies in repeated items weighs less
        if paths.items[p] >= ITEMS or paths.items[paths.parent[p]] < 0:
            paths.items[p] = -1
            paths.weight[p] *= NAMED
    return paths, found


def fused_ratios(paths: Paths, found: list[tuple[int, str, int]]) -> dict[int, float]:
    """Each path's value, from its ratios and its neighbours', in page order."""
    sums: dict[int, list[float]] = {}
    for path, text, linked in found:
        s = sums.setdefault(path, [0.0, 0.0, 0.0, 0.0])
        s[0] += len(text) - linked
        s[1] += len(_PUNCT.findall(text)) * (len(text) - linked) / len(text)
        s[2] += 1
        s[3] += len(text)
    order = list(sums)
    ratios = [(sums[p][0] / sums[p][2], (sums[p][1] + 0.5) / sums[p][2]) for p in order]
    out = {}
    for i, p in enumerate(order):
        near = ratios[max(0, i - 1) : i + 2]
        length, marks = (0.5 * ratios[i][k] + 0.5 * sum(r[k] for r in near) / len(near) for k in (0, 1))
        out[p] = length * marks * min(sums[p][2], COUNTED) * sums[p][0] / sums[p][3] * max(paths.weight[p], APART * APART)
    return out


def main_text(html: str, threshold: float = THRESHOLD, least: float = LEAST) -> str:
    """The content blocks, one line each."""
    paths, found = blocks(html)
    if not found:
        return ""
    fused = fused_ratios(paths, found)
    passed: set[int] = set()
    for fit, bound in ((lambda p: paths.article[p] >= 0 and not paths.apart[p], least), (lambda p: not paths.apart[p], least), (lambda p: True, least / 10)):
        own = {p: value for p, value in fused.items() if fit(p)}
        passed = {p for p, value in own.items() if value >= max(threshold * max(own.values()), bound)}
        if passed:
            break
    if not passed:
        return ""
    held = [0] * len(paths.parent)
    for p in passed:
        held[p] = 1
    for p in range(len(held) - 1, 0, -1):
        held[paths.parent[p]] += held[p]
    root = max(p for p, n in enumerate(held) if n == len(passed))  # the deepest path around all that passed
    if paths.article[root] >= 0:
        root = paths.article[root]
    elif paths.tag[root] in _LEAVES:
        root = paths.parent[root]
    within = [p == root for p in range(len(held))]
    for p in range(root + 1, len(held)):
        within[p] = within[paths.parent[p]]
    size: dict[int, list[int]] = {}
    for p, text, linked in found:
        s = size.setdefault(p, [0, 0])
        s[0] += len(text)
        s[1] += linked
    keep = {p for p, (n, linked) in size.items() if within[p] and (p in passed or (paths.weight[p] == paths.weight[root] and (2 * linked <= n or paths.tag[p] in _LEAVES)))}
    return "\n".join(text for p, text, _ in found if p in keep)


def with_main_text(pages: DataFrame, html: str = "html", name: str = "main_text") -> DataFrame:
    """Add the main text of the whole page; a null or empty page has the empty text.

    Each row is read by itself, so repeated rows have equal results, and an empty table gives an empty result. A column
    called ``name`` is replaced; others stay.
    """

    @F.arrow_udf("string")
    def extract(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in pages], pa.string())

    return pages.withColumn(name, extract(text_of(html)))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row gives one row, repeated ones too; other columns are ignored."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return with_main_text(pages, name="text").select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
