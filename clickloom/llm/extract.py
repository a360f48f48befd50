"""Main text of HTML pages as the best contiguous run of a token sequence.

A page is a sequence of tags and of text between them. Words score positive,
tags negative, with weights learned from labelled pages: those that mark their
main text up themselves (an `article` or `main` element). A linear scan finds
the maximum-scoring subsequence; its text, without the boilerplate containers
within (menus, asides, forms, adverts, reader comments), is the main text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import lean

#: Labelled pages that weights are learned from, at most.
SAMPLE = 2000
_TOKEN = re.compile(r"<!--(?:(?!-->)[\s\S])*+(?:-->|\Z)|<!\[CDATA\[(?:(?!\]\]>)[\s\S])*+(?:\]\]>|\Z)|<[!?][^>]*>?|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*>?)")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
#: Fixed values of HTML: elements whose text isn't shown as text, that hold no content, and that don't break a line.
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("nav header footer aside form menu dialog head script style noscript template button select textarea title iframe svg math object canvas audio video".split())
CONTENT = frozenset("article main".split())
#: Words in a class, id or role that name boilerplate.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies copyright disqus footer gdpr header menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: What closes implicitly when one of its kind opens.
_CLOSED_BY = {"p": frozenset("p div ul ol li table section article main nav header footer aside form h1 h2 h3 h4 h5 h6 blockquote pre hr dl figure".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}


def _named_boilerplate(tag: str, rest: str) -> bool:
    if tag in ("html", "body", *CONTENT):
        return False
    for m in _NAMES.finditer(rest):
        value = (m[1] or m[2] or m[3] or "").lower()
        if any(set(_SPLIT.split(name)) & BOILERPLATE for name in value.split()):
            return True
    return bool(re.search(r"\bhidden\b(?!\s*=\s*[\"']?until)|aria-hidden\s*=\s*[\"']?true", rest, re.I)) if rest else False


def tokens(page: str) -> Iterator[tuple[str, str, str, bool]]:
    """(kind, name, text, inside labelled content). kinds: tag, word (text of the page), link (text of a link), out (text of a boilerplate container)."""
    stack: list[tuple[str, bool, bool]] = []  # tag, boilerplate at or above, content at or above
    open_tags = [Counter()]  # how many of each tag are open, within each labelled element that is
    at, n = 0, len(page)

    def push(tag: str, junk: bool, content: bool) -> None:
        stack.append((tag, junk, content))
        open_tags[-1][tag] += 1
        if tag in CONTENT:
            open_tags.append(Counter())

    def pop() -> str:
        tag = stack.pop()[0]
        if tag in CONTENT:
            open_tags.pop()
        open_tags[-1][tag] -= 1
        return tag

    def state() -> tuple[bool, bool]:
        return (stack[-1][1], stack[-1][2]) if stack else (False, False)

    def text(a: int, b: int) -> Iterator[tuple[str, str, str, bool]]:
        if a < b:
            junk, content = state()
            kind = "out" if junk else "link" if any(s[0] == "a" for s in stack[-4:]) else "word"
            yield kind, kind, html.unescape(page[a:b]), content and not junk

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            yield from text(at, n)
            return
        yield from text(at, m.start())
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                yield ("out" if state()[0] else "word"), "word", m[0][9:].removesuffix("]]>"), state()[1]
            continue
        if m["end"]:
            # a stray end tag doesn't end the content around it
            if any(c[tag] for c in open_tags) if tag in ("body", "html", *CONTENT) else open_tags[-1][tag]:
                while pop() != tag:
                    pass
            yield "tag", f"/{tag}", "", state()[1] and not state()[0]
            continue
        while stack and tag in _CLOSED_BY.get(stack[-1][0], ()):
            pop()
        if tag in CONTENT or tag == "body":  # what was left open before isn't around it
            while stack and stack[-1][1]:
                pop()
        junk, content = state()
        junk = junk or tag in CONTAINERS or _named_boilerplate(tag, m["rest"])
        content = content or tag in CONTENT
        yield "tag", tag, "", content and not junk and tag not in CONTENT
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else n
        elif tag not in VOID and not m["rest"].rstrip().endswith("/>"):
            push(tag, junk, content)


def best_run(scores: list[float]) -> tuple[int, int]:
    """From and to of the contiguous run with the largest sum; the first and shortest of equals; (0, 0) if none is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for n, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, n
        total += s
        if total > best:
            best, found = total, (start, n + 1)
    return found


#: What tags and words weigh where no labelled page tells.
PRIOR = {"word": 1.0, "link": 0.2, "tag": -0.5, "out": 0.0} | dict.fromkeys([x for t in (*INLINE - {"a"}, "p", "br", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre") for x in (t, f"/{t}")], -0.1)


def main_text(page: str, weights: dict[str, float]) -> str:
    """Blocks of the best run, in page order, each with single blanks, joined by a blank."""
    kinds = list(tokens(page))
    scores = []
    for kind, name, text, _ in kinds:
        key = name if kind == "tag" else kind
        weight = weights[key] if key in weights else PRIOR.get(key, PRIOR[kind])
        scores.append(weight * (1 if kind == "tag" else len(text.split())))
    a, b = best_run(scores)
    parts = []
    for kind, name, text, _ in kinds[a:b]:
        if kind == "tag":
            parts.append("" if name.lstrip("/") in INLINE else "\n")
        elif kind != "out":
            parts.append(text)
    return " ".join("".join(parts).split())


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> dict[str, float]:
    """Weights of words and tags: the log-odds of standing in content, held positive for words and negative for tags.

    Learned from SAMPLE labelled pages at most, those with the least hash of
    their id; what comes to the driver is a count for each tag name in them.
    """
    labelled = pages.filter(F.lower(F.col(html_col)).rlike(r"<(article|main)[\s>]")).select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    chosen = labelled.select("id", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(SAMPLE).select(F.col("id").alias("chosen")).distinct()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for page in batch.column("html").to_pylist():
                for kind, name, text, content in tokens(page):
                    n = 1 if kind == "tag" else len(text.split())
                    (inside if content else outside)[name if kind == "tag" else kind] += n
        names = sorted(set(inside) | set(outside))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([inside[k] for k in names], pa.int64()), pa.array([outside[k] for k in names], pa.int64())], names=["name", "inside", "outside"])

    # SAMPLE ids at most: small enough to broadcast whatever the number of pages
    drawn = labelled.join(F.broadcast(chosen), labelled["id"] == F.col("chosen"), "left_semi").select("html")
    sums = drawn.mapInArrow(lean(of), "name string, inside long, outside long").groupBy("name").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    rows = sums.collect()
    total_in = sum(r["inside"] for r in rows) or 1
    total_out = sum(r["outside"] for r in rows) or 1
    out: dict[str, float] = {}
    for r in rows:
        odds = math.log((r["inside"] + 1) / (total_in + 1)) - math.log((r["outside"] + 1) / (total_out + 1))
        if r["name"] in ("word", "link"):
            out[r["name"]] = min(2.0, max(0.1, odds))
        elif r["name"] != "out":
            out[r["name"]] = max(-8.0, min(-0.05, odds))
    return out


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(page_id, keep..., text, n_chars): the main text of each row's whole html. Null html counts as empty; no main text: ''."""
    weights = learn(pages.filter(F.col(html_col).isNotNull()), id_col, html_col)
    kept_schema = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t, weights) if t else "" for t in batch.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", *keep, "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), *keep, F.col(html_col).cast("string").alias("__html"))
    return rows.mapInArrow(lean(of), "page_id long" + kept_schema + ", text string, n_chars long")
