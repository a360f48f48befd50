"""Personal data: patterns, and terms whose co-occurrence gives an entity away.

Base spans are e-mail addresses, IPv4 addresses, card and phone numbers. The
values found are protected entities. A corpus unit is a distinct line (a line
of over UNIT words is several); copies of a line are one unit, so copying a
document discloses nothing new. Two kinds of terms are looked for:

- A word t that stands in common units with an entity e. PMI(e; t) / IC(e) says
  how much of e's information t gives away: 1 if t occurs with e only.
- An identifier (a long token of letters and digits) after a cue, as the word
  and the marks before it are called. The units of a cue are its holders. How
  much of the information about the holder its identifiers give away is
  I(holder; identifier) / H(holder): 1 if each holder has an identifier of its
  own, as with keys and secrets; less, the more holders share one.

What is at or over `threshold` with support is disclosing: it is generalised to
a placeholder wherever it occurs, or removed where a word occurs with its entity
alone.

Only lines with an entity or an identifier give pairs, and only pairs with
support go on. How often such a word occurs elsewhere is counted over the whole
corpus behind a hashed table of fixed size that also bounds each word's count: a
task that has met a word too often to pass says so once instead of listing its
units, which decides the word exactly.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import lean, settled, whole

KINDS = ("email", "ip", "card", "phone", "term")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")
_TOKEN = re.compile(r"(?<![\w-])[\w-]{16,}")
_CUE = re.compile(r"([^\W\d_]{2,})(\W{0,6})$")
#: Words in a unit; places of the hashed table (4 MB, whatever the corpus) and its hashes.
UNIT, TABLE_BITS, TABLE_HASHES = 64, 22, 3
#: Entries and characters of disclosing terms up to which tasks get them all; beyond, texts and terms are joined.
MOST_TERMS, MOST_CHARACTERS = 100_000, 4_000_000


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        v = int(d) * (1 + n % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # left of an @ the longest run of local characters, not before the last match: that is where a scan would start
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), by start, then kind; code points. Leftmost and non-overlapping within a kind; failing matches are dropped."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def rendered(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def units(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of lines, cut after each UNIT words."""
    at = 0
    for line in text.split("\n"):
        if line.count(" ") < UNIT:
            yield at, at + len(line)
        else:
            start, words = at, 0
            for m in re.finditer(r"\S+", line):
                words += 1
                if words > UNIT:
                    yield start, at + m.start()
                    start, words = at + m.start(), 1
            yield start, at + len(line)
        at += len(line) + 1


class Covered:
    """Where spans (start, kind, end) cover a text, for look-ups in logarithmic time."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, _, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def touches(self, a: int, b: int) -> bool:
        n = bisect_left(self.starts, b) - 1
        return n >= 0 and self.ends[n] > a


def identifiers(text: str, covered: Covered, a: int = 0, b: int | None = None) -> Iterator[tuple[int, int, str]]:
    """(start, end, cue) of tokens of 16 characters or more with letters and digits, outside what is covered."""
    for m in _TOKEN.finditer(text, a, len(text) if b is None else b):
        token = m[0]
        if token.isdecimal() or not any(map(str.isdecimal, token)) or not any(map(str.isalpha, token)) or covered.touches(m.start(), m.end()):
            continue
        cue = _CUE.search(text[max(a, m.start() - 40) : m.start()])
        if cue and "\n" not in cue[2]:
            yield m.start(), m.end(), f"{cue[1].lower()}{''.join(cue[2].split())}"


def _places(term: str) -> list[int]:
    h = xxhash.xxh3_128_intdigest(term.encode())
    a, b = h & 0xFFFFFFFF, h >> 32 & 0xFFFFFFFF | 1
    return [(a + n * b) & (1 << TABLE_BITS) - 1 for n in range(TABLE_HASHES)]


def _table(terms: DataFrame) -> np.ndarray:
    """For (term, limit): each place's greatest limit, as the number of its binary digits; 0 where no term falls."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, int] = {}
        for batch in batches:
            for term, limit in zip(batch.column("term").to_pylist(), batch.column("limit").to_pylist(), strict=True):
                for place in _places(term):
                    best[place] = max(best.get(place, 0), int(limit).bit_length())
        yield pa.RecordBatch.from_arrays([pa.array(best.keys(), pa.int32()), pa.array(best.values(), pa.int8())], names=["place", "digits"])

    rows = terms.select("term", "limit").mapInArrow(lean(of), "place int, digits byte").groupBy("place").agg(F.max("digits").alias("digits")).toPandas()
    out = np.zeros(1 << TABLE_BITS, np.uint8)
    out[rows["place"].to_numpy(np.int64)] = rows["digits"].to_numpy(np.uint8)
    return out


def _limit(table: np.ndarray, term: str) -> int:
    """An upper bound of the term's limit; 0: it is none of the terms."""
    digits = min(int(table[place]) for place in _places(term))
    return (1 << digits) - 1 if digits else 0


def _unit(text: str, a: int, b: int) -> int:
    return xxhash.xxh64_intdigest(text[a:b].encode()) - (1 << 63)


def _pairs(docs: DataFrame) -> DataFrame:
    """(entity, term, unit, context) of lines with personal data, context: between which words; (null, cue, unit, hash of the identifier) of lines with one."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: set[tuple[str | None, str, int, int]] = set()
            for text in batch.column("text").to_pylist():
                spans = base_spans(text)
                covered = Covered(spans)
                tokens = list(identifiers(text, covered))
                if not spans and not tokens:
                    continue
                at = token_at = 0
                for a, b in units(text):
                    first, token_first = at, token_at
                    while at < len(spans) and spans[at][0] < b:
                        at += 1
                    while token_at < len(tokens) and tokens[token_at][0] < b:
                        token_at += 1
                    if at == first and token_at == token_first:
                        continue
                    unit = _unit(text, a, b)
                    for start, end, cue in tokens[token_first:token_at]:
                        out.add((None, cue, unit, xxhash.xxh64_intdigest(text[start:end].encode()) - (1 << 63)))
                    entities = {f"{KINDS[k]}:{text[start:end].lower()}" for start, k, end in spans[first:at]}
                    if entities:
                        terms = _terms(text, a, b, covered)
                        out.update((entity, w, unit, context) for entity in entities for w, context in terms)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["entity", "term", "unit", "context"])

    return docs.mapInArrow(lean(of), "entity string, term string, unit long, context long")


def _terms(text: str, a: int, b: int, covered: Covered) -> set[tuple[str, int]]:
    """The line's words outside what is covered, each with a hash of the words beside it."""
    found = [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text, a, b)]
    words = ["", *(w for w, _, _ in found), ""]
    return {
        (w, xxhash.xxh64_intdigest(f"{words[n]} {words[n + 2]}".encode()) - (1 << 63))
        for n, (w, start, end) in enumerate(found)
        if not covered.touches(start, end)
    }


def _occurrences(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(term, unit): distinct units of words in the table; a task with more of a word than its limit gives one more than that."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits: dict[str, int] = {}
        done: set[str] = set()  # words as they are written that aren't in the table, or were met often enough
        found: dict[str, set[int]] = defaultdict(set)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for a, b in units(text):
                    unit = None
                    for written in set(_WORD.findall(text, a, b)) - done:
                        w = written.lower()
                        limit = limits.get(w)
                        if limit is None:
                            limit = limits[w] = _limit(table, w)
                        if len(found[w]) <= limit if limit else False:
                            unit = _unit(text, a, b) if unit is None else unit
                            found[w].add(unit)
                        else:
                            if len(done) > 300_000:  # begun anew, so that memory is bounded
                                done.clear()
                                limits.clear()
                            done.add(written)
        rows = [(w, u) for w, own in found.items() for u in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["term", "unit"])

    return docs.mapInArrow(lean(of), "term string, unit long")


def n_units(docs: DataFrame) -> float:
    """About how many distinct units there are, to a hundredth: counted by sketches, so that copies don't count."""
    lines = docs.select(F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    pieces = F.explode(F.sequence(F.lit(0), F.floor((F.length("line") - F.length(F.translate("line", " ", ""))) / UNIT)))
    return float(lines.select("line", pieces.alias("piece")).agg(F.approx_count_distinct(F.xxhash64("line", "piece"), 0.01)).first()[0])


def disclosing_terms(docs: DataFrame, threshold: float = 0.9, support: int = 3) -> DataFrame:
    """(term, share, only, cue): words that give away at least `threshold` of some entity's information, and cues whose identifiers give away as much of their holders'.

    docs: a column text without nulls. support: distinct units with both, and
    distinct pairs of words beside the word there, at least; an edited copy of
    a line brings a new unit, but seldom new neighbours. Of a cue: distinct
    units with an identifier. only: the word occurs with its entity alone.
    Counts are over all rows.
    """
    spark = docs.sparkSession
    found = settled(_pairs(docs).distinct())
    held = found.filter("entity is null").groupBy("term", "context").agg(F.count("*").alias("m"))
    of_cue = held.groupBy("term").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.log2("m")).alias("h")).filter(F.col("n") >= max(2, support))
    cues = of_cue.select("term", (1 - F.col("h") / (F.col("n") * F.log2("n"))).alias("share"), F.lit(False).alias("only"), F.lit(True).alias("cue"))
    cues = cues.filter(F.col("share") >= threshold)
    pairs = found.filter("entity is not null")
    entity = pairs.groupBy("entity").agg(F.count_distinct("unit").alias("n_e")).filter(F.col("n_e") >= support)
    both = pairs.groupBy("entity", "term").agg(F.count_distinct("unit").alias("n_et"), F.count_distinct("context").alias("n_context"))
    both = both.filter((F.col("n_et") >= support) & (F.col("n_context") >= support)).drop("n_context")
    both = settled(both.join(entity, "entity"))
    if both.isEmpty():
        return settled(cues)
    total = n_units(docs)
    # share >= threshold needs n_t <= n_et * (total / n_e) ^ (1 - threshold)
    limit = F.ceil(F.col("n_et") * F.pow(F.greatest(F.lit(1.0), total / F.col("n_e")), F.lit(1 - threshold))) + 1
    table = _table(both.groupBy("term").agg(F.max(limit).alias("limit")))
    seen = _occurrences(docs, table).distinct().groupBy("term").agg(F.count("*").alias("n_t"))
    share = (math.log2(total) + F.log2("n_et") - F.log2("n_e") - F.log2("n_t")) / (math.log2(total) - F.log2("n_e"))
    scored = both.join(seen, "term").filter(F.col("n_e") < total).withColumn("share", share).filter(F.col("share") >= threshold)
    words = scored.groupBy("term").agg(F.max("share").alias("share"), F.max(F.col("n_t") <= F.col("n_et")).alias("only"))
    return settled(words.withColumn("cue", F.lit(False)).unionByName(cues))


def find(docs: DataFrame, threshold: float = 0.9, support: int = 3, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, n_email, n_ip, n_card, n_phone, n_term, n_spans, base_sha256, spans [, keep...]): one row for each row of docs.

    text: the whole text with spans replaced by `<kind>`, disclosing words that
    occur with their entity alone taken out. A null text counts as empty for
    the counts and stays null. spans: kind:start:end of all spans, by start and kind; terms
    that touch a base span aren't spans. Repeated rows get the same result each. No rows: no rows.
    """
    plain = docs.select(whole(F.col(text_col)).alias("text"))
    terms = disclosing_terms(plain, threshold, support)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
    size = terms.agg(F.count("*").alias("n"), F.sum(F.length("term")).alias("characters")).first()
    every: dict[bool, dict[str, bool]] | None = None
    if size["n"] <= MOST_TERMS and (size["characters"] or 0) <= MOST_CHARACTERS:
        every = {cue: {r["term"]: r["only"] for r in terms.filter(F.col("cue") == cue).collect()} for cue in (False, True)}
    else:
        hits = _hits(plain, _table(terms.withColumn("limit", F.lit(1)))).join(terms, ["term", "cue"])
        hits = settled(hits.groupBy("row").agg(F.collect_set(F.struct("term", "only", "cue")).alias("terms")))
        rows = rows.withColumn("row", F.xxhash64(F.coalesce("text", F.lit("")))).join(hits.withColumnRenamed("row", "of_row"), F.col("row") == F.col("of_row"), "left").drop("row", "of_row")
    kept_schema = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            own = [None] * len(texts) if every is not None else batch.column("terms").to_pylist()
            out = []
            for text, found in zip(texts, own, strict=True):
                base = base_spans(text or "")
                words, cues = (every[False], every[True]) if every is not None else ({t["term"]: t["only"] for t in found or () if t["cue"] == cue} for cue in (False, True))
                spans = sorted(base + _term_spans(text or "", words, cues, base))
                counts = [sum(s[1] == k for s in spans) for k in range(5)]
                out.append((text and _cleaned(text, spans, words), *counts, len(spans), hashlib.sha256(rendered(base).encode()).hexdigest(), rendered(spans)))
            kinds = (pa.string(), *[pa.int64()] * 6, pa.string(), pa.string())
            names = ["text", "n_email", "n_ip", "n_card", "n_phone", "n_term", "n_spans", "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)), *(batch.column(c) for c in keep)], names=["doc_id", *names, *keep])

    schema = "doc_id long, text string, n_email long, n_ip long, n_card long, n_phone long, n_term long, n_spans long, base_sha256 string, spans string" + kept_schema
    return rows.mapInArrow(lean(of), schema)


def _hits(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(row, term, cue): words and cues of each text that are in the table; row: the text's hash, as SQL's xxhash64 gives it."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                out += [(row, w, False) for w in {m[0].lower() for m in _WORD.finditer(text)} if _limit(table, w)]
                out += [(row, c, True) for c in {c for _, _, c in identifiers(text, Covered(base_spans(text)))} if _limit(table, c)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.bool_()))], names=["row", "term", "cue"])

    return docs.select(F.xxhash64("text").alias("row"), "text").mapInArrow(lean(of), "row long, term string, cue boolean").distinct()


def _term_spans(text: str, words: dict[str, bool], cues: dict[str, bool], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    covered = Covered(base)
    out = [(a, 4, b) for a, b, cue in identifiers(text, covered) if cue in cues] if cues else []
    if words and any(w.lower() in words for w in set(_WORD.findall(text))):
        covered = Covered(base + out)
        out += [(m.start(), 4, m.end()) for m in _WORD.finditer(text) if m[0].lower() in words and not covered.touches(m.start(), m.end())]
    return out


def _cleaned(text: str, spans: list[tuple[int, int, int]], words: dict[str, bool]) -> str:
    out, at = [], 0
    for a, k, b in sorted(spans, key=lambda s: (s[0], -s[2])):
        if b <= at:
            continue
        if a >= at:
            out.append(text[at:a])
            if k != 4 or not words.get(text[a:b].lower(), False):
                out.append(f"<{KINDS[k]}>")
        at = b
    return "".join(out) + text[at:]
