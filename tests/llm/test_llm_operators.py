"""The ten operators against brute force, with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from clickloom.llm import bpe, extract, graph, langid, packing, pii, quality, registry, simhash, suffixes, topk, urls

WORDS = "the of and to in der die und le la les el los con lorem ipsum dolor sit amet".split()


def texts(n, seed, longest=120):
    r = random.Random(seed)
    return [" ".join(r.choice(WORDS) + r.choice(["", "", ",", "x", "."]) for _ in range(r.randint(0, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    t = texts(60, 1)
    rows = [(n * 2, x, "en", "key") for n, x in enumerate(t)]
    rows += [(500 + n, t[n], "fr", "b") for n in range(8)]  # exact copies
    rows += [(600 + n, t[n + 8] + " tail", "fr", "b") for n in range(8)]
    rows += [(700, None, None, None), (701, "", "en", "term"), (None, "no id " * 80, "en", "x"), (702, " \n\t ", "de", ""), (703, "word " * 5000, "de", "long"), (0, t[0], "en", "key"), (704, "中文 ÄÖ 😀", None, "u")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, key string").withColumn("span", F.lit(1)).withColumn("rank", F.lit(2)).cache()


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def sort_key(row):
    return tuple(map(str, row))


def test_pii_patterns():
    cases = {
        "a.b@c.de, x@y @z.de a@b.c@d.ef": ["email:0:8", "email:20:25"],
        "1.2.3.4.5.6.7.8 1.2.3.256 0001.2.3.4": ["ip:0:7", "ip:8:15", "ip:26:36"],
        "4111 1111-1111 1111 and 4111 1111 1111 1112": ["card:0:19"],
        "+1 (555) 123-4567 or +1 23": ["phone:0:17"],
        "é +441234567890": ["phone:2:15"],
        "": [],
    }
    for text, expected in cases.items():
        assert pii.rendered(pii.base_spans(text)).split(",") == (expected or [""]), text


def test_pii_patterns_like_a_scan():
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    r = random.Random(2)
    for _ in range(3000):
        t = "".join(r.choice("a1.2@-+ 3(9)b0é") for _ in range(r.randint(0, 60)))
        want = []
        for k, p in enumerate(patterns):
            for m in re.finditer(p, t):
                digits = re.sub(r"\D", "", m[0])
                if k == 1 and max(map(int, m[0].split("."))) > 255 or k == 2 and not (14 <= len(digits) <= 19 and pii.luhn(digits)) or k == 3 and not 10 <= len(digits) <= 15:
                    continue
                want.append((m.start(), k, m.end()))
        assert pii.base_spans(t) == sorted(want), t


def test_pii_discloses(spark, docs):
    rows = [(n, f"call zorblatt {w} now bob@mail.example.com thanks {w}") for n, w in enumerate(["alpha", "beta", "gamma", "delta", "omega"])]
    rows = [(n, t.replace("call", w).replace("now", v)) for (n, t), w, v in zip(rows, "ask see ring tell meet".split(), "then today soon here there".split(), strict=True)]
    rows += [(100 + n, f"common words stand in line {n} with nothing else") for n in range(400)] + [(900, "zorblatt lives here")]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), threshold=0.8).collect()}
    assert got[0]["n_email"] == 1 and "term:4:12" in got[0]["spans"]
    assert "zorblatt" not in got[900]["text"] and got[900]["n_term"] == 1
    assert got[150]["spans"] == "" and got[150]["text"] == rows[55][1]
    found = pii.find(docs, keep=("key",))
    assert found.count() == docs.count() and {r["text"] for r in found.filter("doc_id = 700").collect()} == {None}


def brute_terms(texts, threshold, support):
    """Disclosing words and cues by the definitions, over distinct lines (short ones, so each is a unit)."""
    units = {line for t in texts for line in t.split("\n")}
    n, holders, of_entity, of_word, both = len(units), {}, {}, {}, {}
    for u in units:
        base = pii.base_spans(u)
        free = lambda a, b: not any(x < b and a < y for x, _, y in base)  # noqa: B023, E731
        for m in re.finditer(r"(?<![\w-])[\w-]{16,}", u):
            cue = re.search(r"([^\W\d_]{2,})(\W{0,6})$", u[: m.start()])
            if cue and free(*m.span()) and re.search(r"\d", m[0]) and re.search(r"[^\W\d_]", m[0]):
                holders.setdefault(cue[1].lower() + "".join(cue[2].split()), {}).setdefault(m[0], set()).add(u)
        words = [(m[0].lower(), *m.span()) for m in re.finditer(r"[^\W\d_]{3,}", u)]
        for w, *_ in words:
            of_word.setdefault(w, set()).add(u)
        for a, k, b in base:
            e = (k, u[a:b].lower())
            of_entity.setdefault(e, set()).add(u)
            for i, (w, x, y) in enumerate(words):
                if free(x, y):
                    beside = (words[i - 1][0] if i else "", words[i + 1][0] if i + 1 < len(words) else "")
                    pair = both.setdefault((e, w), (set(), set()))
                    pair[0].add(u), pair[1].add(beside)
    out = set()
    for (e, w), (at, beside) in both.items():
        if min(len(at), len(beside), len(of_entity[e])) >= support:
            pmi = math.log2(n * len(at) / len(of_entity[e]) / len(of_word[w]))
            if pmi / math.log2(n / len(of_entity[e])) >= threshold:
                out.add((w, False))
    for cue, values in holders.items():
        m = [len(x) for x in values.values()]
        if sum(m) >= support and 1 - sum(x * math.log2(x) for x in m) / sum(m) / math.log2(sum(m)) >= threshold:
            out.add((cue, True))
    return out


def secret_texts():
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 6)))
    texts = [f"{word()} {word()} token = \"{r.randbytes(20).hex()}\" {word()}" for _ in range(12)]
    texts += [f"{word()} build {'0123abcd' * 3} {word()}" for _ in range(12)]  # one identifier of all: gives nothing away
    texts += [f"{word()} {word()} bob{n % 3}@mail.example.com zorblatt{'xyz'[n % 3]} {word()} {word()} the" for n in range(15)]
    texts += [f"{word()} the {word()} {word()}" for _ in range(400)]
    return ["\n".join(texts[n : n + 2]) for n in range(0, len(texts), 2)]


def test_pii_terms_by_brute_force(spark):
    texts = secret_texts()
    for threshold, support in ((0.8, 3), (0.9, 3), (0.9, 20), (0.5, 2)):
        got = pii.disclosing_terms(spark.createDataFrame([(t,) for t in texts], "text string"), threshold, support)
        assert {(x["term"], x["cue"]) for x in got.collect()} == brute_terms(texts, threshold, support)
    assert {('token="', True), ("zorblattx", False)} <= brute_terms(texts, 0.8, 3)


def test_pii_copies_disclose_nothing(spark):
    texts = secret_texts()
    more = texts + ["a filler line that says nothing"] * 5000 + texts[3:9] * 50
    terms = [{tuple(x) for x in pii.disclosing_terms(spark.createDataFrame([(t,) for t in x], "text string")).collect()} for x in (texts + ["a filler line that says nothing"], more)]
    assert terms[0] == terms[1] and terms[0]


def test_pii_secrets_go(spark, monkeypatch):
    rows = [(n, t, "clash") for n, t in enumerate(secret_texts())] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(map(tuple, pii.find(df).collect()), key=repr)
    assert len(got) == len(rows) and not any(re.search("[0-9a-f]{40}", x[1]) for x in got) and sum(x[6] for x in got) >= 24
    assert all("0123abcd" in x[1] for x in got if " build " in x[1])
    monkeypatch.setattr(pii, "MOST_TERMS", 0)  # texts and terms joined
    assert sorted(map(tuple, pii.find(df).collect()), key=repr) == got
    assert pii.find(df.limit(0)).collect() == []


def test_pii_of_very_many_spans():
    text = " ".join(f"user{n}@mail.example.com" for n in range(60_000))
    started = time.perf_counter()
    base = pii.base_spans(text)
    assert len(base) == 60_000 and pii._term_spans(text, {"user": False, "mail": False}, {}, base) == []
    assert time.perf_counter() - started < 10


def test_packing(spark, docs):
    path = registry.vocabulary("word_bpe_49k.json")
    got = packing.pack(docs, path, keep_ids=True).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    want = []
    for d, x in rows_of(docs):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want += [(d, n, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for n, at in enumerate(range(0, len(ids), 2048))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=sort_key) == sorted(want, key=sort_key)
    assert_packed([(r["sequence_id"], r["offset"], r["length"]) for r in got], 2048)
    assert packing.pack(docs.limit(0), path).count() == 0


def assert_packed(placed, capacity):
    bins = {}
    for s, o, n in placed:
        bins.setdefault(s, []).append((o, n))
    for own in bins.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    lengths = [r.randint(1, r.choice([40, 100])) for _ in range(r.randint(0, 400))]
    free, bins = [], 0
    for n in sorted(lengths, reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - n)
        else:
            bins += 1
            free.append(100 - n)
    counts = {n: lengths.count(n) for n in set(lengths)}
    placed = [(first + k // per, offset + k % per * n, n) for n, _, many, first, per, offset in packing.plan(counts, 100).tolist() for k in range(many)]
    assert sorted(n for _, _, n in placed) == sorted(lengths)
    assert assert_packed(placed, 100) == bins


def test_quality(docs):
    got = quality.judge(docs).collect()
    want = []
    for d, t in rows_of(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = {x for x in three if three.count(x) > 1} if len(w) < 1000 else {x for x in set(three) if three.count(x) > 1}
        covered = {i + k for i, x in enumerate(three) if x in twice for k in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered), failed))
    assert sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got), key=sort_key) == sorted(want, key=sort_key)
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert quality.judge(docs.limit(0)).count() == 0


def test_quality_divergence(spark):
    r = random.Random(4)
    good = [(n, " ".join(r.choice(quality.COMMON["en"] + ["house", "river", "stone"]) + r.choice(["", ""]) for _ in range(300)), "en") for n in range(40)]
    bad = [(100, " ".join(r.choice(["zq###", "kk$$$", "##%%", "pp***"]) + str(r.random())[2:6] for _ in range(300)), "en")]
    got = {x["doc_id"]: x for x in quality.judge(spark.createDataFrame(good + bad, "doc_id long, text string, lang string")).collect()}
    assert not got[100]["kept"] and not got[100]["base_failed"] and all(got[n]["kept"] for n in range(40))


PAGE = """<!DOCTYPE html><html><head><title>T t t</title><style>p{}</style><script>var a="</p>";</script></head><body><header>Site name</header><nav><ul><li><a href=/a>One</a><li><a>Two</a></ul></nav>
<div class="cookie-notice">We use cookies on this site to help you</div><article><h1>A  &amp; B</h1><p>First <b>bo</b>ld para&shy;graph with several words.<br>Next line.<p>Second &lt;one&gt; &#233;.
<aside>Related things here</aside><form>Mail <input></form><p>Last.</p><section id="comments"><p>I agree with all of this very much indeed.</p></section></article><footer>(c) us, all rights reserved for ever</footer>"""


def test_extraction(spark):
    rows = [(1, "u", PAGE, "t"), (2, None, None, "t"), (3, "v", "", "t"), (4, "w", "plain words only 1 < 2", "t"), (5, "x", "<div><p>unclosed <b>text", "t"), (6, "y", PAGE, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in extract.extract(df).collect()}
    assert got[1]["text"] == "A & B First bold para\xadgraph with several words. Next line. Second <one> é. Last."
    assert got[6]["text"] == got[1]["text"] and got[1]["n_chars"] == len(got[1]["text"])
    assert (got[2]["text"], got[3]["text"], got[4]["text"], got[5]["text"]) == ("", "", "plain words only 1 < 2", "unclosed text")
    assert extract.extract(df.limit(0)).count() == 0


def test_best_run():
    r = random.Random(5)
    for _ in range(300):
        s = [r.randint(-4, 4) for _ in range(r.randint(0, 12))]
        a, b = extract.best_run(s)
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1))])


def test_urls(spark):
    rows = [(1, "http://A.example.org/x?q", None), (2, "https://spam.net/a#f", '<link rel="canonical" href="http://good.org/de/1">'), (3, "http://good.org/de/1", None), (4, "http://far.org/2", '<META http-equiv="refresh" content="0; URL=/3">'), (5, "http://far.org/3", '<link href="http://good.org/de/1" rel=canonical>'), (6, None, None), (7, "nohost", None), (8, "http://www.example.net/en/1", None), (9, "http://ok.org/fr/9", '<link rel=canonical href=http://tie.org/1>'), (10, "http://tie.org/1", '<link rel=canonical href=http://bad.net/>'), (1, "http://A.example.org/x?q", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, registry.RULES, urls.page_edges(df)).collect()}
    assert got[1] == ("a.example.org", "/x", None, "allow")
    assert got[2] == ("spam.net", "/a", "net/", "block")
    assert got[3][2:] == (None, "block") and got[4][2:] == (None, "block") and got[5][2:] == (None, "block")
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[8][2:] == ("example.net/en/", "allow")
    assert got[9][2:] == ("org/fr/", "allow") and got[10][2:] == (None, "allow")  # an explicit allow among the aliases wins
    assert urls.judge(df.limit(0), registry.RULES, urls.page_edges(df.limit(0))).count() == 0


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(60)] + [(n, n + 1) for n in range(100, 160)] + [(200, n) for n in range(201, 260)] + [(None, 1), (5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {x["node"]: x["root"] for x in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for n in root}


def test_bpe(docs):
    import tiktoken

    path, pattern = registry.vocabulary("byte_bpe_multi_50k.tiktoken"), registry.pattern()
    ref = tiktoken.Encoding("ref", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    r = random.Random(7)
    codec = bpe.codec(path, pattern)
    odd = ["", "a  b\n\n c \t", "　 a b", "aaaa" * 200, "''s don't I'LL", "<|endoftext|>", "\x1c a\x1e", "ab\u0558c 1\U00012550\U000323b0 x"] + ["".join(r.choice("ab \n\t'sé1.! 中") for _ in range(r.randint(0, 50))) for _ in range(800)]
    for t, (found, d, back) in zip(odd, codec.slice(odd), strict=True):
        ids = ref.encode_ordinary(t)
        assert (found.tolist(), bytes(d), bytes(back)) == (ids, b"".join(b"%d," % i for i in ids), t.encode()), t
    got = bpe.digests(docs, path, pattern).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(d, len(i := ref.encode_ordinary(t or "")), sha(",".join(map(str, i)).encode()), sha((t or "").encode())) for d, t in rows_of(docs)]
    assert sorted(map(tuple, got), key=sort_key) == sorted(want, key=sort_key)
    assert bpe.encode(docs.filter("doc_id = 704"), path, pattern).first()["decoded"] == "中文 ÄÖ 😀"


def test_bpe_takes_the_lowest_rank_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 299, b"ab": 301, b"aa": 302}
    replay = bpe.Replay(ranks)

    def alone(word):
        parts = [bytes([b]) for b in word]
        while True:
            best = min(((ranks[parts[n] + parts[n + 1]], n) for n in range(len(parts) - 1) if parts[n] + parts[n + 1] in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    r = random.Random(8)
    words = [bytes(r.choice(b"abcx") for _ in range(r.randint(0, 14 if n % 4 else 3 * bpe.SHORT))) for n in range(400)]
    ids, counts = replay.encode(pa.array(words, pa.large_binary()))
    ends = np.cumsum(counts)
    assert [ids[b - n : b].tolist() for n, b in zip(counts, ends, strict=True)] == [[ranks[w]] if w in ranks else alone(w) for w in words]
    none, no_counts = replay.encode(pa.array([], pa.large_binary()))
    assert not len(none) and not len(no_counts)


def test_bpe_of_an_empty_table(spark):
    got = bpe.digests(spark.createDataFrame([], "doc_id long, text string, ids int"), registry.vocabulary("byte_bpe_multi_50k.tiktoken"), registry.pattern())
    assert got.collect() == [] and got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def brute_cut(rows, n=50):
    last = (1 << 63) - 1
    rows = [(last if d is None else d, d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, _, t in rows:
        for p in range(len(t) - n + 1):
            first[t[p : p + n]] = min(first.get(t[p : p + n], d), d)
    out = []
    for d, own, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - n + 1):
            if first[t[p : p + n]] < d:
                gone[p : p + n] = b"\1" * n
        runs = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out.append((own, len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=sort_key)


def test_suffixes(spark, docs):
    r = random.Random(3)
    base = ["".join(r.choice("ab c") for _ in range(r.randint(0, 300))) for _ in range(20)]
    rows = [(n * 3, "".join(r.choice(base)[r.randint(0, 100) :][: r.randint(0, 200)] + r.choice(["é", "x", "yz "]) for _ in range(r.randint(0, 4)))) for n in range(120)]
    rows += [(7, "a" * 400), (8, "ba" * 200), (5, "a" * 60), (9, None), (None, rows[3][1]), (11, "a" * 49)]
    for df, own in ((spark.createDataFrame(rows, "doc_id long, text string"), rows), (docs, rows_of(docs))):
        for limits in ({}, {"local": 1, "crowd": 2}):
            got = suffixes.cut_repeats(df, **limits).drop("text").collect()
            assert sorted(map(tuple, got), key=sort_key) == brute_cut(own)
    assert suffixes.cut_repeats(docs.limit(0), keep=("key",)).count() == 0


def cut_here(rows, n_buckets, local, crowd, length):
    """The passes of cut_repeats without Spark: the bytes that are left of each row."""
    tables = [pa.table({"doc_id": pa.array([d for d, _ in rows if d % n_buckets == b], pa.int64()), "text": pa.array([t for d, t in rows if d % n_buckets == b], pa.string())}) for b in range(n_buckets)]
    offers = pa.concat_tables(suffixes.offered(suffixes._Bucket(t, length, with_near=True), local) for t in tables)
    found = suffixes.compared(offers, crowd) if offers.num_rows else {c: np.zeros(0, np.int64) for c in ("key", "span", "doc", "first", "kind")}
    asked = (found["kind"] == suffixes._CROWDED) | (found["kind"] == suffixes._ASKED) & (found["doc"] == found["first"])
    at = {b: asked & (np.where(found["kind"] == suffixes._CROWDED, found["doc"], found["first"]) % n_buckets == b) for b in range(n_buckets)}
    spans = pa.concat_tables(suffixes.shown(t, pa.table({c: found[c][at[b]] for c in ("key", "span", "first", "kind")}), length) for b, t in enumerate(tables))
    masks = suffixes.decided(spans, length) if spans.num_rows else {c: np.zeros(0, np.int64) for c in ("key", "span", "doc", "mask")}
    out = []
    for b, t in enumerate(tables):
        one, two = found["doc"] % n_buckets == b, masks["doc"] % n_buckets == b
        n, m = int(one.sum()), int(two.sum())
        verdicts = pa.table({
            "key": np.concatenate([found["key"][one], masks["key"][two]]), "span": np.concatenate([found["span"][one], masks["span"][two]]),
            "doc": np.concatenate([found["first"][one], masks["doc"][two]]), "kind": np.concatenate([found["kind"][one], np.ones(m, np.int32)]),
            "mask": pa.array([None] * n + masks["mask"][two].tolist(), pa.int64()),
        })
        own = suffixes._Bucket(t, length)
        gone = suffixes.removed(own, verdicts, length)
        out += [(d, bytes(own.data[a : a + len(x)][~gone[a : a + len(x)]])) for d, a, x in zip(own.ids.tolist(), own.starts.tolist(), own.texts, strict=True)]
    return sorted(out)


def test_suffixes_crowded_minimisers():
    """Passages that many documents hold, each with its own surroundings; periodic texts; few and many buckets, all limits, several lengths."""
    r = random.Random(31)
    crowds = 0
    for turn in range(120):
        length = r.choice([16, 17, 30, 33, 50, 50, 50, 78])
        line = "".join(r.choice("abcdefgh ") for _ in range(r.randint(10, 120)))
        words = ["".join(r.choice("xyz é") for _ in range(r.randint(1, 30))) for _ in range(4)]
        part = lambda: r.choice([line, line[: r.randint(0, 120)], line[r.randint(0, 60) :], r.choice(words), "ab" * r.randint(1, 60), "=" * r.randint(0, 90), str(r.random())])  # noqa: B023, E731
        rows = [(d, "".join(part() for _ in range(r.randint(0, 6)))) for d in r.sample(range(200), 40)]
        rows += [(d, t) for d, t in rows[:3]]
        local, crowd = r.choice([(0, 0), (1, 2), (3, 5), (16, 1024), (1, 1024), (1000, 3)])
        first = {}
        raw = [(d, t.encode()) for d, t in rows]
        for d, t in raw:
            for p in range(len(t) - length + 1):
                first[t[p : p + length]] = min(first.get(t[p : p + length], d), d)
        want = []
        for d, t in raw:
            gone = bytearray(len(t))
            for p in range(len(t) - length + 1):
                if first[t[p : p + length]] < d:
                    gone[p : p + length] = b"\1" * length
            want.append((d, bytes(c for c, g in zip(t, gone, strict=True) if not g)))
            crowds += any(gone)
        assert cut_here(rows, r.choice([1, 2, 7, 40]), local, crowd, length) == sorted(want), (turn, length, local, crowd)
    assert crowds > 500


def test_suffix_order():
    r = random.Random(9)
    for _ in range(100):
        data = np.frombuffer(b"".join(bytes(r.choice(b"ab") for _ in range(r.choice([0, 14, 20, 50]))) + b"c" * r.randint(0, 50) + b"d" * 60 for _ in range(r.randint(1, 40))), np.uint8)
        starts = np.array(sorted(r.sample(range(len(data) - 50), min(60, len(data) - 50))), np.int64)
        order, classes = suffixes.suffix_classes(data, starts, 50)
        got = [bytes(data[starts[n] : starts[n] + 50]) for n in order]
        assert got == sorted(got) and all((got[i] == got[i - 1]) == (classes[i] == classes[i - 1]) for i in range(1, len(got)))


def test_langid(spark):
    r = random.Random(10)
    rows = [(n, " ".join(r.choice(quality.COMMON[g]) for _ in range(40)), g) for n, g in enumerate(["en", "fr", "de", "es"] * 60)]
    rows += [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.trained(df)
    got = {x["doc_id"]: x for x in langid.identify(df, *model, keep=("doc_id",)).collect()}
    right = [got[n]["lang_pred"] == g for n, _, g in rows[:240]]
    assert np.mean(right) > 0.97 and all(0 <= x["score"] <= 1 for x in got.values())
    assert {got[n]["lang_pred"] for n in (1000, 1001, 1002)} == {"und"}
    both = rows[0][1] * 3 + " " + rows[1][1] * 3
    shares = langid.identify(spark.createDataFrame([(both,)], "text string"), *model).first()["shares"]
    assert {"en", "fr"} <= set(shares) and abs(sum(shares.values()) - 1) < 1e-6
    assert langid.identify(df, *langid.learn(df.limit(0).select("text", "lang"))).filter("lang_pred <> 'und'").count() == 0
    assert all((zlib.crc32(str(n).encode()) % 4 == 2) == x["h"] for n, x in ((x["doc_id"], x) for x in df.select("doc_id", langid.held_out(F.col("doc_id")).alias("h")).collect()))


def brute_fingerprint(text, k):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    rows = rows_of(docs)
    fps = {n: brute_fingerprint(t, 3) for n, (_, t) in enumerate(rows)}
    root = list(range(len(rows)))
    for _ in rows:
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    least = {x: min((rows[n][0] for n in range(len(rows)) if root[n] == x and rows[n][0] is not None), default=None) for x in root}
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got), key=sort_key) == sorted(((rows[n][0], fps[n], least[root[n]]) for n in fps), key=sort_key)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def similarity(a, b):
    return len(a & b) / max(1, len(a | b))


def left_of(spark, rows):
    kept = simhash.near_copies_left(spark.createDataFrame(rows, "doc_id long, text string, u string").repartition(5))
    assert kept.columns == ["doc_id"]
    return [r["doc_id"] for r in kept.collect()]


def assert_one_of_each_group(rows, left):
    """What stays is the least id of each component of texts of similarity 0.8 or more; texts without words are one group."""
    shingles = {}
    for d, t, *_ in rows:
        if d is not None:
            shingles.setdefault(d, set()).update(simhash.shingle_hashes((t or "").encode(), 5).tolist())
    root = {d: d for d in shingles}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    ids = sorted(shingles, key=lambda d: len(shingles[d]))
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = shingles[a], shingles[b]
            if len(x) * 10 < len(y) * 8:
                break  # sorted by size
            if not x and not y or x and 10 * len(x & y) >= 8 * len(x | y):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    assert sorted(d for d in left if d is not None) == sorted({find(d) for d in shingles})


def edited(words, share, r):
    return [f"new{r.randrange(10**9)}" if r.random() < share else w for w in words]


@pytest.mark.parametrize("block", [2000, 20])
def test_near_copies_left(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(block)
    rows, groups = [], []
    for n, copies in enumerate((0, 1, 2, 5, 90)):
        words = [f"w{r.randrange(10**6)}" for _ in range(400)]
        ids = [1000 * n + k for k in range(copies + 1)]
        groups.append(ids)
        middle = len(ids) // 2  # the original is neither first nor last
        rows += [(d, " ".join(words if k == middle else edited(words, 0.005, r)), "x") for k, d in enumerate(ids)]
    rows += [(9001, None, "x"), (9002, "", None), (None, "no id", "x"), (9003, "one two", "x"), (9004, "one two", "x"), (9004, "one two", "x")]
    left = left_of(spark, rows)
    assert sorted(d for d in left if d is not None) == sorted([*(g[0] for g in groups), 9001, 9003]) and left.count(None) == 1
    assert_one_of_each_group(rows, left)
    assert left_of(spark, []) == []


def test_near_copies_at_the_limit(spark):
    """Pairs of long and of short texts a little over and a little under 0.8: nearly all of the first are found, none of the others goes."""
    r = random.Random(17)
    rows, over, under = [], set(), set()
    for n in range(240):
        size = (1500, 300, 60, 36, 30, 20)[n % 6]
        words = [f"w{r.randrange(10**6)}" for _ in range(size)]
        shingles = simhash.shingle_hashes(" ".join(words).encode(), 5).tolist()
        want, copy = n % 12 < 6, list(words)
        order = r.sample(range(size), size)
        for place in order:  # change words one by one until the similarity is just above or just below
            trial = [*copy]
            trial[place] = f"x{r.randrange(10**6)}"
            s = similarity(set(shingles), set(simhash.shingle_hashes(" ".join(trial).encode(), 5).tolist()))
            if s < 0.8:
                if not want:
                    copy = trial
                break
            copy = trial
        rows += [(2 * n, " ".join(words), "x"), (2 * n + 1, " ".join(copy), "x")]
        (over if want else under).add(2 * n + 1)
    left = set(left_of(spark, rows))
    assert under <= left
    assert len(over - left) >= 0.98 * len(over)


def test_quality_of_short_texts(spark):
    """Common words are judged from 50 words on, by a limit that narrows as texts grow."""
    r = random.Random(5)
    others = [f"stone{n}" for n in range(500)]
    said = lambda n, share: " ".join(r.choice(quality.COMMON["en"][:6] if r.random() < share else others) for _ in range(n))
    good = [(n, said(size, 0.4), "en") for n, size in enumerate([60, 90, 120, 140, 200, 400] * 30)]
    bad = [(1000 + n, said(size, 0.0), "en") for n, size in enumerate([110, 130, 149, 200, 300])]
    got = {x["doc_id"]: x for x in quality.judge(spark.createDataFrame(good + bad, "doc_id long, text string, lang string")).collect()}
    assert not any(x["base_failed"] for x in got.values())
    assert all(got[d]["kept"] for d, *_ in good) and not any(got[d]["kept"] for d, *_ in bad)


@pytest.mark.parametrize("block", [1000, 50])
def test_similar_across_blocks(spark, monkeypatch, block):
    """The groups are those of comparing all pairs of a key, whatever its size: strangers, a chain, and families joined by one link of two outliers."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = np.random.default_rng(13)
    def changed(wide, share):
        bits = np.unpackbits(wide.view(np.uint8))
        bits[r.choice(1024, int(1024 * share), replace=False)] ^= 1
        return np.packbits(bits).view(np.uint64)

    made = []
    for key in range(4):
        one = r.integers(0, 1 << 63, simhash.PARTS, dtype=np.uint64)
        out = changed(one, 0.1)
        other_out = changed(out, 0.15)
        two = changed(other_out, 0.1)
        made += [(w, key) for w in (one, out, other_out, two, *(changed(w, 0.07) for w in (one, two) for _ in range(100)))]
    chain = [two]
    for _ in range(120):
        chain.append(changed(chain[-1], 0.14))
    made += [(w, 4) for w in chain[1:]] + [(r.integers(0, 1 << 63, simhash.PARTS, dtype=np.uint64), 4) for _ in range(30)]
    rows = [(int(d), w, k) for d, (w, k) in zip(r.permutation(len(made)), made, strict=True)]
    found = simhash.similar(spark.createDataFrame([(d, (1000).to_bytes(4, "little") + w.tobytes(), [k]) for d, w, k in rows], "node long, sketch binary, keys array<long>"))
    got = {r["node"]: r["root"] for r in graph.components(found).collect()}
    want = {d: d for d, _, _ in rows}
    for key in range(5):
        ids = sorted(((d, w) for d, w, k in rows if k == key), key=lambda x: x[0])
        wides = np.array([w for _, w in ids])
        held = simhash.Sketches([(1000).to_bytes(4, "little") + w.tobytes() for w in wides])
        near = np.array([held.distances(n, np.arange(len(wides))) < np.inf for n in range(len(wides))])
        label = np.arange(len(ids))
        while (least := np.where(near, label, len(ids)).min(1)).tolist() != label.tolist():
            label = least
        want |= {d: ids[n][0] for (d, _), n in zip(ids, label.tolist(), strict=True)}
    assert len(set(want.values())) == 4 + 1 + 30
    assert {d: got.get(d, d) for d in want} == want


def test_near_copies_left_of_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()]
    assert_one_of_each_group(rows, left_of(spark, rows))


def test_golay_links_all(spark):
    r = random.Random(11)
    base = [r.getrandbits(64) for _ in range(150)]
    fps = base + [b ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(4)]
    signed = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 3}
    got = {(x["u"], x["v"]) for x in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    assert got == want and want


def best_five(rows):
    ok = [(n, np.floor(256 * np.float32(v).astype(float)).astype(int)) for n, v in rows if n is not None and v and None not in v and np.isfinite(v).all()]
    want = []
    for q, x in {(n, tuple(v)) for n, v in ok if n % 50 == 0}:
        best = sorted((-int(np.array(x) @ y), n) for n, y in ok if n != q)[:5]
        want += [(q, k, n, -s) for k, (s, n) in enumerate(best, 1)]
    return sorted(want)


def top_five(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    return sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect()))


def test_topk(spark):
    r = np.random.default_rng(12)
    rows = [(n, [float(x) for x in np.round(r.normal(size=6), 2)]) for n in range(300)] + [(n, [1.0] * 6) for n in range(300, 340)]
    rows += [(350, None), (400, [float("nan")] * 6), (401, [1.0, None] * 3), (None, [1.0] * 6), (450, [0.0] * 6)]
    assert top_five(spark, rows) == best_five(rows)


def test_topk_over_several_blocks(spark, monkeypatch):
    """Groups of near copies, ties across blocks, repeated rows; each query block is asked of each block."""
    monkeypatch.setattr(topk, "CANDIDATES", 60)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "MANY", 5)
    r = np.random.default_rng(3)
    middles = r.normal(size=(8, 5))
    rows = [(n, [float(x) for x in np.round(middles[n % 8] * 3 + r.normal(size=5) * 0.02, 3)]) for n in range(600)]
    rows += rows[7:13] * 3 + [rows[100]] * 2 + [(n, [2.0, -1.0, 0.0, 0.5, 1.0]) for n in range(600, 660)]
    assert top_five(spark, rows) == best_five(rows)


def test_topk_empty(spark):
    assert top_five(spark, []) == [] and top_five(spark, [(50, [1.0])]) == []


def test_topk_bound_spares_work():
    """A walk stops before most candidates are scored, a block that can't hold a winner is left at once; whole numbers beyond doubles are exact."""
    r = np.random.default_rng(5)
    values = (r.normal(size=(4000, 2)) * 500).astype(np.int64)
    for scale in (1, 1 << 20):
        lists = topk.Lists(values * scale, np.arange(4000))
        exact = (values.astype(object) * scale) @ (values[:40].astype(object) * scale).T
        floor = np.array([sorted(exact[:, q])[-6] for q in range(40)], float)
        got = lists.top(values[:40] * scale, np.arange(40), floor, 5)
        for q in range(40):
            assert [(s, i) for s, i, _ in got[q]] == [(-s, i) for s, i in sorted((-exact[i, q], i) for i in range(4000) if i != q)[:5]]
        assert lists.scored < 0.5 * 40 * 4000
    far = topk.Lists(np.abs(values) * -1, np.arange(4000))
    assert far.top(np.abs(values[:40]) + 1, np.arange(40) - 100, np.ones(40), 5) == [[]] * 40 and not far.scored


def test_packing_refuses_another_splitter(tmp_path):
    import json

    file = json.loads(open(registry.vocabulary("word_bpe_49k.json"), encoding="utf-8").read())
    file["normalizer"] = None
    (tmp_path / "v.json").write_text(json.dumps(file))
    with pytest.raises(ValueError, match="normalizes or cuts"):
        packing.WordEncoder(str(tmp_path / "v.json"))


def test_deep_markup_in_linear_time():
    """Stray end tags over many open elements."""
    page = "<body><article>" + "<b>word " * 30_000 + "</i>" * 30_000
    started = time.perf_counter()
    assert len(extract.main_text(page, {}).split()) == 30_000 and time.perf_counter() - started < 10


def test_quality_judges_rows_without_a_label(spark):
    r = random.Random(5)
    prose = lambda: " ".join(r.choice(quality.COMMON["en"]) if n % 2 else "word" + r.choice("abcdefgh") + r.choice("abcdefgh") for n in range(200))
    junk = lambda: " ".join("".join(r.choice("#0123456789XQ%") for _ in range(7)) for _ in range(200))
    rows = [(n, prose(), "en") for n in range(50)] + [(100, prose(), None), (101, junk(), None), (102, junk(), "en"), (103, junk(), "xx"), (104, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in quality.judge(df).collect()}
    assert got[100]["kept"] and not got[101]["kept"] and not got[102]["kept"] and got[101]["chars_distance"] is not None
    assert got[104]["base_failed"] and not got[104]["kept"] and quality.judge(df.limit(0)).collect() == []


def test_langid_refuses_labels_without_end(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    rows = spark.createDataFrame([(f"text {n}", f"l{n}") for n in range(5)], "text string, lang string")
    with pytest.raises(ValueError, match="different labels"):
        langid.learn(rows)
    assert len(langid.learn(rows.limit(3))[0]) == 3


def test_langid_on_the_test_table(spark):
    """All labelled rows that weren't learned from: 0.99 right at least."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs.filter(langid.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike("[a-z]")), *langid.trained(docs), keep=("lang",))
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.99
