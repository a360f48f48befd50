"""The corpus pipeline, each stage held against a plain version on its own input, and run() against the stages one by one."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import assert_one_of_each_group, assert_packed, brute_cut, brute_terms, sort_key

import corpus_pipeline
from clickloom.llm import langid, registry


def fixture_rows():
    """Four invented languages; copies, near copies, shared passages, personal data, secrets, nulls, rows without an id, repeated rows."""
    r = random.Random(40)
    letters = {"aa": "abcde", "bb": "fghij", "cc": "klmno", "dd": "pqrst"}
    words = {g: ["".join(r.choice(x) for _ in range(r.randint(2, 7))) for _ in range(60)] for g, x in letters.items()}
    said = lambda g, n: " ".join(r.choice(words[g]) for _ in range(n))
    rows = [(n, said(g, r.randint(20, 120)), g) for n, g in enumerate([*letters] * 25)]
    passage = said("aa", 40)
    rows += [(200 + n, f"{said('aa', 15)} {passage} {said('aa', 15)}", "aa") for n in range(6)]
    rows += [(220 + n, rows[n][1] + " " + said("bb", 1), rows[n][2]) for n in range(8)] + [(240 + n, rows[n][1], rows[n][2]) for n in range(5)]
    rows += [(260 + n, f"{said('cc', 20)}\nmail x{n}@mail.example.com or 10.0.0.{n}\n{said('cc', 20)}", "cc") for n in range(5)]
    rows += [(280 + n, f"{said('dd', 20)}\ntoken = \"{r.randbytes(20).hex()}\" {said('dd', 2)}", "dd") for n in range(5)]
    rows += [(300, None, "aa"), (301, "", None), (302, "12 34", "bb"), (None, said("bb", 40), "bb"), (None, said("bb", 40), None), (7, rows[7][1], rows[7][2])]
    return [(d, t, g, "s", len(t or "")) for d, t, g in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(fixture_rows(), "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(str(out / "documents.parquet"))
    return str(out)


def plain_language(languages, model, text):
    """Greedy sets of languages by expectation-maximisation, written out; model: cells x languages of log-likelihoods."""
    if not text or not any(c.isalpha() for c in text):
        return "und"
    cells, counts = langid.trigrams(text)
    logs = model[cells]

    def fit(chosen):
        share = [1 / len(chosen)] * len(chosen)
        rows = [[math.exp(x[c]) for c in chosen] for x in logs]
        for _ in range(langid.STEPS):
            new = [0.0] * len(chosen)
            for row, n in zip(rows, counts, strict=True):
                total = sum(s * p for s, p in zip(share, row, strict=True))
                for k, p in enumerate(row):
                    new[k] += n * share[k] * p / total
            share = [x / counts.sum() for x in new]
        return share, sum(n * math.log(sum(s * p for s, p in zip(share, row, strict=True))) for row, n in zip(rows, counts, strict=True))

    every = range(len(languages))
    single = [float(counts @ logs[:, k]) for k in every]
    best = max(every, key=lambda k: single[k])
    chosen, value, shares = [best], single[best], [1.0]
    rough, _ = fit(list(every))
    for k in sorted(every, key=lambda k: -rough[k]):
        if k != best:
            share, now = fit([*chosen, k])
            if now - value <= 0.5 * math.log(max(2, counts.sum())):
                break
            chosen, value, shares = [*chosen, k], now, share
    return languages[chosen[int(np.argmax(shares))]]


def collected(df):
    return sorted(map(tuple, df.select("doc_id", "text", "lang").collect()), key=repr)


def test_stages_by_brute_force(spark, folder, tmp_path):
    given = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def step(name, docs):
        stages[name](spark, docs, folder).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or out.columns == corpus_pipeline.COLUMNS and out.filter("n_chars <> length(text)").isEmpty()
        return out

    first = step("language", given)
    model = langid.trained(given)
    want = [(d, t, g) for d, t, g in ((d, t, plain_language(*model, t)) for d, t, *_ in fixture_rows()) if g != "und"]
    assert collected(first) == sorted(want, key=repr) and len(want) == len(fixture_rows()) - 3

    second = step("near_duplicates", first)
    before, after = collected(first), collected(second)
    ids = {d for d, *_ in after}
    assert after == [x for x in before if x[0] in ids] and sum(d is None for d, *_ in after) == 2
    assert_one_of_each_group(before, sorted(d for d in ids if d is not None))
    assert len(ids) < len({d for d, *_ in before})

    third = step("repeated_passages", second)
    cut = {}
    for d, size, gone, *_ in brute_cut([(d, t) for d, t, _ in after]):
        cut.setdefault(d, []).append(size - gone)
    assert sorted(len(t.encode()) for _, t, _ in collected(third)) == sorted(n for own in cut.values() for n in own if n) and sum(x[1] != y[1] for x, y in zip(after, collected(third), strict=False)) > 0

    fourth = step("private_data", third)
    texts = [t for _, t, _ in collected(third)]
    terms = brute_terms(texts, 0.9, 3)
    assert ('token="', True) in terms

    def clean(t):
        for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("ip", r"\d+\.\d+\.\d+\.\d+"), ("term", r'(?<=token = ")[0-9a-f]{40}')):
            t = re.sub(pattern, f"<{kind}>", t)
        words = {w for w, cue in terms if not cue}
        return re.sub(r"(?<!<)[^\W\d_]{3,}(?!>)", lambda m: "<term>" if m[0].lower() in words else m[0], t)

    assert sorted(t for _, t, _ in collected(fourth)) == sorted(map(clean, texts)) and sorted(texts) != sorted(map(clean, texts))

    last = step("packing", fourth).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(registry.vocabulary("word_bpe_49k.json"))
    pieces = []
    for d, t, _ in collected(fourth):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        pieces += [(d, n, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for n, at in enumerate(range(0, len(ids), 2048))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in last), key=sort_key) == sorted(pieces, key=sort_key)
    assert_packed([(r["sequence_id"], r["offset"], r["length"]) for r in last], 2048)
    run = corpus_pipeline.run(spark, folder).collect()
    assert sorted(tuple(r)[:5] for r in run if r["doc_id"] is not None) == sorted(tuple(r)[:5] for r in last if r["doc_id"] is not None) and len(run) == len(last)


def test_no_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.isEmpty() and (name == "packing" or out.columns == corpus_pipeline.COLUMNS), name


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
