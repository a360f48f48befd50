"""Language identification as a mixture of languages.

A text is a bag of byte trigrams of its lower-cased letters and blanks. Each
language has trigram likelihoods, hashed into `BUCKETS` cells and learned from
labelled rows. Expectation-maximisation gives the text's proportions of
languages; languages enter the set one by one, the likeliest first, while the
mixture's log-likelihood grows by more than the penalty for a parameter (half
the log of the number of trigrams). The largest share in that set is the
prediction and its score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import lean

BUCKETS = 1 << 15
#: Labelled documents of a language that are learned from, about: with more, so many are drawn by a hash of their text.
SAMPLE = 4000
#: More labels than this can't be languages; learning from them fails instead of leaving some out.
MOST_LANGUAGES = 1000
#: Steps of expectation-maximisation.
STEPS = 12
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[[b for b in range(128) if not 97 <= b <= 122]] = 32


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the text's trigrams and how often each occurs."""
    data = _BLANK[np.frombuffer(b" " + text.lower().encode(errors="replace") + b" ", np.uint8)].astype(np.uint32)
    code = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    code = code[(data[:-2] != 32) | (data[1:-1] != 32)]
    code = code[(code & 0xFFFF) != 0x2020]
    cells = (code * np.uint32(2654435761)) >> np.uint32(17)
    counts = np.bincount(cells, minlength=1)
    distinct = np.flatnonzero(counts)
    return distinct, counts[distinct]


def mixture(likelihood: np.ndarray, counts: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares of the languages after EM from `share`, and the log-likelihood. likelihood: cells x languages."""
    for _ in range(STEPS):
        joint = likelihood * share
        share = (counts / joint.sum(1)) @ joint / counts.sum()
    return share, float(counts @ np.log((likelihood * share).sum(1)))


def mixed(log_likelihood: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Shares of all languages; zero outside the chosen set. log_likelihood: cells x languages."""
    n = log_likelihood.shape[1]
    single = counts @ log_likelihood
    shares = np.zeros(n)
    best = int(np.argmax(single))
    shares[best] = 1.0
    if n == 1 or not counts.sum():
        return shares
    likelihood = np.exp(log_likelihood)
    penalty = 0.5 * np.log(max(2, counts.sum()))
    rough, _ = mixture(likelihood, counts, np.full(n, 1 / n))
    chosen, value = [best], single[best]
    for language in np.argsort(-rough, kind="stable").tolist():
        if language == best:
            continue
        trial = [*chosen, language]
        share, now = mixture(likelihood[:, trial], counts, np.full(len(trial), 1 / len(trial)))
        if now - value <= penalty:
            break
        chosen, value = trial, now
        shares[:] = 0
        shares[trial] = share
    return shares


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log-likelihoods (cells x languages), from rows (text, lang) without nulls.

    Languages are counted over all rows. Of a language with more than SAMPLE
    rows about SAMPLE are drawn by a hash of the text. The driver gets
    a count for each language and cell at most.
    """
    sizes = labelled.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} different labels")
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return [], np.zeros((BUCKETS, 0))
    bound = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, SAMPLE / r["count"])))])
    drawn = labelled.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.try_element_at(bound, F.col("lang")) * (1 << 20))
    place = {lang: n for n, lang in enumerate(languages)}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(place), BUCKETS), np.int64)
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                cells, counts = trigrams(text)
                sums[place[lang], cells] += counts
        lang, cell = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(sums[lang, cell])], names=["lang", "cell", "n"])

    rows = drawn.select("text", "lang").mapInArrow(lean(of), "lang int, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((BUCKETS, len(languages)))
    counts[rows["cell"].to_numpy(np.int64), rows["lang"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    smooth = counts + 0.2
    return languages, np.log(smooth / smooth.sum(0))


def identify(docs: DataFrame, languages: list[str], model: np.ndarray, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(lang_pred, score, shares map<string,double> [, keep...]): one row for each row of docs.

    `und`, score 0 and no shares: the text is null or has no letter, or nothing
    was learned. Only the text is looked at. Whole texts of any length; memory
    is that of the longest one.
    """
    kept_schema = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    own = text_col if text_col in keep else "__text"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(own).to_pylist():
                if not languages or not text or not any(map(str.isalpha, text)):
                    out.append(("und", 0.0, []))
                    continue
                cells, counts = trigrams(text)
                shares = mixed(model[cells], counts.astype(float))
                top = int(np.argmax(shares))
                out.append((languages[top], min(1.0, float(shares[top])), [(languages[n], float(shares[n])) for n in np.flatnonzero(shares).tolist()]))
            made = [pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.float64()), pa.array([r[2] for r in out], pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*made, *(batch.column(c) for c in keep)], names=["lang_pred", "score", "shares", *keep])

    sent = keep if text_col in keep else (*keep, text_col)  # the text once
    columns = [F.col(c).cast("string").alias(own) if c == text_col and c not in keep else F.col(c) for c in sent]
    return docs.select(*columns).mapInArrow(lean(of), "lang_pred string, score double, shares map<string,double>" + kept_schema)


def held_out(doc_id: Column) -> Column:
    """Rows that aren't learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def trained(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """learn() from the rows of documents that aren't held out and have a text and a language."""
    return learn(docs.filter(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang"))
