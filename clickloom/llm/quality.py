"""Quality rules: counts, and how far a text's distributions are from its language's.

All of it is DataFrame expressions. Two histograms are compared with those of
the references by Jensen-Shannon distance: character classes, and common words.
A reference is pooled over all rows of a language that pass the base rules,
weighting each by its length; rows of languages without a word list make one
more reference together. A text is held against the nearest of all references,
so its own label isn't needed. Short texts are guarded: a histogram of too few characters is
not judged, and the limit for common words is wider the fewer words there are,
as the distance that sampling alone makes is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import SPACES, staged, whole

#: Frequent words of the reference languages, as general word-frequency lists have them.
COMMON = {
    "en": "the of and to in a is that it for on was with be as this by are at from or have an not which".split(),
    "fr": "de la le et les des en un une du que est pour qui dans par pas sur au avec ce il elle plus ne".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus".split(),
}
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Classes in the order in which they are taken out of a text; what is left is "other".
CLASSES = {"space": BLANKS, "lower": "abcdefghijklmnopqrstuvwxyz", "symbol": SYMBOLS, "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "punctuation": "!\"'()+,-./:;=?@[\\]^_`{}~"}
#: Largest Jensen-Shannon distance of character classes to the nearest reference that a text may have; the characters and words it must hold to be judged.
MAX_CHARS, MIN_CHARS, MIN_WORDS = 0.28, 400, 50
#: Rows that make a reference, at least.
MIN_ROWS = 20
#: Of n words from a reference itself, 1 / distance^2 grows in proportion to n, from a start: (a, b) allow common words a distance of 1 / sqrt(a + b n).
WORDS_LIMIT = (6.5, 0.03)


def common_words() -> list[str]:
    words = sorted({w for own in COMMON.values() for w in own})
    return words + [w.capitalize() for w in words]


def with_counts(docs: DataFrame, text: Column) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars (array<bigint>), common and n_common (words met, and how often)."""
    rows = docs.withColumn("_t", whole(text))
    rows = rows.withColumn("_l0", F.length("_t"))
    left = "_t"
    for n, (_, letters) in enumerate(CLASSES.items(), 1):
        rows = rows.withColumn(f"_t{n}", F.translate(left, letters, "")).withColumn(f"_l{n}", F.length(f"_t{n}"))
        rows = rows.drop(left) if n > 1 else rows
        left = f"_t{n}"
    rows = rows.drop(left)
    n = len(CLASSES)
    sizes = [F.col(f"_l{k}") - F.col(f"_l{k + 1}") for k in range(n)] + [F.col(f"_l{n}")]
    names = list(CLASSES)
    symbols, spaces = sizes[names.index("symbol")], sizes[names.index("space")]
    rows = rows.withColumn("chars", F.array(*[x.cast("long") for x in sizes])).withColumn("n_symbols", symbols.cast("long")).withColumn("word_chars", (F.col("_l0") - spaces).cast("long"))
    rows = rows.drop(*[f"_l{k}" for k in range(n + 1)])
    bare = F.btrim("_t", F.lit(BLANKS))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    rows = rows.withColumn("_lines", F.when(F.col("_t").contains("\n"), lines).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    rows = rows.withColumn("_bare", bare).drop("_t")
    rows = rows.withColumn("_w", F.when(F.col("_bare") == "", F.array().cast("array<string>")).otherwise(F.split("_bare", SPACES))).drop("_bare")
    rows = rows.withColumn("n_words", F.size("_w").cast("long"))
    three = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    rows = rows.withColumn("_h", F.when(F.col("n_words") >= 3, three).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("_s", F.array_sort(F.filter("_w", lambda w: w.isin(common_words())))).drop("_w")
    rows = rows.withColumn("common", F.array_distinct("_s"))
    rows = rows.withColumn("_p", F.transform("common", lambda w: F.array_position("_s", w)))
    n_common = F.transform("_p", lambda p, k: F.coalesce(F.get("_p", k + 1), F.size("_s") + 1) - p)
    rows = rows.withColumn("n_common", n_common.cast("array<bigint>")).drop("_p")
    # all other words are one more bin, under the empty word
    rest = F.array(F.col("n_words") - F.size("_s"))
    rows = rows.withColumn("common", F.concat("common", F.array(F.lit("")))).withColumn("n_common", F.concat("n_common", rest)).drop("_s")
    # windows found twice or more: sort (hash, place), keep those with an equal neighbour, sum what their places cover
    placed = F.array_sort(F.transform("_h", lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
    rows = rows.withColumn("_r", F.when(F.size("_h") > F.size(F.array_distinct("_h")), placed)).drop("_h")
    twice = F.filter("_r", lambda x, k: (F.get("_r", k - 1)["h"] == x["h"]) | (F.coalesce(F.get("_r", k + 1)["h"] == x["h"], F.lit(False))))
    rows = rows.withColumn("_r", F.sort_array(F.transform(twice, lambda x: x["k"])))
    covered = F.aggregate(F.transform("_r", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_r", k + 1), p + 3) - p)), F.lit(0).cast("int"), lambda a, x: (a + x).cast("int"))
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_r")


def _references(counted: DataFrame, lang: str) -> tuple[dict[str, list[float]], dict[str, dict[str, float]]]:
    """Of each reference: shares of character classes, and of common words. A bounded number of rows reaches the driver."""
    own = F.when(F.col(lang).isin(list(COMMON)), F.col(lang)).otherwise("other")
    known = counted.filter(F.col(lang).isNotNull() & ~F.col("base_failed")).withColumn(lang, own)
    sizes = {r[lang]: r["count"] for r in known.groupBy(lang).count().collect()}
    known = known.filter(F.col(lang).isin([x for x, n in sizes.items() if n >= MIN_ROWS]))
    sums = [F.sum(F.get("chars", F.lit(k))).alias(f"c{k}") for k in range(len(CLASSES) + 1)]
    chars = {r[lang]: [float(r[f"c{k}"]) for k in range(len(CLASSES) + 1)] for r in known.groupBy(lang).agg(*sums).collect()}
    chars = {x: [v / sum(c) for v in c] for x, c in chars.items() if sum(c)}
    pairs = known.select(lang, F.explode(F.arrays_zip("common", "n_common")).alias("x")).groupBy(lang, "x.common").agg(F.sum("x.n_common").alias("n")).collect()
    words: dict[str, dict[str, float]] = {x: {} for x in chars}
    for r in pairs:
        words.setdefault(r[lang], {})[r["common"]] = float(r["n"])
    words = {x: {w: v / sum(c.values()) for w, v in c.items()} for x, c in words.items() if c}
    return chars, words


def _half(p: Column, m: Column) -> Column:
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)


def _chars_distance(reference: list[float]) -> Column:
    total = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x).cast("double")
    parts = []
    for k, q in enumerate(reference):
        p = F.get("chars", F.lit(k)) / total
        m = (p + q) / 2
        parts.append(_half(p, m) + (_half(F.lit(q), m)))
    divergence = parts[0]
    for x in parts[1:]:
        divergence = divergence + x
    return F.sqrt(F.greatest(F.lit(0.0), divergence / 2))


def _word_distances(words: dict[str, dict[str, float]]) -> Column:
    """Jensen-Shannon distances to all references: an array in their order."""
    langs = list(words)
    table = F.create_map(*[x for w in sorted({w for c in words.values() for w in c}) for x in (F.lit(w), F.array(*[F.lit(words[g].get(w, 0.0)) for g in langs]))])
    total = F.aggregate("n_common", F.lit(0).cast("long"), lambda a, x: a + x).cast("double")
    zero = F.array(*[F.lit(0.0) for _ in langs])

    # a reference's words that the text lacks add half their share: 1/2 of what the text's words leave of it
    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return (_half(p, m) + _half(q, m) - q) / 2

    row = F.transform("common", lambda w, k: F.struct((F.get("n_common", k) / total).alias("p"), F.try_element_at(table, w).alias("q")))
    summed = F.aggregate(row, zero, lambda a, x: F.zip_with(a, F.coalesce(x["q"], zero), lambda s, q: s + term(x["p"], q)))
    return F.transform(summed, lambda s: F.sqrt(F.greatest(F.lit(0.0), s + 0.5)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_chars: float = MAX_CHARS, words_limit: tuple[float, float] = WORDS_LIMIT, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, chars_distance, words_distance): a row for each row.

    base_failed: under 50 words, or over half of them in repeated three-word
    windows. kept: not base_failed, and no judged histogram lies further from
    every reference than its limit, which for words depends on how many there
    are. Distances are null where not judged: the
    text is short, or there is no reference at all. Null texts have no words.
    Repeated rows are judged alike. No rows: no rows.
    """
    counted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = staged(with_counts(counted, F.col("_text")).drop("_text").withColumn("base_failed", failed))
    chars, words = _references(counted, "_lang")
    no = F.lit(None).cast("double")
    enough = F.col("n_words") >= min_words
    far_chars = F.least(*[_chars_distance(q) for q in chars.values()]) if len(chars) > 1 else _chars_distance(*chars.values()) if chars else no
    far_words = F.array_min(_word_distances(words)) if words else no
    out = counted.withColumn("chars_distance", F.when(F.col("word_chars") >= min_chars, far_chars).otherwise(no))
    out = out.withColumn("words_distance", F.when(enough, far_words).otherwise(no))
    near = (F.coalesce("chars_distance", F.lit(0.0)) <= max_chars) & (F.coalesce("words_distance", F.lit(0.0)) <= 1 / F.sqrt(words_limit[0] + words_limit[1] * F.col("n_words")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & near).alias("kept"), "chars_distance", "words_distance")
