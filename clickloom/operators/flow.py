"""Ordered operators: chunks, last points, alerts, rate limits, words."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words too common to count.
STOP_WORDS = "a an and are as be for if in is it of or py rst the to with".split()


def chunks(rows: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """rows with chunk: slices of `size` rows of each key, in order."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1) / size))


def numbered(rows: DataFrame, order: str, name: str = "n", parts: int = 200) -> DataFrame:
    """rows with their place (from 0) in the order of a column of numbers, times or strings, ties in any order; nulls come first.

    Percentiles cut the column into about equal ranges. Rows are sorted and
    counted within their range, and ranges' counts are summed up, so that no
    task holds more than a range. Of strings the first seven bytes are ranged.
    """
    column = F.col(order)
    kind = rows.schema[order].dataType.typeName()
    if kind == "string":
        rank = F.conv(F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    else:
        rank = F.unix_micros(column.cast("timestamp")) if kind in ("timestamp", "timestamp_ntz", "date") else column.cast("double")
    ranked = rows.withColumn("_rank", rank)
    bounds = ranked.agg(F.percentile_approx("_rank", [k / parts for k in range(1, parts)], 10 * parts).alias("_bounds"))
    ranged = ranked.crossJoin(F.broadcast(bounds)).withColumn("_range", F.when(column.isNull(), F.lit(-1)).otherwise(F.size(F.filter("_bounds", lambda b: b < F.col("_rank"))))).drop("_bounds", "_rank")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select(F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(column.asc_nulls_first()))
    return ranged.withColumn("_within", within - 1).join(F.broadcast(sizes), F.col("_range") == F.col("_r")).withColumn(name, F.col("_before") + F.col("_within")).drop("_range", "_within", "_r", "_before")


def row_blocks(rows: DataFrame, order: str, n: int) -> DataFrame:
    """rows with block: n near-equal runs in order, the first ones a row longer."""
    total = F.broadcast(rows.agg(F.floor(F.count("*") / n).alias("_short"), (F.count("*") % n).alias("_longer")))
    at, short, longer = F.col("_at"), F.col("_short"), F.col("_longer")
    first = longer * (short + 1)  # rows of the longer runs
    block = F.when(at < first, F.floor(at / (short + 1))).otherwise(longer + F.floor((at - first) / F.nullif(short, F.lit(0))))
    return numbered(rows, order, "_at").crossJoin(total).withColumn("block", block.cast("int")).drop("_at", "_short", "_longer")


def column_blocks(names: DataFrame, k: int) -> DataFrame:
    """(idx, feature) with block: k near-equal ranges of columns, bounds at the floor of equal steps."""
    total = F.broadcast(names.agg(F.count("*").alias("_n")))
    # the greatest b with floor(n * b / k) at or below idx
    return names.crossJoin(total).withColumn("block", (F.ceil((F.col("idx") + 1) * k / F.col("_n")) - 1).cast("int")).drop("_n")


def last_points(series: DataFrame, n: int) -> DataFrame:
    """The n newest points of each series (series, ts, value), without the trailing run of null or zero values; place 1 is the newest."""
    newest = Window.partitionBy("series").orderBy(F.desc("ts"))
    # a series' last good point is an aggregate; with it gone from the window, only n rows of each task's series are sorted on
    good = series.filter("value <> 0").groupBy(F.col("series").alias("_s")).agg(F.max("ts").alias("_last"))
    rows = series.join(good, F.col("series").eqNullSafe(F.col("_s")) & (F.col("ts") <= F.col("_last"))).drop("_s", "_last")
    return rows.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= n)


def alerts(series: DataFrame, n: int, threshold: float, above: bool = True, empty_is_alert: bool = True) -> DataFrame:
    """(series, alert): all of the last n points beyond the threshold."""
    beyond = (F.col("value") > threshold) if above else ~(F.col("value") > threshold)
    seen = last_points(series, n).groupBy("series").agg(F.bool_and(F.coalesce(beyond, F.lit(False))).alias("all"))
    return series.select("series").distinct().join(seen, "series", "left").select("series", F.coalesce("all", F.lit(empty_is_alert)).alias("alert"))


def bucket_step(level: float, last: float | None, now: float, rate: float, per: float) -> tuple[float, bool]:
    """A token bucket's level after an event, and whether it passes."""
    level = rate if last is None else min(rate, level + (now - last) * rate / per)
    return (level - 1, True) if level >= 1 else (level, False)


def token_bucket(events: DataFrame, key: str, ts: str, order: str, rate: float, per: float) -> DataFrame:
    """Events that a bucket of `rate` tokens for each `per` seconds lets pass, by key, in event time. A key's events are one group."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([ts, order])
        level, last, passed = rate, None, []
        for now in group[ts].astype("int64" if group[ts].dtype.kind in "iu" else "datetime64[us]").astype("int64") / (1 if group[ts].dtype.kind in "iu" else 1e6):
            level, ok = bucket_step(level, last, now, rate, per)
            last = now
            passed.append(ok)
        return group[passed]

    return events.groupBy(key).applyInPandas(run, events.schema)


def words(lines: DataFrame, column: str) -> DataFrame:
    """(word): lower-cased alphabetic tokens without punctuation and stop words."""
    kept = F.filter(F.split(F.col(column), "\n"), lambda line: ~F.regexp_like(line, F.lit("^\\s*\\.\\.")))  # lines that begin with .. are comments
    bare = F.translate(F.array_join(kept, "\n"), "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", " " * 32)
    word = lines.select(F.explode(F.split(F.lower(bare), "\\s+")).alias("word"))
    return word.filter(F.col("word").rlike("^[a-z]+$") & ~F.col("word").isin(STOP_WORDS))


def top_words(lines: DataFrame, column: str, n: int = 20) -> DataFrame:
    return words(lines, column).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(n)


def waiting_bucket(events: DataFrame, key: str, ts: str, order: str, rate: float, per: float) -> DataFrame:
    """events with admitted (timestamp_ntz): when a bucket lets each through that makes events wait, in order, instead of dropping them.

    It begins with a tenth of rate, 1 at least, and holds rate at most. A key's
    events are one group.
    """
    schema = T.StructType([*events.schema.fields, T.StructField("admitted", T.TimestampNTZType())])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([ts, order])
        level, last, out = max(rate * 0.1, 1.0), None, []
        for arrived in group[ts].astype("datetime64[us]").astype("int64") / 1e6:
            now = arrived if last is None else max(arrived, last)
            level = min(rate, level + (0.0 if last is None else (now - last) * rate / per))
            if level < 1:
                now += (1 - level) * per / rate
                level = 1.0
            level, last = level - 1, now
            out.append(math.floor(now * 1e6 + 0.5))
        return group.assign(admitted=pd.to_datetime(pd.Series(out, index=group.index, dtype="int64"), unit="us"))

    return events.groupBy(key).applyInPandas(run, schema)


def popularity(texts: DataFrame, column: str) -> DataFrame:
    """(ch, n): how often each character occurs."""
    return texts.select(F.explode(F.split(column, "")).alias("ch")).filter("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))


def prefix_index(entries: DataFrame, length: int = 2) -> DataFrame:
    """(prefix, word, freq): a dictionary keyed by the words' first characters, to be joined on."""
    return entries.select(F.substring("word", 1, length).alias("prefix"), "word", "freq")


def group_reduce(rows: DataFrame, key: str, reduce: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """An arbitrary reducer over the rows of each key; a group is one task's, so built-in aggregates are preferable where they can say it."""
    return rows.groupBy(key).applyInPandas(reduce, schema)


def map_reduce(rows: DataFrame, map: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], mapped: str, key: str, reduce: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Arbitrary mapper and reducer: batches of rows to rows of the schema mapped, then each key's rows to rows of schema."""
    return group_reduce(rows.mapInPandas(map, mapped), key, reduce, schema)


def first_value(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): each key's first value in an order."""
    return rows.groupBy(key).agg(F.min_by(value, order).alias(value))


def grep(lines: DataFrame, column: str, part: str) -> DataFrame:
    """Rows whose column has a substring."""
    return lines.filter(F.col(column).contains(part))


def piped(rows: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows sent through the steps, each a DataFrame's transformation."""
    for step in steps:
        rows = rows.transform(step)
    return rows


def dictionary_logs(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (word, freq): (word, logp) with logp = length x ln(freq) - ln(total), and (ch, logp) of characters. Words of freq 1 are left out."""
    kept = entries.filter("freq > 1")
    total = F.broadcast(kept.agg(F.log(F.sum("freq")).alias("lt")))
    by_word = kept.crossJoin(total).select("word", (F.length("word") * F.log("freq") - F.col("lt")).alias("logp"))
    chars = kept.select(F.explode(F.filter(F.split("word", ""), lambda c: c != "")).alias("ch"), "freq").groupBy("ch").agg(F.sum("freq").alias("f"))
    return by_word, chars.crossJoin(total).select("ch", (F.log("f") - F.col("lt")).alias("logp"))
