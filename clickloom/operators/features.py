"""Statistics and selection of sparse features. Samples: (keys..., result, features map<string,double>)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.vectors import MOST_BUDGET, budget, entropy
from clickloom.operators.flow import numbered


def exploded(samples: DataFrame, *keys: str) -> DataFrame:
    return samples.select(*keys, "result", F.explode("features").alias("feature", "value"))


def usable(samples: DataFrame, prefixes: tuple[str, ...] = ("hour_", "weekday_")) -> DataFrame:
    """Samples with a result, without features of these prefixes."""
    drop = F.lit(False)
    own = lambda k: drop if not prefixes else _any(k.startswith(p) for p in prefixes)
    return samples.filter("result is not null").withColumn("features", F.map_filter("features", lambda k, v: ~own(k)))


def _any(conditions):
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def stats(samples: DataFrame) -> DataFrame:
    """(feature, total, n): presence counts, whatever the value."""
    return exploded(samples).groupBy("feature").agg(F.sum("result").alias("total"), F.count("*").alias("n"))


def lifts(samples: DataFrame) -> DataFrame:
    """(feature, total, n, lift, weight): mean result over the overall mean, and n times its distance from 1."""
    mean = samples.agg(F.avg("result").alias("mean"))  # one row
    scored = stats(samples).crossJoin(F.broadcast(mean)).withColumn("lift", F.col("total") / F.col("n") / F.nullif("mean", F.lit(0.0)))
    return scored.withColumn("weight", F.col("n") * F.abs(1 - F.col("lift"))).drop("mean")


def top_features(samples: DataFrame, amplify: float = 1) -> DataFrame:
    """The features that the tiered budget of the sample count allows, by weight, ties by name descending."""
    size = samples.agg(budget(F.count("*"), amplify).alias("most"))
    ranked = lifts(samples).orderBy(F.desc("weight"), F.desc("feature")).limit(int(MOST_BUDGET * amplify))  # no budget is larger
    place = Window.orderBy(F.desc("weight"), F.desc("feature"))
    return ranked.withColumn("place", F.row_number().over(place)).crossJoin(F.broadcast(size)).filter("place <= most").drop("most")


def restrict(samples: DataFrame, selected: DataFrame) -> DataFrame:
    """Samples with selected features only; a sample left without any stays. selected: (feature), a few thousand rows."""
    names = selected.agg(F.collect_set("feature").alias("chosen"))
    return samples.crossJoin(F.broadcast(names)).withColumn("features", F.map_filter("features", lambda k, v: F.array_contains("chosen", k))).drop("chosen")


def contingency(samples: DataFrame) -> DataFrame:
    """(feature, a, b, c, d): samples with and without the feature, by positive result or not."""
    here = exploded(samples).groupBy("feature").agg(F.count_if(F.col("result") > 0).alias("a"), F.count_if(~(F.col("result") > 0)).alias("b"))
    total = samples.agg(F.count_if(F.col("result") > 0).alias("pos"), F.count_if(~(F.col("result") > 0)).alias("neg"))
    return here.crossJoin(F.broadcast(total)).select("feature", "a", "b", (F.col("pos") - F.col("a")).alias("c"), (F.col("neg") - F.col("b")).alias("d"))


def chi_square(samples: DataFrame, keep_ratio: float = 1.0) -> DataFrame:
    """(feature, a, b, c, d, chi): 0 where a margin is; the best keep_ratio of the features."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    margins = (a + c) * (b + d) * (a + b) * (c + d)
    out = contingency(samples).withColumn("chi", F.when(margins > 0, (a + b + c + d) * (a * d - b * c) * (a * d - b * c) / margins).otherwise(0.0))
    if keep_ratio >= 1:
        return out
    most = F.broadcast(out.agg(F.ceil(F.count("*") * keep_ratio).alias("most")))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("chi"), "feature"))).crossJoin(most).filter("place <= most").drop("place", "most")


def info_gain(samples: DataFrame, least: float = 1e-6) -> DataFrame:
    """(feature, gain): entropy of the result less that given presence; only gains above least. A feature of all samples gains 0."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n, with_it, without = a + b + c + d, a + b, c + d
    part = lambda x, y, m: F.when(m > 0, entropy(x / m, y / m)).otherwise(0.0)
    gain = entropy((a + c) / n, (b + d) / n) - (with_it / n * part(a, b, with_it) + without / n * part(c, d, without))
    return contingency(samples).select("feature", gain.alias("gain")).filter(F.col("gain") > least)


def univariate_screen(samples: DataFrame, p_max: float = 0.5, top: int = 400, family: str = "logit") -> DataFrame:
    """(feature, z, place): Wald test of each two-valued feature alone, in closed form; p <= p_max and rank below top.

    Results are rounded to a tenth, half to even, and weigh 10. Degenerate fits
    count as p = 1. family: logit or poisson.
    """
    from statistics import NormalDist

    rows = samples.withColumn("result", F.bround("result", 1))
    here = exploded(rows).filter("value <> 0").groupBy("feature").agg(F.count("*").alias("n1"), F.sum("result").alias("s1"))
    total = rows.agg(F.count("*").alias("n"), F.sum("result").alias("s"))
    r = here.crossJoin(F.broadcast(total)).withColumn("n0", F.col("n") - F.col("n1")).withColumn("s0", F.col("s") - F.col("s1"))
    r = r.filter("n0 > 0 and n1 > 0").withColumn("p1", F.col("s1") / F.col("n1")).withColumn("p0", F.greatest(F.lit(0.0), F.col("s0") / F.col("n0")))
    if family == "logit":
        r = r.filter("p1 > 1e-12 and p1 < 1 - 1e-12 and p0 > 1e-12 and p0 < 1 - 1e-12")
        slope = F.log(F.col("p1") / (1 - F.col("p1"))) - F.log(F.col("p0") / (1 - F.col("p0")))
        var = 1 / (10 * F.col("n1") * F.col("p1") * (1 - F.col("p1"))) + 1 / (10 * F.col("n0") * F.col("p0") * (1 - F.col("p0")))
    else:
        r = r.filter("p1 > 1e-12 and p0 > 1e-12")
        slope, var = F.log(F.col("p1") / F.col("p0")), 1 / (10 * F.col("n1") * F.col("p1")) + 1 / (10 * F.col("n0") * F.col("p0"))
    out = r.select("feature", (slope / F.sqrt(var)).alias("z")).filter(F.abs("z") >= NormalDist().inv_cdf(1 - p_max / 2))
    # average rank of ties: all features of one statistic are one row, so those of a rank below top are among the best top rows
    out = out.withColumn("at", F.round(F.abs("z"), 9))
    levels = out.groupBy("at").agg(F.count("*").alias("n")).orderBy(F.desc("at")).limit(top)
    before = Window.orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    place = F.coalesce(F.sum("n").over(before), F.lit(0)) + (F.col("n") + 1) / 2
    levels = levels.select("at", place.cast("double").alias("place")).filter(F.col("place") < top)
    return out.join(F.broadcast(levels), "at").select("feature", "z", "place")


def dictionary(samples: DataFrame) -> DataFrame:
    """(idx, feature): distinct names, numbered from 0 in name order."""
    names = samples.select(F.explode(F.map_keys("features")).alias("feature")).distinct()
    return numbered(names, "feature", "idx").select(F.col("idx").cast("int").alias("idx"), "feature")


def split_labels(samples: DataFrame) -> DataFrame:
    """Fractional results as weighted 0/1 rows: (.., label, weight), weights y and 1 - y, none of weight 0."""
    y = F.col("result")
    rows = F.filter(F.array(F.struct(F.lit(1).alias("label"), y.alias("weight")), F.struct(F.lit(0).alias("label"), F.greatest(F.lit(0.0), 1 - y).alias("weight"))), lambda r: r["weight"] > 1e-9)
    return samples.select("*", F.explode(rows).alias("r")).select("*", "r.label", "r.weight").drop("r")


def weighted_lines(samples: DataFrame, key: str, names: DataFrame, scale: float = 1e8) -> DataFrame:
    """(line, weight): libsvm rows `label index:value ...` (indices from 1) of split_labels() with weights times scale, and the seed row of label 1 and a tiny weight that fixes the order of classes."""
    long = samples.select(key, F.explode("features").alias("feature", "value")).join(names, "feature").filter("value <> 0")
    cells = long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((F.col("idx") + 1).alias("i"), "value"))).alias("cells"))
    rows = split_labels(samples.select(key, "result")).join(cells, key, "left")
    text = F.transform(F.coalesce("cells", F.array().cast("array<struct<i:int,value:double>>")), lambda c: F.format_string("%d:%s", c["i"], c["value"].cast("string")))
    lines = rows.select(F.concat_ws(" ", F.col("label").cast("string"), F.array_join(text, " ")).alias("line"), (F.col("weight") * scale).alias("weight"))
    return samples.sparkSession.createDataFrame([("1", 1e-7)], "line string, weight double").unionByName(lines)


def capped(samples: DataFrame, treat_as_one: float = 1.0) -> DataFrame:
    return samples.withColumn("result", F.least(F.col("result") / treat_as_one, F.lit(1.0)))


def constant_model(samples: DataFrame, enough: int = 3000, default: float = 0.02) -> DataFrame:
    return samples.agg(F.when(F.count("*") > enough, F.avg("result")).otherwise(default).alias("average"))
