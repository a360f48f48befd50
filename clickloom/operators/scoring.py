"""Applying linear models, and measuring them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.vectors import sigmoid

INTERCEPT = "(Intercept)"


def linear_term(weights: dict[str, float], features: Column, conjunctions: bool = True) -> Column:
    """Intercept + sum of weight x value. A name with & that the sample lacks adds its weight if all its parts are 1."""
    plain = {k: v for k, v in weights.items() if k != INTERCEPT}
    table = F.create_map(*[x for k, v in sorted(plain.items()) for x in (F.lit(k), F.lit(float(v)))]) if plain else F.create_map().cast("map<string,double>")
    known = F.map_entries(F.map_filter(features, lambda k, v: F.map_contains_key(table, k)))
    total = F.aggregate(known, F.lit(float(weights.get(INTERCEPT, 0.0))), lambda s, e: s + e["value"] * F.try_element_at(table, e["key"]))
    for name, w in sorted(plain.items()):
        if conjunctions and "&" in name:
            parts = F.lit(True)
            for p in name.split("&"):
                parts = parts & (F.coalesce(F.try_element_at(features, F.lit(p)), F.lit(0.0)) == 1.0)
            total = total + F.when(~F.map_contains_key(features, F.lit(name)) & parts, F.lit(float(w))).otherwise(0.0)
    return total


def linear_term_joined(samples: DataFrame, weights: DataFrame, key: str, intercept: float = 0.0) -> DataFrame:
    """The same for models too large for an expression: (key, linear); weights: (feature, weight), joined, not broadcast by hand."""
    long = samples.select(key, F.explode_outer("features").alias("feature", "value")).join(weights, "feature", "left")
    return long.groupBy(key).agg((F.lit(intercept) + F.coalesce(F.sum(F.col("value") * F.col("weight")), F.lit(0.0))).alias("linear"))


def score(samples: DataFrame, weights: dict[str, float], family: str = "logit") -> DataFrame:
    e = linear_term(weights, F.col("features"))
    links = {"logit": sigmoid(e), "poisson": F.exp(e), "log": F.when(e < -100, 0.0).otherwise(F.exp(e))}
    if family not in links:
        raise ValueError(family)
    return samples.withColumn("predicted", links[family])


def explanation(weights: dict[str, float], features: Column) -> Column:
    """Known features with their contributions, by name: 'name:weight*value'."""
    table = F.create_map(*[x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(float(v)))])
    known = F.array_sort(F.filter(F.map_entries(features), lambda e: F.map_contains_key(table, e["key"])))
    return F.array_join(F.transform(known, lambda e: F.format_string("%s:%.2f*%.2f", e["key"], F.try_element_at(table, e["key"]), e["value"])), " + ")


def roc(pairs: DataFrame, id_col: str = "id", bins: int = 256) -> DataFrame:
    """(id, predicted, x, y): the curve over (id, actual, predicted), by prediction descending, then id.

    Running sums in two steps: sums of bins of the prediction between its
    percentiles (so many rows in all), and within a bin. A task holds a bin:
    about an equal share of the rows, or all rows of one prediction.
    """
    bounds = F.percentile_approx("predicted", [k / bins for k in range(1, bins)], 10 * bins)
    span = pairs.agg(bounds.alias("bounds"), F.sum("actual").alias("pos"), F.sum(F.greatest(F.lit(0.0), 1 - F.col("actual"))).alias("neg"))
    at = F.size(F.filter("bounds", lambda b: b < F.col("predicted")))
    rows = pairs.crossJoin(F.broadcast(span)).withColumn("bin", F.coalesce(at, F.lit(0))).drop("bounds").withColumn("miss", F.greatest(F.lit(0.0), 1 - F.col("actual")))
    above = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("bin").agg(F.sum("actual").alias("t"), F.sum("miss").alias("f"))
    base = sums.select("bin", F.coalesce(F.sum("t").over(above), F.lit(0.0)).alias("t0"), F.coalesce(F.sum("f").over(above), F.lit(0.0)).alias("f0"))
    within = Window.partitionBy("bin").orderBy(F.desc("predicted"), id_col).rowsBetween(Window.unboundedPreceding, 0)
    curve = rows.join(F.broadcast(base), "bin")
    x = (F.col("f0") + F.sum("miss").over(within)) / F.nullif("neg", F.lit(0.0))
    y = (F.col("t0") + F.sum("actual").over(within)) / F.nullif("pos", F.lit(0.0))
    return curve.select(id_col, "predicted", x.alias("x"), y.alias("y"))


def auc(pairs: DataFrame, id_col: str = "id", mode: str = "standard") -> DataFrame:
    """(auc): trapezoids under the curve; compat takes the lower y of each x on both sides."""
    points = roc(pairs, id_col).select(F.round("x", 12).alias("x"), "y").unionByName(pairs.sparkSession.createDataFrame([(0.0, 0.0)], "x double, y double"))
    by_x = points.groupBy("x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    # a step of the curve is one distinct x: the previous one comes from the neighbouring bin's end, so bins are chained
    bin_of = F.floor(F.col("x") * 256)
    ends = by_x.groupBy(bin_of.alias("bin")).agg(F.max(F.struct("x", "lo", "hi")).alias("end"))
    ends = ends.select("bin", F.lag("end").over(Window.orderBy("bin")).alias("before"))
    order = Window.partitionBy("bin").orderBy("x")
    rows = by_x.withColumn("bin", bin_of).join(F.broadcast(ends), "bin").withColumn("p", F.coalesce(F.lag(F.struct("x", "lo", "hi")).over(order), F.col("before")))
    other = F.col("p.hi") if mode == "standard" else F.col("p.lo")
    return rows.agg(F.sum((F.col("x") - F.col("p.x")) * (F.col("lo") + other) / 2).alias("auc"))


def absolute_error(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.sum(F.abs(F.col("actual") - F.col("predicted"))).alias("abs_error"), F.sum("actual").alias("positive"), F.sum(F.when(F.col("actual") < 1, 1 - F.col("actual")).otherwise(0.0)).alias("negative"))
