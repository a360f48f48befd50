"""The test tables, and signal samples derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.vectors import bucketise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, day, result, features map): a sample for each user and day; half a conversion for each purchase, one at most."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", F.hour("ts").alias("h"), F.weekday("ts").alias("w"))
    kinds = F.collect_set(F.when(F.col("event_type") != "purchase", F.concat(F.lit("type_"), "event_type")))
    names = F.concat(kinds, F.collect_set(F.concat(F.lit("hour_"), F.col("h"))), F.collect_set(F.concat(F.lit("weekday_"), F.col("w"))))
    result = F.least(F.lit(1.0), F.count_if(F.col("event_type") == "purchase") * 0.5)
    return e.groupBy("user_id", "day").agg(result.alias("result"), names.alias("names")).select("user_id", "day", "result", F.map_from_arrays("names", F.transform("names", lambda x: F.lit(1.0))).alias("features"))


def signals_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, result, features map, n_chars): labelled documents; a broadcast isn't forced, the planner sizes labels."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    joined = d.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    names = F.array(F.concat(F.lit("lang_"), "lang"), F.concat(F.lit("src_"), "source"), F.concat(F.lit("len_"), bucketise(F.col("n_chars"), [200, 1000, 5000])))
    return joined.select(F.col("doc_id").alias("sample_id"), F.col("quality").cast("double").alias("result"), F.map_from_arrays(names, F.transform(names, lambda x: F.lit(1.0))).alias("features"), "n_chars")
