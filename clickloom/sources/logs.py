"""Text logs and small dimension files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions import text


def click_log(spark: SparkSession, path: str) -> DataFrame:
    """click_lines() of text files. path may be a day's glob."""
    return click_lines(spark.read.text(path))


def click_lines(lines: DataFrame) -> DataFrame:
    """machine, click_ex, click, score, reason of blank-separated lines (column value); malformed ones are left out."""
    p = F.split("value", " ", -1)
    return lines.filter(F.size(p) >= 5).select(p[0].alias("machine"), p[1].alias("click_ex"), p[2].alias("click"), p[3].try_cast("int").alias("score"), p[4].alias("reason")).filter("score is not null")


def tracking_log(lines: DataFrame) -> DataFrame:
    """ip, ts, request, referer, user_agent, cookies, and the tracking keys, of quote-separated access lines (column value)."""
    p = F.split("value", '"')
    rows = lines.filter(F.size(p) >= 10).select(F.substring_index("value", " ", 1).alias("ip"), F.try_to_timestamp(F.regexp_extract("value", r"\[([^\s\]]+)", 1), F.lit("dd/MMM/yyyy:HH:mm:ss")).cast("timestamp_ntz").alias("ts"), p[1].alias("request"), p[3].alias("referer"), p[5].alias("user_agent"), p[9].alias("cookies"))
    keys = "uv ur ucs usr uco ula uj uf ut ure uh".split()
    return rows.select("*", *[text.tracking_arg(F.col("request"), k).alias(k) for k in keys], text.tracking_arg(F.col("request"), "up", decode=True).alias("up"), text.cookie(F.col("cookies"), "MUID").alias("muid"), text.cookie(F.col("cookies"), "YYID").alias("yyid"))


def dimension(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    """Tab-separated dimension file; codes stay strings where the schema says so."""
    return spark.read.csv(path, sep="\t", schema=schema, header=header)


def income_dimension(lines: DataFrame) -> DataFrame:
    """(code, income) of tab-separated lines (column value): second and second-to-last fields; header lines are left out."""
    p = F.split("value", "\t")
    return lines.filter(~F.col("value").startswith("HEADER")).select(p[1].alias("code"), F.element_at(p, -2).try_cast("double").alias("income")).filter("income is not null")


def coefficients(lines: DataFrame) -> DataFrame:
    """(feature, weight) of a blank-separated, quoted coefficient table (column value) without its header; what isn't a number is left out."""
    clean = F.trim(F.replace("value", F.lit('"'), F.lit("")))
    p = F.split(clean, "\\s+")
    return lines.filter(F.size(p) >= 2).select(p[0].alias("feature"), F.element_at(p, 2).try_cast("double").alias("weight")).filter("weight is not null")


def feature_names(lines: DataFrame) -> DataFrame:
    """(input, feature) of a dictionary's lines `number name` (column value), numbers from 1, inputs from 0."""
    p = F.split("value", " ", 2)
    number = p[0].try_cast("int")
    return lines.select(F.concat(F.lit("input_"), (number - 1).cast("string")).alias("input"), p[1].alias("feature")).filter("input is not null and feature is not null")


def model(coefficient_lines: DataFrame, name_lines: DataFrame) -> DataFrame:
    """(feature, weight): a coefficient table with its columns' names; the intercept keeps its own."""
    named = coefficients(coefficient_lines).withColumnRenamed("feature", "input").join(feature_names(name_lines), "input", "left")
    return named.select(F.coalesce("feature", "input").alias("feature"), "weight")


def linear_model(text: DataFrame) -> DataFrame:
    """(label int, idx int, weight double) of linear-model files (column value: a whole file): after the line `w` a row for each feature with a weight for each label.

    A model of two labels has one weight a row; it is the first label's.
    """
    lines = F.transform(F.split(F.trim("value"), "\\r?\\n"), lambda x: F.trim(x))
    labels = F.split(F.element_at(F.filter("lines", lambda x: x.startswith("label ")), 1), " +")
    rows = F.slice("lines", F.array_position("lines", "w").cast("int") + 1, F.size("lines"))
    each = text.select(lines.alias("lines")).select(labels.alias("labels"), F.posexplode(rows).alias("idx", "row"))
    cells = each.select("labels", "idx", F.posexplode(F.split("row", " +")).alias("k", "weight"))
    return cells.select(F.get("labels", F.col("k") + 1).cast("int").alias("label"), "idx", F.col("weight").try_cast("double").alias("weight")).filter("weight is not null")


def readings(lines: DataFrame) -> DataFrame:
    """(ch, reading): the first reading of each character, of lines `character reading ...` (column value)."""
    p = F.split("value", "\\s+")
    return lines.filter(F.length(p[0]) == 1).select(p[0].alias("ch"), p[1].alias("reading"))


def listing(lines: DataFrame) -> DataFrame:
    """(path, is_file, length) of `ls -l`-like lines (column value)."""
    p = F.split(F.trim("value"), " +")
    return lines.filter(F.size(p) >= 6).select(F.element_at(p, -1).alias("path"), p[1].rlike("^[0-9]+$").alias("is_file"), p[4].try_cast("bigint").alias("length"))


def time_series(json: DataFrame) -> DataFrame:
    """(series, ts, value) of JSON documents [{target, datapoints: [[value, ts], ...]}, ...] (column value)."""
    parsed = F.explode(F.from_json("value", "array<struct<target:string,datapoints:array<array<double>>>>"))
    return json.select(parsed.alias("s")).select(F.col("s.target").alias("series"), F.explode("s.datapoints").alias("p")).select("series", F.col("p")[1].cast("long").alias("ts"), F.col("p")[0].alias("value"))


def cookie_value(lines: DataFrame, name: str) -> DataFrame:
    """(value): of the cookie-file line whose second-to-last token is name."""
    p = F.split(F.trim("value"), "\\s+")
    return lines.filter((F.size(p) >= 2) & (F.element_at(p, -2) == name)).select(F.element_at(p, -1).alias("value")).limit(1)


def jdbc(spark: SparkSession, urls: list[str], query: str, **options: str) -> DataFrame:
    """The same query at several databases, one after the other."""
    out = None
    for url in urls:
        part = spark.read.format("jdbc").options(url=url, query=query, **options).load()
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no database is given")
    return out
