"""Sinks: reports, matrices, libsvm files, tables, metric lines."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.text import sql_literal


def write_dense(rows: DataFrame, names: list[str], path: str) -> None:
    """Blank-separated matrix with header, result last; missing values are 0. For export only."""
    cells = [F.coalesce(F.try_element_at("features", F.lit(n)), F.lit(0.0)).alias(f"input_{i}") for i, n in enumerate(names)]
    rows.select(*cells, "result").write.mode("overwrite").csv(path, sep=" ", header=True)


def sparse_entries(rows: DataFrame, key: str, names: DataFrame, ones: bool = False) -> DataFrame:
    """(row, col, value) of values beyond 1e-6; names: (idx, feature). ones: an extra column -1 of ones."""
    long = rows.select(F.col(key).alias("row"), F.explode("features").alias("feature", "value")).filter(F.abs("value") > 1e-6)
    out = long.join(names, "feature").select("row", F.col("idx").alias("col"), "value")
    return out.unionByName(rows.select(F.col(key).alias("row"), F.lit(-1).alias("col"), F.lit(1.0).alias("value"))) if ones else out


def transposed(entries: DataFrame) -> DataFrame:
    """(row, col, value) entries of the transposed matrix."""
    return entries.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def split_target(rows: DataFrame, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(inputs, target): the other columns, and the target (the last column if none is named)."""
    target = target or rows.columns[-1]
    return rows.drop(target), rows.select(target)


def columns(rows: DataFrame) -> DataFrame:
    """(place, name, kind) of the columns, names in lower case."""
    return rows.sparkSession.createDataFrame([(n, name.lower(), kind) for n, (name, kind) in enumerate(rows.dtypes)], "place int, name string, kind string")


def write_libsvm(rows: DataFrame, path: str, label: str = "label", x: str = "x") -> None:
    rows.select(F.col(label).cast("double").alias("label"), array_to_vector(x).alias("features")).write.mode("overwrite").format("libsvm").save(path)


def weight_report(weights: DataFrame) -> DataFrame:
    """(line): weights from the largest down, as fixed-width text."""
    return weights.orderBy(F.desc("weight"), "feature").select(F.format_string("%-30s : %+.9f", "feature", "weight").alias("line"))


def validation_lines(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.format_string("%s:b,%s:m", F.col("actual").cast("string"), F.col("predicted").cast("string")).alias("line"))


def named_sparse(rows: DataFrame) -> DataFrame:
    """(line): 'result name:value ...' with values whose integer part is positive, by name."""
    kept = F.array_sort(F.map_entries(F.map_filter("features", lambda k, v: F.floor(v) > 0)))
    return rows.select(F.concat_ws(" ", F.col("result").cast("string"), F.transform(kept, lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))).alias("line"))


def create_table(rows: DataFrame, name: str, unique: list[str] | None = None, partition: list[str] | None = None) -> None:
    """Saves a table; unique columns keep one row for each value, partition columns stand for indexes."""
    out = rows.dropDuplicates(unique) if unique else rows
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).saveAsTable(name)


def insert_sql(rows: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """(sql): an INSERT for each row, known columns only, strings quoted."""
    kinds = dict(rows.dtypes)
    known = [c for c in columns if c in kinds]
    values = F.concat_ws(", ", *[sql_literal(F.col(c), kinds[c]) for c in known])
    return rows.select(F.concat(F.lit(f"INSERT INTO {table} ({', '.join(known)}) VALUES ("), values, F.lit(");")).alias("sql"))


def metric_line(name: Column, value: Column, kind: str, rate: float = 1.0) -> Column:
    """A metrics datagram; kinds: counter c, timer ms, gauge g, set s."""
    if kind not in ("c", "ms", "g", "s"):
        raise ValueError(kind)
    return F.concat(name, F.lit(":"), value.cast("string"), F.lit(f"|{kind}" + (f"|@{rate:g}" if rate < 1 else "")))
