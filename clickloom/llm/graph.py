"""Connected components by alternating large-star and small-star rounds.

Every step is an aggregate with partial sums or an equi join on a node, so a
star with millions of leaves is split like any skewed join, and each round's
edges are written to the shared folder. No edge or node reaches the driver:
it sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import settled


def _oriented(edges: DataFrame) -> DataFrame:
    """Edges from the larger node to the smaller, without loops and repeats."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """(u, v) of any ordered type, nulls ignored -> (node, root): root is the least node of the component.

    Nodes without an edge don't appear. No edges: no rows.
    """
    now = settled(_oriented(edges.filter("u is not null and v is not null")))
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _oriented(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settled(_oriented(small.unionByName(least.select("u", F.col("m").alias("v")))))
        before, mark = mark, _mark(now)
        if before == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
