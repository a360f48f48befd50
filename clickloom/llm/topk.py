"""Exact top-k inner products by Fagin's threshold algorithm.

Candidates are dealt into blocks of bounded size, near copies of a pivot into
blocks of their own, as lists of like vectors are short, and are sorted there
once for each dimension. At a depth of these lists no unseen candidate scores more than
the sum of query component times list entry: a query goes down only to where
that bound is under its kth score, and scores what it meets by random access.

A first pass asks each query of its own block alone. Its kth score there is the
least that every other block has to beat, so the second pass leaves a block at
depth 0, at some depth, or, where the bound asks for most of its rows, scores
the block's rows in one product instead of one at a time. Winners (k rows for
each query and block) are ranked at last. Where vectors have no neighbours to
speak of, as random directions do, the bound stays above the kth score and all
candidates are scored; the work is queries times candidates then.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.common import settled

#: Rows of a block, about; queries that are asked of it at a time.
CANDIDATES, QUERIES = 8192, 4096
#: Pivots, the rows with the least hashes; the cosine from which on a row is a near copy of one; near copies that get blocks of their own.
PIVOTS, NEAR, MANY = 64, 0.9, 32
#: Depths at which the bound is looked at, each so many times the one before.
STEP = 4


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null if the vector is, or any component is null, NaN or infinite."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(fine, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


class Lists:
    """A block's candidates, their list for each dimension, and how many of them its queries scored."""

    def __init__(self, values: np.ndarray, ids: np.ndarray):
        self.values, self.ids, self.scored = values, ids, 0
        self.order = np.argsort(values, axis=0, kind="stable")
        n, columns = len(values), np.arange(values.shape[1])
        self.depths = [0]
        while self.depths[-1] < n:
            self.depths.append(min(n, max(8, self.depths[-1] * STEP)))
        at = np.array(self.depths[:-1])
        self.low, self.high = values[self.order[at], columns], values[self.order[n - 1 - at], columns]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Depths x queries: the most that a candidate unseen at that depth can score; at the last depth none is unseen."""
        most = self.high @ np.maximum(queries, 0).T + self.low @ np.minimum(queries, 0).T
        if most.dtype != float:
            most = np.nextafter(most.astype(float), np.inf)
        return np.concatenate([most, np.full((1, len(queries)), -np.inf)])

    def top(self, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> list[list[tuple[int, int, int]]]:
        """Each query's k best (score, id, row), ties to the smaller id; those under floor may be missing. Rows of the id own are left out."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in queries]
        bound = self.bounds(queries)
        until = (bound < floor).argmax(0)  # strictly under: an equal score of a smaller id would count
        until[~np.isfinite(floor)] = len(self.depths)
        depth = np.append(self.depths, len(self.values))
        walks = depth[until] * queries.shape[1] < len(self.values) // 2
        for q in np.flatnonzero(walks & (until > 0)).tolist():
            out[q] = self._walk(queries[q], bound[:, q], own[q], floor[q], k)
        dense, every = np.flatnonzero(~walks), np.arange(len(self.values))
        for at in range(0, len(dense), 256):
            part = dense[at : at + 256]
            score = queries[part] @ self.values.T
            self.scored += score.size
            for q, row in zip(part.tolist(), score, strict=True):
                out[q] = self._best(row, every, own[q], k)
        return out

    def _walk(self, query: np.ndarray, bound: np.ndarray, own: int, floor: float, k: int) -> list[tuple[int, int, int]]:
        dims = np.flatnonzero(query)
        # a negative component wants the smallest values first
        lists = np.where(query[dims] > 0, self.order[::-1, dims], self.order[:, dims])
        seen = np.zeros(len(self.values), bool)
        best: list[tuple[int, int, int]] = []
        for level, depth in enumerate(self.depths):
            if bound[level] < floor or len(best) == k and bound[level] < best[-1][0]:
                break
            met = np.zeros(len(self.values), bool)
            met[lists[depth : self.depths[level + 1]].ravel()] = True
            new = np.flatnonzero(met & ~seen)
            seen |= met
            self.scored += len(new)
            best = sorted([*best, *self._best(self.values[new] @ query, new, own, k)], key=lambda x: (-x[0], x[1]))[:k]
        return best

    def _best(self, score: np.ndarray, rows: np.ndarray, own: int, k: int) -> list[tuple[int, int, int]]:
        if len(score) > k:
            # rows of the query's own id may be among the best: look as much further as there are such rows
            more = min(len(score), k + np.count_nonzero(self.ids == own))
            at = np.flatnonzero(score >= np.partition(score, len(score) - more)[len(score) - more])
            score, rows = score[at], rows[at]
        other = self.ids[rows] != own
        score, rows = score[other], rows[other]
        ids = self.ids[rows]
        return [(int(score[n]), int(ids[n]), int(rows[n])) for n in np.lexsort((ids, -score))[:k]]


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.int64).reshape(len(vectors), -1)


def nearest_pivot(vectors: list, pivots: list[np.ndarray]) -> np.ndarray:
    """The number of the pivot of the same length that each vector is closest to, -1 if it is near none."""
    out = np.full(len(vectors), -1, np.int32)
    lengths = np.array([len(v) for v in vectors], np.int64)
    for d in np.unique(lengths).tolist():
        numbers = [n for n, p in enumerate(pivots) if len(p) == d and p.any()]
        rows = np.flatnonzero(lengths == d)
        if d and numbers:
            x = np.array([vectors[n] for n in rows], float)
            p = np.array([pivots[n] for n in numbers], float)
            cosine = (x @ p.T) / np.maximum(1e-300, np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(p, axis=1))
            best = cosine.argmax(1)
            near = cosine[np.arange(len(rows)), best] >= NEAR
            out[rows[near]] = np.array(numbers)[best[near]]
    return out


def asked(candidates: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query_id, vec_id, score, copies) of a block: candidates (id, v, copies), queries (id, v, floor: a score that its kth is known to have, or null)."""
    out: list[tuple] = []
    if len(candidates) and len(queries):
        values, wanted = _matrix(candidates["v"]), _matrix(queries["v"])
        if int(np.abs(values).max(initial=0)) * int(np.abs(wanted).max(initial=0)) * max(1, values.shape[1]) < 1 << 52:
            values, wanted = values.astype(float), wanted.astype(float)  # sums are exact in doubles too, which multiply faster
        floor = queries["floor"].astype(float).fillna(-np.inf).to_numpy()
        floor = np.where(np.abs(floor) < 1 << 52, floor, np.nextafter(floor, -np.inf))
        ids = queries["id"].to_numpy()
        tops = Lists(values, candidates["id"].to_numpy()).top(wanted, ids, floor, k)
        copies = candidates["copies"].tolist()
        out = [(own, i, s, copies[n]) for own, top in zip(ids.tolist(), tops, strict=True) for s, i, n in top]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "copies"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows but those of its own id.

    Rows without an id, or whose vector is null or holds a null or non-finite
    component, take no part. Only vectors of one length are compared. A
    candidate row that occurs several times is found as often; a query row that
    does is asked once. Scores are 64-bit integers. No vectors: no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    # of equal rows no more than k can be among the k best
    rows = rows.filter("id is not null and v is not null").groupBy("id", "v").agg(F.max("q").alias("q"), F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    rows = settled(rows.withColumn("d", F.size("v")))
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("q").alias("q")).first()
    q_blocks = max(1, math.ceil(sizes["q"] / QUERIES))
    rows = rows.withColumn("h", F.xxhash64("id", "v"))
    pivots = [np.array(r["v"], np.int64) for r in rows.orderBy("h", "id").limit(PIVOTS).select("v").collect()]

    @F.arrow_udf("int")
    def cell(v: pa.Array) -> pa.Array:
        return pa.array(nearest_pivot(v.to_pylist(), pivots))

    rows = settled(rows.withColumn("cell", cell("v")))
    counted = rows.groupBy("d", "cell").agg(F.count("*").alias("n")).withColumn("own", F.when(F.col("n") >= MANY, F.col("cell")).otherwise(-1))
    counted = settled(counted)
    cells = settled(counted.groupBy("d", F.col("own").alias("cell")).agg(F.ceil(F.sum("n") / CANDIDATES).cast("int").alias("parts")))
    rows = rows.join(counted.select("d", "cell", "own"), ["d", "cell"]).withColumn("cell", F.col("own")).drop("own").join(cells, ["d", "cell"]).withColumn("part", F.pmod("h", "parts").cast("int")).drop("parts")
    block, schema = ["d", "cell", "part"], "query_id long, vec_id long, score long, copies int"
    # renamed, so that the two sides don't share columns
    candidates = rows.select(*block, "id", "v", "copies").toDF(*block, "id", "v", "copies")
    queries = rows.filter("q").select(*block, "h", "id", "v").toDF(*block, "h", "id", "v")

    def search(some: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        return asked(some, of, k)

    no_floor = queries.withColumn("floor", F.lit(None).cast("double"))
    at_home = settled(candidates.groupBy(*block).cogroup(no_floor.groupBy(*block)).applyInPandas(search, schema))
    floors = at_home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))
    blocks = cells.select("d", F.col("cell").alias("to_cell"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("to_part"))
    away = queries.join(floors, F.col("id") == F.col("query_id"), "left").join(blocks, "d").filter((F.col("cell") != F.col("to_cell")) | (F.col("part") != F.col("to_part")))
    away = away.select("d", F.col("to_cell").alias("cell"), F.col("to_part").alias("part"), F.pmod("h", F.lit(q_blocks)).cast("int").alias("c"), "id", "v", "floor")
    met = candidates.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    elsewhere = met.groupBy(*block, "c").cogroup(away.groupBy(*block, "c")).applyInPandas(search, schema)
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = at_home.unionByName(elsewhere).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
