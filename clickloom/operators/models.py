"""Fitting: logistic, Poisson, Gaussian, PCA, SVD, L2 and k-means models, on MLlib.

A model is (weights, intercept) over feature names. Rows are arrays of values in
name order, built and multiplied a batch at a time; what reaches the driver is a
fixed number of p x p matrices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.operators import features as fs


def feature_names(samples: DataFrame) -> list[str]:
    return [r["feature"] for r in fs.dictionary(samples).orderBy("idx").collect()]


def design(samples: DataFrame, names: list[str]) -> DataFrame:
    """samples with x: values in name order, 0 where absent."""

    @F.arrow_udf("array<double>")
    def run(features: pa.Array) -> pa.Array:
        out = np.zeros((len(features), len(names)))
        column = pc.index_in(features.keys, value_set=pa.array(names, pa.string()))
        known = column.is_valid().to_numpy(zero_copy_only=False)
        offsets = features.offsets.to_numpy() - features.offsets[0].as_py()
        row = np.repeat(np.arange(len(features)), np.diff(offsets))
        out[row[known], column.drop_null().to_numpy()] = features.items.to_numpy(zero_copy_only=False)[known]
        ends = pa.array(np.arange(len(features) + 1, dtype=np.int32) * len(names))
        return pa.ListArray.from_arrays(ends, pa.array(np.nan_to_num(out).ravel()))

    no_features = F.create_map().cast("map<string,double>")
    return samples.withColumn("x", run(F.coalesce("features", no_features)))


def _rows(x: pa.Array, p: int) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), p)


#: Partial sums that the driver adds up.
PARTIAL = 16


def gram(rows: DataFrame, p: int) -> tuple[np.ndarray, float]:
    """[X, 1]' [X, 1], and the number of rows. A task gives one matrix, PARTIAL tasks add them up, the driver adds the rest."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p + 1, p + 1))
        for batch in batches:
            if batch.num_rows:
                x = np.hstack([_rows(batch.column(0), p), np.ones((batch.num_rows, 1))])
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % PARTIAL], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "m"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros((p + 1) ** 2)
        for m in table.column("m"):
            total += np.frombuffer(m.as_buffer())
        return pa.table({"m": pa.array([total.tobytes()], pa.binary())})

    sums = rows.select("x").mapInArrow(one, "part int, m binary").groupBy("part").applyInArrow(add, "m binary").collect()
    g = np.zeros((p + 1, p + 1)) + sum(np.frombuffer(r["m"]).reshape(p + 1, p + 1) for r in sums)
    return g, g[p, p]


def multiplied(rows: DataFrame, matrix: np.ndarray, shift: np.ndarray) -> DataFrame:
    """rows with z = x times matrix, less shift."""

    @F.arrow_udf("array<double>")
    def run(x: pa.Array) -> pa.Array:
        z = _rows(x, len(matrix)) @ matrix - shift
        return pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(z.ravel()))

    return rows.withColumn("z", run("x"))


def independent(g: np.ndarray) -> list[int]:
    """Columns, in order, that add rank to the intercept and those before: what is left of each beside those kept, by a growing inverse Cholesky factor."""
    p = len(g) - 1
    kept, inverse = [p], np.array([[1 / math.sqrt(g[p, p])]])
    for j in range(p):
        y = inverse @ g[kept, j]
        left = g[j, j] - y @ y
        if left > 1e-8 * max(1.0, g[j, j]):
            row = np.append(-(y @ inverse), 1.0) / math.sqrt(left)
            inverse = np.vstack([np.hstack([inverse, np.zeros((len(kept), 1))]), row])
            kept.append(j)
    return kept[1:]


def fit_glm(samples: DataFrame, family: str = "binomial") -> dict[str, float]:
    """Maximum likelihood without aliased columns. family: binomial, poisson or gaussian."""
    names = feature_names(samples)
    rows = design(samples, names).select("x", "result")
    kept = [names[j] for j in independent(gram(rows, len(names))[0])]
    ready = design(samples, kept).select(array_to_vector("x").alias("features"), "result")
    fitted = GeneralizedLinearRegression(family=family, labelCol="result", maxIter=100, tol=1e-10).fit(ready)
    return dict(zip(kept, fitted.coefficients.toArray().tolist(), strict=True)) | {"(Intercept)": fitted.intercept}


def fit_pca(samples: DataFrame, share: float = 0.9, family: str = "binomial") -> dict[str, float]:
    """Standardised principal components whose running sum of deviations stays within share of the total; coefficients in the features' own scale."""
    names = feature_names(samples)
    rows = design(samples, names).select("x", "result")
    g, n = gram(rows, len(names))
    mean = g[-1, :-1] / n
    cov = (g[:-1, :-1] - n * np.outer(mean, mean)) / (n - 1)
    varies = np.flatnonzero(np.diag(cov) > 1e-12)
    sd = np.sqrt(np.diag(cov)[varies])
    values, vectors = np.linalg.eigh(cov[np.ix_(varies, varies)] / np.outer(sd, sd))
    dev = np.sqrt(np.clip(values[::-1], 0, None))
    vectors = vectors[:, ::-1]
    k = max(1, int((np.cumsum(dev) <= share * dev.sum() + 1e-12).sum()))
    back = vectors[:, :k] / sd[:, None]  # from own scale to component scores
    shift = mean[varies] @ back
    wide = np.zeros((len(names), k))
    wide[varies] = back
    ready = multiplied(rows, wide, shift).select(array_to_vector("z").alias("features"), "result")
    fitted = GeneralizedLinearRegression(family=family, labelCol="result", maxIter=100, tol=1e-10).fit(ready)
    b = fitted.coefficients.toArray()
    own = back @ b
    return {names[v]: float(own[i]) for i, v in enumerate(varies)} | {"(Intercept)": float(fitted.intercept - shift @ b)}


def fit_l2(samples: DataFrame, reg: float = 0.0) -> dict[str, float]:
    """Logistic fit of fractional results as weighted rows; of all equal fits the one of least norm, intercept included."""
    names = feature_names(samples)
    rows = fs.split_labels(design(samples, names))
    fitted = LogisticRegression(weightCol="weight", labelCol="label", regParam=reg, elasticNetParam=0.0, standardization=False, tol=1e-12, maxIter=500).fit(rows.select(array_to_vector("x").alias("features"), F.col("label").cast("double"), "weight"))
    w = np.append(fitted.coefficients.toArray(), fitted.intercept)
    values, vectors = np.linalg.eigh(gram(design(samples, names).select("x"), len(names))[0])
    space = vectors[:, values > 1e-9 * values.max()]
    w = space @ (space.T @ w)
    return dict(zip(names, w[:-1].tolist(), strict=True)) | {"(Intercept)": float(w[-1])}


def fit_svd(samples: DataFrame, share: float = 0.9, full: int = 1000) -> dict[str, float]:
    """L2 fit on U S of X = U S V': with all singular values kept it is fit_l2; beyond `full` of them a share of their sum."""
    names = feature_names(samples)
    g, _ = gram(design(samples, names).select("x"), len(names))
    values, vectors = np.linalg.eigh(g[:-1, :-1])
    s = np.sqrt(np.clip(values[::-1], 0, None))
    v = vectors[:, ::-1][:, s > 1e-6]
    s = s[s > 1e-6]
    k = len(s) if len(s) <= full else int((np.cumsum(s) <= share * s.sum()).sum())
    v = v[:, :k]
    rows = fs.split_labels(multiplied(design(samples, names), v, np.zeros(k)))
    fitted = LogisticRegression(weightCol="weight", labelCol="label", standardization=False, tol=1e-12, maxIter=500).fit(rows.select(array_to_vector("z").alias("features"), F.col("label").cast("double"), "weight"))
    return dict(zip(names, (v @ fitted.coefficients.toArray()).tolist(), strict=True)) | {"(Intercept)": fitted.intercept}


def constant(samples: DataFrame) -> dict[str, float]:
    return {"Average": fs.constant_model(samples).first()["average"]}


#: Models by name.
MODELS = {"logit": fit_glm, "poisson": lambda s: fit_glm(s, "poisson"), "old": lambda s: fit_glm(fs.capped(s), "gaussian"), "pca": fit_pca, "svd": fit_svd, "lg": fit_l2, "const": constant}


def train(name: str, samples: DataFrame) -> dict[str, float]:
    if name not in MODELS:
        raise ValueError(f"no model {name!r}; there are {', '.join(MODELS)}")
    return MODELS[name](samples)


def as_frame(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    return df.sparkSession.createDataFrame(sorted(weights.items()), "feature string, weight double")


def save(df: DataFrame, weights: dict[str, float], path: str) -> None:
    """Writes a model as a Parquet table (feature, weight)."""
    as_frame(df, weights).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> dict[str, float]:
    """A model that save() wrote: a weight for each feature of a model, so as many as that has."""
    return {r["feature"]: r["weight"] for r in spark.read.parquet(path).collect()}


def kmeans(points: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """(cluster, center) of (coords array<double>, weight)."""
    fitted = KMeans(k=k, seed=seed, weightCol="weight").fit(points.select(array_to_vector("coords").alias("features"), "weight"))
    return points.sparkSession.createDataFrame([(n, c.tolist()) for n, c in enumerate(fitted.clusterCenters())], "cluster int, center array<double>")


def kmeans_step(points: DataFrame, centers: list[list[float]]) -> DataFrame:
    """(cluster, n, center): one round from given centres. Points: (coords, weight)."""
    dist = F.array(*[F.aggregate(F.zip_with("coords", F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) for c in centers])
    at = (F.array_position(dist, F.array_min(dist)) - 1).cast("int")
    rows = points.withColumn("cluster", at)
    dims = len(centers[0])
    sums = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), *[F.sum(F.get("coords", F.lit(d)) * F.col("weight")).alias(f"s{d}") for d in range(dims)])
    return sums.select("cluster", "n", F.array(*[F.col(f"s{d}") / F.col("w") for d in range(dims)]).alias("center"))


def converged_size(values: list[float], share: float) -> int:
    """How many leading values a running sum within share of the total takes."""
    total, run = math.fsum(values), 0.0
    for n, v in enumerate(values):
        run += v
        if run > share * total:
            return n
    return len(values)
