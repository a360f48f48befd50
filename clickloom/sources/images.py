"""Images as weighted colours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def colours(spark: SparkSession, path: str) -> DataFrame:
    """(origin, coords array<double>, weight): each image's colours as red, green and blue with their numbers of pixels. What isn't an image is left out."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pixels = np.frombuffer(row["data"], np.uint8).reshape(-1, row["channels"])
                rgb = np.repeat(pixels, 3, axis=1) if row["channels"] == 1 else pixels[:, 2::-1]  # stored as blue, green, red
                found, n = np.unique(rgb, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([row["origin"]] * len(n)), pa.array(found.astype(float).tolist(), pa.list_(pa.float64())), pa.array(n.astype(float))], names=["origin", "coords", "weight"])

    images = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.origin", F.col("image.nChannels").alias("channels"), "image.data")
    return images.mapInArrow(of, "origin string, coords array<double>, weight double")
