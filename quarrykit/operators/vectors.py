"""Vector operators: nearest centroid, cluster selection, k-means."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.operators.filters import by_threshold, caption_filter
from quarrykit.session import ship

#: Centroids that are sent to the workers at most; 100 000 of 512 doubles are 400 MB, the published setting at float32 half of it.
MOST_CENTROIDS = 200_000


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, vector: str = "embedding", out: str = "centroid") -> DataFrame:
    """The id of the centroid (id, v) with the largest dot product, the smallest id of equals; null for null vectors.

    The centroids are broadcast, their number being a checked parameter of the model, and a batch is one matrix product.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = centroids.orderBy("id").limit(MOST_CENTROIDS + 1).collect()
    if len(rows) > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} centroids")
    ids = np.array([r["id"] for r in rows])
    sent = spark.sparkContext.broadcast((ids, np.array([r["v"] for r in rows], np.float64)))

    @F.pandas_udf("long")
    def nearest(v: pd.Series) -> pd.Series:
        own, matrix = sent.value
        result = pd.Series([None] * len(v), dtype="Int64")
        ok = v.notna().to_numpy()
        if ok.any() and len(own):
            result[ok] = own[np.argmax(np.stack(v[ok].to_list()).astype(np.float64) @ matrix.T, axis=1)]
        return result

    return vectors.withColumn(out, nearest(F.col(vector)))


def in_target_clusters(vectors: DataFrame, centroids: DataFrame, targets: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose nearest centroid is that of some target row."""
    wanted = nearest_centroid(targets, centroids, vector).select("centroid").distinct()
    return nearest_centroid(vectors, centroids, vector).join(wanted, "centroid", "left_semi")


def image_based(captions: DataFrame, centroids: DataFrame, targets: DataFrame, score: str | None = None, threshold: float | None = None) -> DataFrame:
    """P26; P27 with a score and threshold, which are applied first."""
    kept = caption_filter(captions)
    if score is not None:
        kept = by_threshold(kept, score, threshold)
    return in_target_clusters(kept, centroids, targets)


def kmeans(vectors: DataFrame, k: int, seed: int = 42, iterations: int = 20, vector: str = "embedding") -> DataFrame:
    """(id, v), the centroids of Lloyd's algorithm on squared distances."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = vectors.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=k, maxIter=iterations, seed=seed).fit(data)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "id long, v array<double>")
