"""Clustering operators (M1-M9, P14, A2, A3) on Spark ML.

Assemble (rows with NULL/NaN features skipped) -> min-max scale -> K-means
(k-means||, seed) in one ``Pipeline``; then silhouette, PCA to two
components, scatter data, cluster sizes and mean measures, and labels.

Repeatability (D4): K-means|| initialisation samples per partition, so the
same seed gives other centres on another partitioning.  With ``layout_key``
the input is hash-partitioned on that key and the features into a number
of partitions that the caller states, and sorted inside each one before
fitting, which makes the fit independent of how the input arrived; size the
number for the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, MinMaxScaler, PCAModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import CLUSTER_LABEL_OTHER, CLUSTER_LABELS, RANK_LABELS, label_by_map

RAW = "raw_features"
FEATURES = "features"
CLUSTER = "Clusters"
PCA_OUT = "pca_features"
LAYOUT_PARTITIONS = 8


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


# ------------------------------------------------------------ M1, M2

def assembler(feature_cols: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(feature_cols), outputCol=RAW, handleInvalid="skip")


def scaler() -> MinMaxScaler:
    return MinMaxScaler(inputCol=RAW, outputCol=FEATURES)


def minmax_scale(df: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
    """M1 + M2: assemble (skipping invalid rows) and scale to [0, 1]; a
    constant feature becomes 0.5."""
    model = Pipeline(stages=[assembler(feature_cols), scaler()]).fit(df)
    return model.transform(df)


# ------------------------------------------------------------ M3, M4

@dataclass
class ClusterResult:
    frame: DataFrame            # input + raw_features, features, Clusters (persisted)
    model: PipelineModel
    feature_cols: list[str]
    source: DataFrame | None = None   # the persisted input
    offered: DataFrame | None = None  # rows offered to the assembler

    @property
    def cluster_sizes(self) -> list[int]:
        return list(self.model.stages[-1].summary.clusterSizes)

    @property
    def trained_rows(self) -> int:
        return int(sum(self.cluster_sizes))

    @property
    def skipped_rows(self) -> int | None:
        """M1: rows the assembler skipped for a NULL or NaN feature."""
        return None if self.offered is None else self.offered.count() - self.trained_rows

    @property
    def centers(self) -> list[list[float]]:
        return [list(map(float, c)) for c in self.model.stages[-1].clusterCenters()]

    def unpersist(self) -> None:
        self.frame.unpersist()
        if self.source is not None:
            self.source.unpersist()


def _sortable(df: DataFrame, cols: Sequence[str]) -> list[str]:
    types = dict(df.dtypes)
    return [c for c in cols if c in types and not types[c].startswith(("vector", "array",
                                                                       "map", "struct"))]


def stable_layout(df: DataFrame, key: str | Sequence[str], partitions: int,
                  extra: Sequence[str] = ()) -> DataFrame:
    """Hash layout on ``key`` (plus ``extra`` atomic columns, so a key that
    repeats cannot pile its rows into one partition) into ``partitions``
    partitions, sorted inside each: the same rows always reach K-means in
    the same order, whatever partitioning they arrived with."""
    keys = [key] if isinstance(key, str) else list(key)
    cols = keys + [c for c in _sortable(df, extra) if c not in keys]
    return df.repartition(partitions, *[_q(c) for c in cols]).sortWithinPartitions(
        *[_q(c) for c in cols])


def kmeans_clusters(df: DataFrame, feature_cols: Sequence[str], k: int = 3, seed: int = 1,
                    layout_key: str | Sequence[str] | None = None,
                    partitions: int = LAYOUT_PARTITIONS,
                    max_iter: int = 20, tol: float = 1e-4) -> ClusterResult:
    """M3 + M4: fit assemble -> scale -> K-means and return the transformed
    frame (persisted, since silhouette, PCA, labels and the write all read
    it) together with the fitted pipeline.

    The input is persisted (spilling to disk when needed; lost blocks are
    rebuilt from lineage) because the scaler fit, every K-means pass and
    the transform read it.  With ``layout_key`` it is laid out first (see
    ``stable_layout``) over ``partitions`` partitions, a number that the
    caller sizes for the data and the cluster and that no row count changes:
    the same rows give the same centres, however they arrive."""
    if k < 2:
        raise ValueError("k must be at least 2")
    owned = not df.is_cached          # never release a cache the caller made
    src = df
    if layout_key:
        src, owned = stable_layout(df, layout_key, partitions, feature_cols), True
    if owned:
        src = src.persist(StorageLevel.MEMORY_AND_DISK)
    km = KMeans(featuresCol=FEATURES, predictionCol=CLUSTER, k=k, seed=seed,
                maxIter=max_iter, tol=tol)
    model = Pipeline(stages=[assembler(feature_cols), scaler(), km]).fit(src)
    out = model.transform(src).persist(StorageLevel.MEMORY_AND_DISK)
    return ClusterResult(out, model, list(feature_cols), src if owned else None, src)


# ------------------------------------------------------------ M5, M6, M8

def silhouette(result: ClusterResult) -> float | None:
    """M5: silhouette (squared euclidean) of the scaled features; NULL when
    fewer than two clusters hold points (the evaluator fails there)."""
    if sum(1 for s in result.cluster_sizes if s > 0) < 2:
        return None
    ev = ClusteringEvaluator(featuresCol=FEATURES, predictionCol=CLUSTER)
    return float(ev.evaluate(result.frame.select(FEATURES, CLUSTER)))


def pca_2d(df: DataFrame, k: int = 2, input_col: str = FEATURES) -> tuple[DataFrame, PCAModel]:
    """M6: project onto the first k principal components (not mean-centred,
    sign arbitrary).  The covariance is k_features x k_features, so only
    that small matrix is decomposed on the driver."""
    model = PCA(k=k, inputCol=input_col, outputCol=PCA_OUT).fit(df)
    return model.transform(df), model


def scatter_points(pca_frame: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """M8: x, y and cluster per row (the data behind the scatter chart; X9)."""
    arr = vector_to_array(F.col(PCA_OUT))
    return pca_frame.select(*[_q(c) for c in keys], arr[0].alias("x"), arr[1].alias("y"),
                            F.col(CLUSTER))


# ------------------------------------------------------------ P14, M7

def label_clusters(df: DataFrame, label_col: str, mapping: Mapping[int, str] = CLUSTER_LABELS,
                   other: str = CLUSTER_LABEL_OTHER, cluster_col: str = CLUSTER) -> DataFrame:
    """Literal id -> label map, as the original does."""
    return df.withColumn(label_col, label_by_map(_q(cluster_col), mapping, other))


def rank_labels(df: DataFrame, measure: str, label_col: str,
                labels: Sequence[str] = RANK_LABELS, cluster_col: str = CLUSTER) -> DataFrame:
    """M7: order clusters by the mean of ``measure`` and name them by rank
    (Small < Medium < Large).  Only one row per value of ``cluster_col``
    takes part in the window; the optimizer chooses how that table comes back."""
    means = df.groupBy(_q(cluster_col)).agg(F.avg(_q(measure)).alias("__mean"))
    ranked = means.withColumn(
        "__rank", F.row_number().over(Window.orderBy(F.col("__mean").asc_nulls_first(),
                                                      _q(cluster_col))))
    expr = F.concat(F.lit("Rank"), F.col("__rank").cast("string"))
    for i, name in enumerate(labels, start=1):
        expr = F.when(F.col("__rank") == i, F.lit(name)).otherwise(expr)
    table = ranked.select(_q(cluster_col), expr.alias(label_col))
    return df.join(table, cluster_col, "left")


def portable(df: DataFrame, vector_cols: Sequence[str] = (RAW, FEATURES)) -> DataFrame:
    """Vectors as ``array<double>`` so any engine can read the gold table."""
    return df.withColumns({c: vector_to_array(F.col(c)) for c in vector_cols if c in df.columns})
