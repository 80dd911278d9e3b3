import itertools
import math

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from medallion.operators import cluster as C


def blobs(spark, n=30):
    """Three separated groups in 2-D, one constant column, one NULL feature."""
    rng = np.random.default_rng(7)
    rows = []
    for g, (cx, cy) in enumerate([(0, 0), (10, 10), (0, 10)]):
        for i in range(n):
            rows.append((g * 1000 + i, g, float(cx + rng.normal(0, .3)),
                         float(cy + rng.normal(0, .3)), 5.0))
    rows.append((9999, -1, None, 1.0, 5.0))
    return spark.createDataFrame(rows, "id long, g int, x double, y double, c double")


def test_minmax_matches_formula_and_constant_is_half(spark):    # M1, M2
    df = blobs(spark)
    out = C.minmax_scale(df, ["x", "y", "c"])
    assert out.count() == df.count() - 1                        # NULL row skipped
    arr = out.select("x", "y", vector_to_array("features").alias("f")).collect()
    xs = [r.x for r in arr]
    lo, hi = min(xs), max(xs)
    for r in arr:
        assert math.isclose(r.f[0], (r.x - lo) / (hi - lo), abs_tol=1e-12)
        assert r.f[2] == 0.5
        assert 0.0 <= r.f[1] <= 1.0


def test_kmeans_recovers_blobs_up_to_relabel(spark):            # M3, M4
    res = C.kmeans_clusters(blobs(spark), ["x", "y"], k=3, seed=1, layout_key="id")
    pairs = res.frame.select("g", "Clusters").distinct().collect()
    mapping = {}
    for r in pairs:
        mapping.setdefault(r.g, set()).add(r.Clusters)
    assert all(len(v) == 1 for v in mapping.values())
    assert len({next(iter(v)) for v in mapping.values()}) == 3
    assert res.trained_rows == 90 and res.skipped_rows == 1
    res.unpersist()


def test_layout_makes_fit_independent_of_partitioning(spark):   # D4
    df = blobs(spark)
    centres = []
    for n in (1, 4, 9):
        res = C.kmeans_clusters(df.repartition(n), ["x", "y"], k=3, seed=1, layout_key="id",
                                partitions=4)
        centres.append(sorted(tuple(round(v, 9) for v in c) for c in res.centers))
        res.unpersist()
    assert centres[0] == centres[1] == centres[2]
    # and with the row-count sizing (one partition for this small input)
    again = []
    for n in (1, 5):
        res = C.kmeans_clusters(df.repartition(n), ["x", "y"], k=3, seed=1, layout_key="id")
        again.append(sorted(tuple(round(v, 9) for v in c) for c in res.centers))
        res.unpersist()
    assert again[0] == again[1]


def test_silhouette_matches_brute_force(spark):                  # M5
    res = C.kmeans_clusters(blobs(spark, 10), ["x", "y"], k=3, seed=1, layout_key="id")
    score = C.silhouette(res)
    pts = [(np.array(r.f), r.Clusters) for r in
           res.frame.select(vector_to_array("features").alias("f"), "Clusters").collect()]
    sil = []
    for p, c in pts:
        d = {}
        for q, c2 in pts:
            d.setdefault(c2, []).append(float(np.sum((p - q) ** 2)))
        own = d[c]
        a = sum(own) / (len(own) - 1) if len(own) > 1 else 0.0
        b = min(sum(v) / len(v) for k, v in d.items() if k != c)
        sil.append(0.0 if len(own) == 1 else (b - a) / max(a, b))
    assert math.isclose(score, sum(sil) / len(sil), rel_tol=1e-6)
    res.unpersist()


def test_silhouette_single_cluster_is_none(spark):
    df = spark.createDataFrame([(i, 1.0, 1.0) for i in range(6)], "id long, x double, y double")
    res = C.kmeans_clusters(df, ["x", "y"], k=2, seed=1)
    assert C.silhouette(res) is None
    res.unpersist()


def test_pca_equals_projection_on_top_eigenvectors(spark):      # M6, M8
    res = C.kmeans_clusters(blobs(spark), ["x", "y", "c"], k=3, seed=1, layout_key="id")
    pca, model = C.pca_2d(res.frame)
    rows = pca.select(vector_to_array("features").alias("f"),
                      vector_to_array("pca_features").alias("p")).collect()
    X = np.array([r.f for r in rows])
    cov = np.cov(X, rowvar=False)
    w, v = np.linalg.eigh(cov)
    top = v[:, np.argsort(w)[::-1][:2]]
    proj = X @ top
    got = np.array([r.p for r in rows])
    assert np.allclose(np.abs(got), np.abs(proj), atol=1e-6)
    sc = C.scatter_points(pca, ["id"])
    assert sc.columns == ["id", "x", "y", "Clusters"] and sc.count() == len(rows)
    res.unpersist()


def test_labels_by_map_and_by_rank(spark):                      # P14, M7
    df = spark.createDataFrame([(0, 5.0), (0, 7.0), (1, 1.0), (2, 3.0), (3, 9.0)],
                               "Clusters int, m double")
    lm = {r.Clusters: r.L for r in C.label_clusters(df, "L").collect()}
    assert lm == {0: "Medium", 1: "Small", 2: "Large", 3: "Large"}
    rk = {r.Clusters: r.L for r in C.rank_labels(df, "m", "L").collect()}
    assert rk == {1: "Small", 2: "Medium", 0: "Large", 3: "Rank4"}


def test_layout_spreads_a_hot_key(spark):
    """A key holding a third of the rows must not land in one partition."""
    rows = [(("hot" if i % 3 == 0 else f"k{i}"), float(i), float(i % 7)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    laid = C.stable_layout(df, "k", 8, extra=["x", "y"])
    sizes = [r["count"] for r in laid.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 0.25 * 3000


def test_callers_cache_is_left_alone(spark):
    df = blobs(spark).persist()
    df.count()
    res = C.kmeans_clusters(df, ["x", "y"], k=3, seed=1)
    res.unpersist()
    assert df.is_cached
    res2 = C.kmeans_clusters(df, ["x", "y"], k=3, seed=1, layout_key="id")
    res2.unpersist()
    assert df.is_cached
    df.unpersist()


def test_more_clusters_than_rows(spark):
    """k above the row count leaves clusters empty instead of failing."""
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0)], "id long, x double, y double")
    res = C.kmeans_clusters(df, ["x", "y"], k=3, seed=1, layout_key="id")
    assert sorted(res.cluster_sizes) == [0, 1, 1]
    assert C.silhouette(res) == 0.0
    labels = {r.Clusters: r.L for r in C.rank_labels(res.frame, "x", "L").collect()}
    assert sorted(labels.values()) == ["Medium", "Small"]
    res.unpersist()
