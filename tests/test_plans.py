"""Physical-plan checks: what must stay true for the plans to scale."""

import pytest

import __spark_entry__ as E
from medallion import queries as Q
from medallion.sinks import upsert as U
from medallion.sinks import writers as W
from tests.conftest import SF

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
                "PythonUDF", "MapInArrow")
# queries whose plan is cheap to build (no writes, no model fits)
PURE = ["rollup_city", "impute_split", "group_means", "sorted_summary", "top_k", "top_k_rate",
        "top_k_wards", "preview", "clean_names", "nice_case", "na_to_null", "regex_na_to_null",
        "null_profile", "drop_sparse", "numeric_profile", "coerce_types", "fill_zero",
        "preprocess", "drop_columns", "exclude_entities", "semi_join_distinct", "union_counts",
        "partition_values", "format_scan", "minmax_scale", "label_map", "rank_labels",
        "table_scan", "query_source", "reconcile_counts"]


def plan(df) -> str:
    jvm = df.sparkSession._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", PURE)
def test_no_python_in_plan(spark, name):
    p = plan(E.queries()[name](spark, SF))
    assert not any(n in p for n in PYTHON_NODES), p


def test_rollup_prunes_columns_and_aggregates_partially(spark):
    p = plan(E.queries()["rollup_city"](spark, SF))
    assert "partial_sum" in p and "partial_avg" in p
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int,c_acctbal:double>" in p


def test_top_k_is_take_ordered(spark):
    for name in ("top_k", "top_k_wards", "preview"):
        p = plan(E.queries()[name](spark, SF))
        assert "TakeOrderedAndProject" in p, name


def test_filter_reaches_the_scan(spark):
    p = plan(E.queries()["exclude_entities"](spark, SF))
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThan(c_acctbal,0.0)" in p


def test_semi_join_shuffles_distinct_keys_only(spark):
    p = plan(E.queries()["semi_join_distinct"](spark, SF))
    assert "LeftSemi" in p
    # every shuffle sits directly on a partial (map-side) aggregate
    tree = p.split("\n\n")[0].splitlines()
    shuffles = [i for i, ln in enumerate(tree) if "Exchange" in ln and "Broadcast" not in ln]
    assert shuffles
    for i in shuffles:
        assert "HashAggregate" in tree[i + 1], "\n".join(tree)


def test_profile_is_one_aggregate(spark):
    p = plan(E.queries()["null_profile"](spark, SF))
    tree = p.split("\n\n")[0]
    assert tree.count("HashAggregate") == 2 and tree.count("Scan parquet") == 1, tree


def test_upsert_reads_only_named_partitions(spark, db):
    o = Q.T(spark, SF, "orders")
    t = f"{db}.op"
    W.insert_table(o, t, partition_by="o_orderstatus")
    batch = Q.moved_batch(o).where("o_orderstatus = 'F'")
    target = spark.table(t)
    touched = U._named(target, batch.select("o_orderstatus").distinct().collect(), ["o_orderstatus"])
    merged = U.merge_frames(touched, batch, "o_orderkey", "o_orderstatus", check=False)
    merged.write.format("noop").mode("overwrite").save()
    p = plan(merged)
    assert "LeftAnti" in p
    scan = [ln for ln in p.splitlines() if "PartitionFilters" in ln]
    assert any("o_orderstatus" in ln and "IN (F)" in ln or "= F)" in ln for ln in scan), scan


def test_hot_key_rollup_is_exact_and_map_side(spark):
    """A key holding a third of the rows: partial aggregation before the
    shuffle, and exact sums."""
    from pyspark.sql import functions as F

    from medallion.operators import rollup as R
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
        .alias("City"), F.col("id").cast("double").alias("v"))
    out = R.rollup(df, "City", ["v"], counts={"n": "*"})
    p = plan(out)
    assert "partial_sum" in p and "partial_count" in p
    hot = out.where("City = 'hot'").collect()[0]
    assert hot.n == 10000 and hot.v == float(sum(range(0, 30000, 3)))


def test_a_frame_knows_where_it_reads(spark, db, tmp_path):
    from medallion.sinks.writers import reads_from
    path = str(tmp_path / "a" / "o")
    spark.range(3).write.parquet(path)
    df = spark.read.parquet(path).where("id > 1")
    assert reads_from(df, path) and reads_from(df, f"file://{path}/") and reads_from(df, str(tmp_path / "a"))
    assert not reads_from(df, str(tmp_path / "a" / "other")) and not reads_from(spark.range(3), path)
    spark.range(3).write.saveAsTable(f"{db}.located")
    t = spark.table(f"{db}.located")
    assert reads_from(t.join(df, "id"), path) and not reads_from(t, path)
