"""Content reconciliation."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from medallion.operators import reconcile as R
from tests.conftest import SF
from tests.test_plans import plan


def orders(spark):
    return spark.read.parquet(f"{SF}/orders.parquet")


def differing(df):
    return [(r["first_key"], r["end_key"]) for r in df.where("NOT same").collect()]


def test_equal_tables_in_any_order_and_layout(spark, tmp_path):
    o = orders(spark)
    o.repartition(7, "o_custkey").write.json(str(tmp_path / "json"))
    text = spark.read.schema(", ".join(f"{c} string" for c in o.columns)).json(str(tmp_path / "json"))
    back = text.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in o.schema.fields])
    found = R.reconcile_content(o, back, "o_orderkey", 16).collect()
    assert len(found) == 16 and all(r["same"] for r in found)
    assert sum(r["left_rows"] for r in found) == o.count()


@pytest.mark.parametrize("change", ["value", "missing", "twice", "swapped"])
def test_one_change_is_located(spark, change):
    o = orders(spark)
    key = sorted(r[0] for r in o.select("o_orderkey").collect())[700]
    hit = F.col("o_orderkey") == key
    if change == "value":
        other = o.withColumn("o_totalprice", F.when(hit, F.col("o_totalprice") + 0.01).otherwise(F.col("o_totalprice")))
    elif change == "missing":
        other = o.where(~hit)
    elif change == "twice":                                  # also twice more, which an exclusive or would not see
        other = o.union(o.where(hit)).union(o.where(hit))
    else:                                                    # NULL against the empty text
        o = o.withColumn("o_orderpriority", F.when(hit, F.lit(None)).otherwise(F.col("o_orderpriority")))
        other = o.withColumn("o_orderpriority", F.when(hit, F.lit("")).otherwise(F.col("o_orderpriority")))
    ((first, end),) = differing(R.reconcile_content(o, other, "o_orderkey", 20))
    assert first <= key < end
    rows = R.differing_rows(o, other, "o_orderkey", 20).collect()
    sides = {"value": {"left", "right"}, "missing": {"left"}, "twice": {"right"}, "swapped": {"left", "right"}}
    assert {r["side"] for r in rows} == sides[change] and {r["o_orderkey"] for r in rows} == {str(key)}
    assert {r["copies"] for r in rows} == ({2} if change == "twice" else {1})


def test_only_differing_ranges_are_read_again(spark):
    o = orders(spark)
    key = sorted(r[0] for r in o.select("o_orderkey").collect())[700]
    p = plan(R.differing_rows(o, o.where(F.col("o_orderkey") != key), "o_orderkey", 20))
    pushed = [ln for ln in p.splitlines() if ln.startswith("PushedFilters")]
    assert pushed and all("GreaterThanOrEqual(o_orderkey" in ln and "LessThan(o_orderkey" in ln for ln in pushed), p


def test_other_keys_and_edges(spark):
    day = dt.date(2020, 1, 1)
    rows = [(f"k{i:03d}", day + dt.timedelta(days=i), i) for i in range(200)] + [(None, None, 7), (None, None, 7)]
    df = spark.createDataFrame(rows, "s string, d date, v int")
    for key in ("s", "d"):
        assert differing(R.reconcile_content(df, df, key, 10)) == []
        assert len(differing(R.reconcile_content(df, df.where("v <> 150"), key, 10))) == 1
        found = R.differing_rows(df, df.where("v <> 7"), key, 10).collect()
        assert sorted((r["side"], r["copies"], r["v"]) for r in found) == [("left", 1, "7"), ("left", 2, "7")]
    none = df.limit(0)
    assert [r["same"] for r in R.reconcile_content(df, none, "s", 4).collect()] == [False] * 5
    assert R.reconcile_content(none, none, "v").collect() == [] == R.differing_rows(none, none, "v").collect()
    assert R.differing_rows(none, df, "v").count() == 201
    # names to compare, and columns that are not there
    assert differing(R.reconcile_content(df, df.withColumn("v", F.lit(0)), "s", 4, columns=["s", "d"])) == []
    with pytest.raises(ValueError, match="lacks"):
        R.reconcile_content(df, df.drop("d"), "s")


def test_a_hot_key_is_aggregated_map_side(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("k"), "id")
    found = R.reconcile_content(df, df.where("id <> 9"), "k", 8)
    assert "partial_count" in plan(found) and len(differing(found)) == 1
    assert [(r["k"], r["id"]) for r in R.differing_rows(df, df.where("id <> 9"), "k", 8).collect()] == [("5", "9")]
