import pytest
from pyspark.sql import functions as F

from medallion.sinks import writers as W
from tests.conftest import SF


def orders(spark):
    return spark.read.parquet(f"{SF}/orders.parquet")


def test_create_append_by_name(spark, db):                      # K1, K3, D13
    o = orders(spark)
    t = f"{db}.o"
    W.insert_table(o.where("o_orderstatus = 'F'"), t)
    rest = o.where("o_orderstatus <> 'F'")
    W.insert_table(rest.select(*reversed(rest.columns)), t)
    assert spark.table(t).count() == o.count()
    assert spark.table(t).exceptAll(o).count() == 0


def test_overwrite_and_skip_empty(spark, db):                   # K4, K10, D12
    o = orders(spark)
    t = f"{db}.o"
    W.insert_table(o, t)
    assert W.insert_table(o.where(F.lit(False)), t, overwrite=True) is False
    assert spark.table(t).count() == o.count()
    W.insert_table(o.limit(3), t, overwrite=True)
    assert spark.table(t).count() == 3


def test_static_vs_dynamic_partition_overwrite(spark, db):      # K2, K5
    o = orders(spark)
    for mode, expect_other in (("static", 0), ("dynamic", None)):
        t = f"{db}.p_{mode}"
        W.insert_table(o, t, partition_by="o_orderstatus")
        f_rows = o.where("o_orderstatus = 'F'")
        W.insert_table(f_rows, t, overwrite=True, partition_by="o_orderstatus",
                       partition_mode=mode)
        other = spark.table(t).where("o_orderstatus <> 'F'").count()
        want = expect_other if expect_other is not None else o.where("o_orderstatus <> 'F'").count()
        assert other == want
        assert spark.table(t).where("o_orderstatus = 'F'").count() == f_rows.count()


def test_path_modes(spark, tmp_path):                           # K6, D6
    o = orders(spark)
    p = str(tmp_path / "o")
    W.write_path(o, p, "append", partition_by="o_orderstatus")
    W.write_path(o, p, "append", partition_by="o_orderstatus")
    assert spark.read.parquet(p).count() == 2 * o.count()
    W.write_path(o, p, "overwrite", partition_by="o_orderstatus")
    assert spark.read.parquet(p).count() == o.count()
    with pytest.raises(ValueError):
        W.write_path(o, p, "insert into")


def test_dispatcher_and_csv_export(spark, db, tmp_path):        # K11, K12, D22
    o = orders(spark).drop("o_orderdate")
    t = f"{db}.o"
    W.write_sink(o, table=t, mode="insert into ")
    W.write_sink(o, table=t, mode="insert into ")
    assert spark.table(t).count() == 2 * o.count()
    W.write_sink(o, table=t, mode="insert overwrite ")
    assert spark.table(t).count() == o.count()
    p = str(tmp_path / "csv")
    assert W.export_csv(o, p)
    back = spark.read.option("header", "true").csv(p)
    assert back.columns == o.columns                            # no index column
    assert back.count() == o.count()
    assert W.export_csv(o.where(F.lit(False)), str(tmp_path / "empty")) is False


def test_table_exists_ignores_temp_views(spark, db):            # C3, D20
    spark.range(1).createOrReplaceTempView("df")
    assert not W.table_exists(spark, "df", db)
    spark.range(1).write.saveAsTable(f"{db}.Mixed")
    assert W.table_exists(spark, "MIXED", db)
    spark.catalog.dropTempView("df")


def test_insert_by_name_rejects_mismatched_columns(spark, db):
    o = orders(spark)
    t = f"{db}.o"
    W.insert_table(o, t)
    with pytest.raises(ValueError, match="extra"):
        W.insert_table(o.withColumn("x", F.lit(1)), t)
    with pytest.raises(ValueError, match="missing"):
        W.insert_table(o.drop("o_custkey"), t, overwrite=True)
    assert spark.table(t).count() == o.count()


def test_overwrite_from_the_same_table(spark, db):               # staged swap
    o = orders(spark)
    t = f"{db}.o"
    W.insert_table(o, t, partition_by="o_orderstatus")
    W.insert_table(spark.table(t).where("o_totalprice > 100000"), t, overwrite=True,
                   partition_by="o_orderstatus")
    assert spark.table(t).count() == o.where("o_totalprice > 100000").count()


def test_path_overwrite_from_the_same_path(spark, tmp_path):
    o = orders(spark)
    p = str(tmp_path / "o")
    W.write_path(o, p, "overwrite")
    W.write_path(spark.read.parquet(p).where("o_orderstatus = 'F'"), p, "overwrite")
    assert spark.read.parquet(p).count() == o.where("o_orderstatus = 'F'").count()


def test_overwrites_go_on_side_by_side(spark, db):                # K4, K5
    """Two slow dynamic overwrites: each one's rows say when its tasks began
    and ended, and the spans overlap; the session keeps its mode."""
    from concurrent.futures import ThreadPoolExecutor
    schema = "k int, p string, began string, ended string"
    for t in ("one", "two"):
        W.insert_table(spark.createDataFrame([(0, "a", "", ""), (0, "b", "", "")], schema), f"{db}.{t}",
                       partition_by="p")
    now = F.expr("java_method('java.lang.System', 'currentTimeMillis')")
    pause = F.expr("coalesce(reflect('java.lang.Thread', 'sleep', 3000L), '')")

    def slow(t):
        rows = spark.range(1).select(F.lit(1).alias("k"), F.lit("a").alias("p"), now.alias("began"), pause.alias("x"))
        late = rows.withColumn("ended", F.concat("x", now)).select("k", "p", "began", "ended")
        return W.insert_table(late, f"{db}.{t}", overwrite=True, partition_by="p", partition_mode="dynamic")

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(slow, ["one", "two"])) == [True, True]
    spans = []
    for t in ("one", "two"):
        rows = {r.p: r for r in spark.table(f"{db}.{t}").collect()}
        assert set(rows) == {"a", "b"} and rows["b"].k == 0
        spans.append((int(rows["a"].began), int(rows["a"].ended[-13:])))
    assert max(b for b, _ in spans) < min(e for _, e in spans), spans
    assert spark.conf.get(W.OVERWRITE_MODE).lower() == "static"


def test_dynamic_overwrite_from_the_same_table(spark, db):
    o = orders(spark)
    t = f"{db}.o"
    W.insert_table(o, t, partition_by="o_orderstatus")
    W.insert_table(spark.table(t).where("o_orderstatus = 'F' and o_totalprice > 100000"), t, overwrite=True,
                   partition_by="o_orderstatus", partition_mode="dynamic")
    want = o.where("o_orderstatus <> 'F' or o_totalprice > 100000").count()
    assert spark.table(t).count() == want


def test_a_session_of_its_own_keeps_the_settings(spark, db):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        own = W.own_session(spark, {W.OVERWRITE_MODE: "DYNAMIC"})
        assert own.conf.get("spark.sql.shuffle.partitions") == "7"
        assert own.conf.get(W.OVERWRITE_MODE).upper() == "DYNAMIC"
        assert own.conf.get("spark.sql.session.timeZone") == spark.conf.get("spark.sql.session.timeZone")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
