"""Profiles kept per partition and merged (A4, A5)."""

from pyspark.sql import functions as F

from medallion.operators import clean as K
from medallion.operators import profile_state as PS
from medallion.sinks import upsert as U
from medallion.sinks import writers as W
from tests.conftest import SF


def rows_of(spark, n=400):
    i = F.col("id")
    return spark.range(n).select(
        i.alias("k"), F.when(i % 3 != 0, i.cast("string")).alias("t"), F.when(i % 7 == 0, "x").otherwise("1.5").alias("m"),
        F.concat(F.lit("a/b +"), (i % 4).cast("string")).alias("p"))


def same(spark, t, state):
    key = lambda p: p.name
    return sorted(PS.stored_profile(spark, t, state), key=key) == sorted(K.profile(spark.table(t)), key=key)


def test_equals_the_full_profile_as_partitions_come_and_go(spark, db):
    t, state = f"{db}.t", f"{db}.states"
    W.insert_table(rows_of(spark).where("k % 4 < 2"), t, partition_by="p")
    assert PS.refresh_profile(spark, t, state) == 2 and same(spark, t, state)
    assert PS.refresh_profile(spark, t, state) == 0
    W.insert_table(rows_of(spark).where("k % 4 = 3"), t, partition_by="p")
    assert PS.refresh_profile(spark, t, state) == 1 and same(spark, t, state)
    # an overwritten partition, an upserted one, and one that is dropped
    W.insert_table(rows_of(spark, 40).where("k % 4 = 0"), t, overwrite=True, partition_by="p", partition_mode="dynamic")
    assert PS.refresh_profile(spark, t, state) == 1 and same(spark, t, state)
    U.upsert(rows_of(spark, 8).where("k % 4 = 1").withColumn("t", F.lit("new")), "k", table=t)
    assert PS.refresh_profile(spark, t, state) == 1 and same(spark, t, state)
    spark.sql(f"ALTER TABLE {t} DROP PARTITION (p = 'a/b +3')")
    assert PS.refresh_profile(spark, t, state) == 0 and same(spark, t, state)


def test_an_unpartitioned_table_and_two_tables_in_one_store(spark, db):
    state = f"{db}.states"
    o = spark.read.parquet(f"{SF}/orders.parquet")
    W.insert_table(o, f"{db}.o")
    W.insert_table(rows_of(spark), f"{db}.r")
    assert same(spark, f"{db}.o", state) and same(spark, f"{db}.r", state) and same(spark, f"{db}.o", state)
    spark.sql(f"TRUNCATE TABLE {db}.r")
    assert same(spark, f"{db}.r", state) and same(spark, f"{db}.o", state)


def test_a_column_that_comes_later(spark, db):
    t, state = f"{db}.t", f"{db}.states"
    W.insert_table(rows_of(spark).where("k % 4 = 0"), t, partition_by="p")
    PS.refresh_profile(spark, t, state)
    spark.sql(f"ALTER TABLE {t} ADD COLUMNS (late string)")
    W.insert_table(rows_of(spark).where("k % 4 = 1").withColumn("late", F.lit("7")), t, partition_by="p")
    assert PS.refresh_profile(spark, t, state) == 1 and same(spark, t, state)


def files_read(df):
    """What the scans of a frame that ran count as files read."""
    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        if kind == "FileSourceScanExec":
            return node.metrics().get("numFiles").get().value()
        children = node.children()
        return sum(walk(children.apply(i)) for i in range(children.size()))
    return walk(df._jdf.queryExecution().executedPlan())


def test_only_new_partitions_are_scanned(spark, db):
    """The folder filter prunes files when the scan is planned."""
    t, state = f"{db}.t", f"{db}.states"
    W.insert_table(rows_of(spark), t, partition_by="p")
    PS.refresh_profile(spark, t, state)
    folder = spark.table(state).orderBy("folder").first()["folder"]
    whole, part = (PS.partition_states(df) for df in (
        spark.table(t), spark.table(t).where(PS._folder().isin([folder]))))
    whole.collect()
    part.collect()
    assert 0 < 3 * files_read(part) < files_read(whole)
