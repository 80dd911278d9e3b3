from medallion.plans import catalog as CAT
from medallion.sinks import writers as W
from tests.conftest import SF


def test_layers_list_reset_describe(spark, tmp_path):           # C1, C2, C4, C6
    from medallion.session import unique_name
    a, b = unique_name("silver"), unique_name("gold")
    CAT.create_layers(spark, [a, b], root=str(tmp_path))
    CAT.create_layers(spark, [a, b], root=str(tmp_path))          # idempotent
    o = spark.read.parquet(f"{SF}/orders.parquet")
    W.insert_table(o, f"{a}.orders", partition_by="o_orderstatus")
    W.insert_table(o, f"{a}.orders2")
    spark.range(1).createOrReplaceTempView("df")
    names = sorted(r.table_name for r in CAT.list_tables(spark, a).collect())
    assert names == ["orders", "orders2"]
    CAT.use_layer(spark, a)
    assert spark.catalog.currentDatabase() == a and spark.table("orders2").count() == o.count()
    CAT.use_layer(spark, "default")
    schema = {r.col_name: r.data_type for r in CAT.describe_schema(spark, f"{a}.orders").collect()}
    assert schema["o_orderkey"] == "bigint" and "o_orderstatus" in schema
    info = {r.info_name for r in CAT.describe_database(spark, a).collect()}
    assert "Location" in info
    detail = CAT.table_detail(spark, f"{a}.orders").collect()[0]
    assert detail.format == "parquet" and detail.num_files >= 3 and detail.size_in_bytes > 0
    counts = {r.table_name: r.row_count for r in
              CAT.reconcile(spark, [f"{a}.orders", f"{a}.orders2"]).collect()}
    assert counts == {f"{a}.orders": o.count(), f"{a}.orders2": o.count()}   # W7, D11
    spark.sql(f"CREATE VIEW {a}.v AS SELECT * FROM {a}.orders2")
    dropped = CAT.reset_layer(spark, a)
    assert sorted(dropped) == ["orders", "orders2", "v"]
    assert CAT.list_tables(spark, a).count() == 0
    spark.catalog.dropTempView("df")
