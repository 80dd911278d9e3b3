from medallion.session import unique_name
from medallion.streaming.landing import stream_ingest, streamed_rows


def test_stream_ingest_is_incremental(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.csv").write_text("City Name,Total (x)\nPune,1\nAgra,2\n")
    db = unique_name("silver")
    spark.sql(f"CREATE DATABASE {db}")
    t = f"{db}.s"
    ck = str(tmp_path / "ck")
    stream_ingest(spark, str(landing), t, ck)
    assert streamed_rows(spark, t).columns == ["CityName", "Totalx"]
    assert spark.table(t).count() == 2
    stream_ingest(spark, str(landing), t, ck)                  # nothing new: no duplicates
    assert spark.table(t).count() == 2
    (landing / "b.csv").write_text("City Name,Total (x)\nGoa,3\n")
    stream_ingest(spark, str(landing), t, ck)
    assert sorted(r.CityName for r in spark.table(t).collect()) == ["Agra", "Goa", "Pune"]


def test_stream_merge_upserts_each_batch(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.csv").write_text("Id,Val\n1,a\n2,b\n")
    db = unique_name("silver")
    spark.sql(f"CREATE DATABASE {db}")
    t = f"{db}.m"
    ck = str(tmp_path / "ck")
    stream_ingest(spark, str(landing), t, ck, mode="merge", keys=["Id"])
    (landing / "b.csv").write_text("Id,Val\n2,B\n3,c\n")
    stream_ingest(spark, str(landing), t, ck, mode="merge", keys=["Id"])
    assert sorted(tuple(r) for r in spark.table(t).collect()) == [("1", "a"), ("2", "B"), ("3", "c")]


def _landed(tmp_path, *texts):
    landing = tmp_path / "landing"
    landing.mkdir(exist_ok=True)
    for i, text in enumerate(texts):
        (landing / f"{i}.csv").write_text(text)
    return str(landing)


def test_streamed_and_batch_appends_add_up(spark, tmp_path):
    from medallion.sinks.writers import insert_table
    t = f"{unique_name('silver')}.s"
    spark.sql(f"CREATE DATABASE {t.split('.')[0]}")
    ck = str(tmp_path / "ck")
    stream_ingest(spark, _landed(tmp_path, "Id,Val\n1,a\n2,b\n3,c\n"), t, ck)
    insert_table(spark.createDataFrame([("4", "d"), ("5", "e")], "Id string, Val string"), t)
    assert spark.table(t).count() == 5
    (tmp_path / "landing" / "later.csv").write_text("Id,Val\n6,f\n")
    stream_ingest(spark, str(tmp_path / "landing"), t, ck)
    assert sorted(r.Id for r in spark.table(t).collect()) == ["1", "2", "3", "4", "5", "6"]


def test_replayed_append_counts_once(spark, tmp_path):
    from medallion.streaming.landing import append_once, create_streamed
    t = f"{unique_name('silver')}.s"
    spark.sql(f"CREATE DATABASE {t.split('.')[0]}")
    create_streamed(spark.createDataFrame([(0, None)], "k int, v string"), t)
    for batch, rows in ((1, [(1, "a"), (None, "b")]), (1, [(1, "a"), (None, "b")]), (11, [(2, "c")])):
        append_once(spark.createDataFrame(rows, "k int, v string"), batch, t, "s1")
    assert sorted((tuple(r) for r in streamed_rows(spark, t).collect()), key=repr) == sorted(
        [(0, None), (1, "a"), (None, "b"), (2, "c")], key=repr)


def test_merge_stream_refuses_rows_that_cannot_match(spark, tmp_path):
    import pytest
    t = f"{unique_name('silver')}.s"
    spark.sql(f"CREATE DATABASE {t.split('.')[0]}")
    with pytest.raises(Exception, match="inserted again"):
        stream_ingest(spark, _landed(tmp_path, "Id,Val\n,a\n2,b\n"), t, str(tmp_path / "ck"), mode="merge",
                      keys=["Id"])
    assert not spark.catalog.tableExists(t)


def test_a_streamed_append_needs_its_layout(spark, db):
    import pytest

    from medallion.streaming.landing import append_once
    spark.createDataFrame([(0, None)], "k int, v string").write.saveAsTable(f"{db}.plain")
    with pytest.raises(ValueError, match="create_streamed"):
        append_once(spark.createDataFrame([(1, "a")], "k int, v string"), 1, f"{db}.plain", "s1")


def test_replay_after_a_batch_append(spark, db):
    """Stream, batch, replay of the stream: nothing lost, nothing twice; a
    replay with fewer rows leaves none of the first try."""
    from medallion.sinks.writers import insert_table
    from medallion.streaming.landing import append_once, create_streamed
    t, schema = f"{db}.s", "k int, v string"
    create_streamed(spark.createDataFrame([], schema), t)
    append_once(spark.createDataFrame([(1, "a"), (2, "b")], schema), 0, t, "s1")
    append_once(spark.createDataFrame([(3, "c")], schema), 0, t, "s2")      # another stream's batch 0
    insert_table(spark.createDataFrame([(9, "z")], schema), t)
    append_once(spark.createDataFrame([(1, "a")], schema), 0, t, "s1")
    assert sorted(r.k for r in streamed_rows(spark, t).collect()) == [1, 3, 9]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_lost_checkpoint_replays_into_the_same_partitions(spark, tmp_path, db):
    """The checkpoint's folder decides the stream's name: begun anew there,
    the stream brings its files in again over themselves."""
    import shutil
    t, ck = f"{db}.s", str(tmp_path / "ck")
    landing = _landed(tmp_path, "Id,Val\n1,a\n2,b\n")
    stream_ingest(spark, landing, t, ck)
    shutil.rmtree(ck)
    stream_ingest(spark, landing, t, ck)
    assert sorted(r.Id for r in streamed_rows(spark, t).collect()) == ["1", "2"]
