import pytest
from pyspark.sql import functions as F

from medallion.sinks import upsert as U
from medallion.sinks import writers as W

BASE = [(1, "a", 10.0), (2, "a", 20.0), (3, "b", 30.0), (None, "b", 40.0), (5, "c", 50.0)]
SCHEMA = "k int, p string, v double"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (str(r[0]), str(r[1]), r[2]))


def test_upsert_keys_update_insert_and_nulls(spark, db):        # K7, J2
    t = f"{db}.u"
    W.insert_table(spark.createDataFrame(BASE, SCHEMA), t)
    upd = spark.createDataFrame([(2, "a", 21.0), (7, "c", 70.0), (None, "b", 41.0)], SCHEMA)
    U.upsert(upd, "k", table=t)
    got = rows(spark.table(t))
    assert got == rows(spark.createDataFrame(
        [(1, "a", 10.0), (2, "a", 21.0), (3, "b", 30.0), (None, "b", 40.0), (5, "c", 50.0),
         (7, "c", 70.0), (None, "b", 41.0)], SCHEMA))


def test_upsert_is_idempotent_and_keys_are_union(spark, db):    # property
    t = f"{db}.u"
    W.insert_table(spark.createDataFrame(BASE, SCHEMA), t)
    upd = spark.createDataFrame([(3, "b", 33.0), (8, "a", 80.0)], SCHEMA)
    U.upsert(upd, "k", table=t)
    once = rows(spark.table(t))
    U.upsert(upd, "k", table=t)
    assert rows(spark.table(t)) == once
    keys = {r[0] for r in once if r[0] is not None}
    assert keys == {1, 2, 3, 5, 8}


def test_duplicate_update_keys(spark, db):
    t = f"{db}.u"
    W.insert_table(spark.createDataFrame(BASE, SCHEMA), t)
    dup_match = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0)], SCHEMA)
    with pytest.raises(ValueError, match="several update rows"):
        U.upsert(dup_match, "k", table=t)
    dup_new = spark.createDataFrame([(9, "a", 1.0), (9, "a", 2.0)], SCHEMA)
    U.upsert(dup_new, "k", table=t)                           # unmatched: both inserted
    assert spark.table(t).where("k = 9").count() == 2


def test_partitioned_upsert_edges(spark, db):                   # K8, D5, D18
    t = f"{db}.up"
    W.insert_table(spark.createDataFrame(BASE, SCHEMA), t, partition_by="p")
    # key 2 moves a -> b (matched: its partition a is named); key 5 lives in
    # c, which the update does not name, so it is inserted a second time
    upd = spark.createDataFrame([(2, "b", 22.0), (5, "a", 55.0), (1, "a", 11.0)], SCHEMA)
    U.upsert(upd, "k", table=t, partition_by="p")
    got = rows(spark.table(t).select("k", "p", "v"))
    want = [(1, "a", 11.0), (2, "b", 22.0), (3, "b", 30.0), (None, "b", 40.0),
            (5, "a", 55.0), (5, "c", 50.0)]
    assert got == rows(spark.createDataFrame(want, SCHEMA))


def test_multi_column_partitions_full_rewrite(spark, db):
    schema = "k int, p string, q string, v double"
    base = [(1, "a", "x", 1.0), (2, "a", "y", 2.0), (3, "b", "y", 3.0)]
    t = f"{db}.mp"
    W.insert_table(spark.createDataFrame(base, schema), t, partition_by=["p", "q"])
    # key 2 in (a, y) is matched (a and y both named) and moves to (a, x):
    # partition (a, y) must not keep a stale copy
    upd = spark.createDataFrame([(2, "a", "x", 20.0), (4, "b", "y", 4.0)], schema)
    U.upsert(upd, "k", table=t, partition_by=["p", "q"])
    got = sorted(tuple(r) for r in spark.table(t).select("k", "p", "q", "v").collect())
    assert got == [(1, "a", "x", 1.0), (2, "a", "x", 20.0), (3, "b", "y", 3.0), (4, "b", "y", 4.0)]


def test_upsert_creates_missing_targets(spark, db, tmp_path):   # K9
    upd = spark.createDataFrame(BASE, SCHEMA)
    assert U.upsert(upd, "k", table=f"{db}.fresh", partition_by="p")
    assert spark.table(f"{db}.fresh").count() == len(BASE)
    p = str(tmp_path / "fresh")
    U.upsert(upd, "k", path=p)
    U.upsert(spark.createDataFrame([(1, "a", 0.0)], SCHEMA), "k", path=p)
    got = spark.read.parquet(p).where("k = 1").collect()
    assert [r.v for r in got] == [0.0]


def test_upsert_needs_keys_and_skips_empty(spark, db):          # D7, K10
    t = f"{db}.u"
    W.insert_table(spark.createDataFrame(BASE, SCHEMA), t)
    with pytest.raises(ValueError):
        U.upsert(spark.createDataFrame(BASE, SCHEMA), "", table=t)
    assert U.upsert(spark.createDataFrame([], SCHEMA), "k", table=t) is False
    assert spark.table(t).count() == len(BASE)
    assert spark.table(t).where(F.col("k").isNull()).count() == 1


def test_null_partition_value_matches_nothing(spark, db):       # D18
    t = f"{db}.np"
    W.insert_table(spark.createDataFrame(BASE, SCHEMA), t, partition_by="p")
    upd = spark.createDataFrame([(1, None, 99.0)], SCHEMA)
    U.upsert(upd, "k", table=t, partition_by="p")
    got = {(r.k, r.p, r.v) for r in spark.table(t).where("k = 1").collect()}
    assert got == {(1, "a", 10.0), (1, None, 99.0)}


def test_null_partition_rows_survive_a_null_partition_batch(spark, db):   # D18
    t = f"{db}.np2"
    base = BASE + [(8, None, 80.0), (9, None, 90.0)]
    W.insert_table(spark.createDataFrame(base, SCHEMA), t, partition_by="p")
    upd = spark.createDataFrame([(8, None, 88.0), (2, "a", 22.0)], SCHEMA)
    U.upsert(upd, "k", table=t, partition_by="p")
    got = {(r.k, r.p, r.v) for r in spark.table(t).collect()}
    # NULL partitions never match: key 8 is inserted again, 9 stays
    assert {(8, None, 80.0), (9, None, 90.0), (8, None, 88.0), (2, "a", 22.0)} <= got
    assert (2, "a", 20.0) not in got and len(got) == len(base) + 1


def test_delta_branch_needs_delta(spark, db):
    try:
        import delta  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="delta-spark"):
            U.upsert(spark.createDataFrame(BASE, SCHEMA), "k", table=f"{db}.d", fmt="delta")
        pytest.skip("delta-spark is not installed; the native MERGE branch is not exercised")
    t = f"{db}.d"
    U.upsert(spark.createDataFrame(BASE, SCHEMA), "k", table=t, fmt="delta", partition_by="p")
    U.upsert(spark.createDataFrame([(2, "a", 21.0)], SCHEMA), "k", table=t, fmt="delta",
             partition_by="p")
    assert spark.table(t).where("k = 2").collect()[0].v == 21.0


def _model_merge(base, upd, partitioned):
    """MERGE by the rule: key equal (NULL never matches) and, when
    partitioned, the target's partition among the batch's non-NULL values;
    matched rows take the update, unmatched updates are inserted."""
    vals = {p for _, p, _ in upd if p is not None}
    upd_keys = {k for k, _, _ in upd if k is not None}
    out = []
    for k, p, v in base:
        matched = k is not None and k in upd_keys and (not partitioned or p in vals)
        if not matched:
            out.append((k, p, v))
    return sorted(out + list(upd), key=repr)


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_rows = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 6)),
                           st.one_of(st.none(), st.sampled_from(["a", "b", "c"])),
                           st.integers(0, 99).map(float)), max_size=8)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(base=_rows, upd=_rows, partitioned=st.booleans())
def test_upsert_matches_model(spark, base, upd, partitioned):
    from medallion.session import unique_name
    seen, uniq = set(), []
    for r in upd:                       # one update row per non-NULL key
        if r[0] is None or r[0] not in seen:
            uniq.append(r)
            seen.add(r[0])
    db = unique_name("h")
    spark.sql(f"CREATE DATABASE {db}")
    t = f"{db}.t"
    parts = "p" if partitioned else None
    W.insert_table(spark.createDataFrame(base, SCHEMA), t, partition_by=parts, on_empty="write")
    U.upsert(spark.createDataFrame(uniq, SCHEMA), "k", table=t, partition_by=parts)
    got = sorted((tuple(r) for r in spark.table(t).select("k", "p", "v").collect()), key=repr)
    want = _model_merge(base, uniq, partitioned) if uniq else sorted(base, key=repr)
    spark.sql(f"DROP DATABASE {db} CASCADE")
    assert got == want


_rows2 = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 5)),
                            st.one_of(st.none(), st.sampled_from(["a", "b"])),
                            st.sampled_from(["x", "y"]),
                            st.integers(0, 99).map(float)), max_size=7)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(base=_rows2, upd=_rows2)
def test_two_column_partition_upsert_matches_model(spark, base, upd):
    from medallion.session import unique_name
    schema = "k int, p string, q string, v double"
    seen, uniq = set(), []
    for r in upd:
        if r[0] is None or r[0] not in seen:
            uniq.append(r)
            seen.add(r[0])
    if not uniq:
        return
    pv = {r[1] for r in uniq if r[1] is not None}
    qv = {r[2] for r in uniq if r[2] is not None}
    keys = {r[0] for r in uniq if r[0] is not None}
    want = sorted([r for r in base if not (r[0] is not None and r[0] in keys
                                          and r[1] in pv and r[2] in qv)] + uniq, key=repr)
    db = unique_name("h2")
    spark.sql(f"CREATE DATABASE {db}")
    t = f"{db}.t"
    W.insert_table(spark.createDataFrame(base, schema), t, partition_by=["p", "q"],
                   on_empty="write")
    U.upsert(spark.createDataFrame(uniq, schema), "k", table=t, partition_by=["p", "q"])
    got = sorted((tuple(r) for r in spark.table(t).select("k", "p", "q", "v").collect()),
                 key=repr)
    spark.sql(f"DROP DATABASE {db} CASCADE")
    assert got == want


def test_predicate_column_of_an_unpartitioned_table(spark, db):
    t = f"{db}.flat"
    W.insert_table(spark.createDataFrame(BASE, SCHEMA), t)
    U.upsert(spark.createDataFrame([(1, "a", 11.0)], SCHEMA), "k", table=t, partition_by="p")
    want = [(1, "a", 11.0)] + BASE[1:]
    assert rows(spark.table(t)) == rows(spark.createDataFrame(want, SCHEMA))
    # a value of p that the batch does not name keeps its row: inserted beside it
    U.upsert(spark.createDataFrame([(5, "b", 55.0)], SCHEMA), "k", table=t, partition_by="p")
    assert rows(spark.table(t).where("k = 5")) == [(5, "b", 55.0), (5, "c", 50.0)]


def test_predicate_on_one_of_two_partition_columns(spark, db, tmp_path):
    schema = "k int, p string, q string, v double"
    base = [(1, "a", "x", 1.0), (2, "a", "y", 2.0), (3, "b", "y", 3.0), (4, None, "z w", 4.0)]
    upd = [(2, "a", "z", 20.0), (4, None, "z w", 40.0)]
    want = sorted([(1, "a", "x", 1.0), (2, "a", "z", 20.0), (3, "b", "y", 3.0), (4, None, "z w", 4.0),
                   (4, None, "z w", 40.0)], key=repr)
    t, path = f"{db}.mp1", str(tmp_path / "two")
    W.insert_table(spark.createDataFrame(base, schema), t, partition_by=["p", "q"])
    W.write_path(spark.createDataFrame(base, schema), path, partition_by=["p", "q"])
    U.upsert(spark.createDataFrame(upd, schema), "k", table=t, partition_by="p")
    U.upsert(spark.createDataFrame(upd, schema), "k", path=path, partition_by="p")
    for df in (spark.table(t), spark.read.parquet(path)):
        assert sorted((tuple(r) for r in df.select("k", "p", "q", "v").collect()), key=repr) == want
    assert not (tmp_path / "two" / "p=a" / "q=y").exists()          # left without rows
    assert {r[0] for r in spark.sql(f"SHOW PARTITIONS {t}").collect()} >= {"p=a/q=x", "p=a/q=z", "p=b/q=y"}


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "kept")
    W.write_path(spark.createDataFrame(BASE, SCHEMA), path, partition_by="p")
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "kept" / "p=c").iterdir()}
    U.upsert(spark.createDataFrame([(1, "a", 0.0)], SCHEMA), "k", path=path, partition_by="p")
    assert {f: f.stat().st_mtime_ns for f in (tmp_path / "kept" / "p=c").iterdir()} == before


def test_unreadable_folder_is_an_error_and_stays(spark, tmp_path):
    path = tmp_path / "csv"
    spark.createDataFrame(BASE, SCHEMA).write.csv(str(path))
    before = sorted(f.name for f in path.iterdir())
    with pytest.raises(Exception):
        U.upsert(spark.createDataFrame([(1, "a", 0.0)], SCHEMA), "k", path=str(path))
    assert sorted(f.name for f in path.iterdir()) == before
    assert sorted(f.name for f in tmp_path.iterdir()) == ["csv"]


@pytest.mark.parametrize("schema, row", [("k int, p string, v double, w int", (1, "a", 0.0, 1)),
                                         ("k int, p string", (1, "a"))])
def test_columns_must_match(spark, db, schema, row):
    t = f"{db}.cols"
    W.insert_table(spark.createDataFrame(BASE, SCHEMA), t)
    with pytest.raises(ValueError, match="do not match"):
        U.upsert(spark.createDataFrame([row], schema), "k", table=t)
    assert spark.table(t).count() == len(BASE)


def test_nothing_is_left_behind(spark, db, tmp_path):
    import glob

    from medallion.session import checkpoint_root
    scratch = checkpoint_root(spark).removeprefix("file:") + "/medallion-scratch/upsert*"
    left = set(glob.glob(scratch))
    t, path = f"{db}.clean", str(tmp_path / "clean")
    for _ in range(2):
        U.upsert(spark.createDataFrame(BASE, SCHEMA).dropDuplicates(["k"]), "k", table=t, partition_by="p")
        U.upsert(spark.createDataFrame(BASE, SCHEMA).dropDuplicates(["k"]), "k", path=path)
    assert set(glob.glob(scratch)) == left
    assert [f.name for f in tmp_path.iterdir()] == ["clean"]
