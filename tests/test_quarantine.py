"""Corrupt CSV records apart (S1, S10, W2), and the incremental bronze."""

import pytest

from medallion.plans.ingest import ingest
from medallion.session import unique_name
from medallion.sources import readers as Rd

GOOD = ["1,a,x", '2,"b, c",', "3,,z"]
BAD = ["4,too,many,cells", "5,few", "  only one  ", '6,"quoted, yes",x,y,z', "ü,naïve"]


def config(root, silver, **more):
    return {"landing": {"path": f"{root}/landing", "read_options": {"header": "true", "inferSchema": "true"}},
            "bronze": {"path": f"{root}/bronze"}, "silver": {"db": silver}, "audit": {"db": silver, "table": "audit"},
            **more}


def land(tmp_path, name, lines, header="k,v,w"):
    (tmp_path / "landing").mkdir(exist_ok=True)
    (tmp_path / "landing" / name).write_text("\n".join([header, *lines]) + "\n")


def audit_of(df):
    return {r.file_name: r for r in df.collect()}


def test_bad_lines_are_kept_word_for_word(spark, tmp_path):
    lines = [x for pair in zip(GOOD + GOOD, BAD) for x in pair] + GOOD
    land(tmp_path, "r.csv", lines)
    land(tmp_path, "clean.csv", GOOD)
    silver = unique_name("silver")
    rows = audit_of(ingest(spark, config(tmp_path, silver)))
    assert (rows["r.csv"].rows_written, rows["r.csv"].rows_rejected) == (len(lines) - len(BAD), len(BAD))
    assert (rows["clean.csv"].rows_written, rows["clean.csv"].rows_rejected) == (3, 0)
    assert spark.table(f"{silver}.r").count() == len(lines) - len(BAD)
    assert dict(spark.table(f"{silver}.r").dtypes)["k"] == "int"        # types of the good rows
    kept = spark.table(f"{silver}.ingestion_quarantine")
    assert sorted((r.file_name, r.line) for r in kept.collect()) == sorted(("r.csv", x) for x in BAD)


def test_quarantine_follows_the_file(spark, tmp_path):
    silver = unique_name("silver")
    cfg = config(tmp_path, silver, quarantine={"db": silver, "table": "bad"})
    land(tmp_path, "a.csv", [*GOOD, "1,2"])
    land(tmp_path, "b.csv", [*GOOD, "7,8", "9"])
    for _ in range(2):                                      # loading again does not add them up
        ingest(spark, cfg)
    assert sorted(r.line for r in spark.table(f"{silver}.bad").collect()) == ["1,2", "7,8", "9"]
    land(tmp_path, "a.csv", [*GOOD, "1,2,3"])               # mended
    (tmp_path / "landing" / "b.csv").unlink()               # gone
    assert audit_of(ingest(spark, cfg))["a.csv"].rows_rejected == 0
    assert spark.table(f"{silver}.bad").count() == 0 and spark.table(f"{silver}.a").count() == 4


def test_bad_lines_can_be_an_error(spark, tmp_path):
    land(tmp_path, "r.csv", [*GOOD, "1"])
    with pytest.raises(Exception, match="(?i)malformed"):
        ingest(spark, config(tmp_path, unique_name("silver"), bad_lines="fail"))
    with pytest.raises(ValueError, match="bad lines"):
        Rd.copy_to_bronze(spark, str(tmp_path / "landing"), str(tmp_path / "out"), bad_lines="drop")


def test_records_over_several_lines(spark, tmp_path):
    (tmp_path / "m.csv").write_text('k,v\n1,"two\nlines"\n2\n3,"x"\n4,"a\nb",c\n')
    n = Rd.copy_to_bronze(spark, str(tmp_path / "m.csv"), str(tmp_path / "out"), "csv",
                          {"header": "true", "multiLine": "true"}, bad_lines="quarantine")
    got = spark.read.options(**Rd.bronze_read_options({"header": "true", "multiLine": "true"})).csv(str(tmp_path / "out"))
    assert n == 2 and sorted(map(tuple, got.collect())) == [("1", "two\nlines"), ("3", "x")]
    assert sorted(r.line for r in Rd.rejected_lines(spark, str(tmp_path / "out")).collect()) == ["2", '4,"a\nb",c']


def test_audit_table_of_before_gains_the_columns(spark, tmp_path):
    from medallion.plans.ingest import AUDIT_SCHEMA
    silver = unique_name("silver")
    spark.sql(f"CREATE DATABASE {silver}")
    old = [f for f in AUDIT_SCHEMA if f.name not in ("rows_rejected", "bronze_copied")]
    spark.sql(f"CREATE TABLE {silver}.audit (" + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in old) +
              ", seconds bigint) USING parquet")
    land(tmp_path, "a.csv", GOOD)
    ingest(spark, config(tmp_path, silver))
    assert [(r.rows_written, r.rows_rejected, r.bronze_copied) for r in spark.table(f"{silver}.audit").collect()] == \
        [(3, 0, True)]


# ---------------------------------------------------------------- increments

def copies(spark, cfg, monkeypatch):
    """The names that a run copies to bronze, and its audit."""
    import medallion.plans.ingest as I
    made, right = [], Rd.copy_to_bronze

    def noted(spark, src, dst, *a, **k):
        made.append(dst.rsplit("/", 1)[1])
        return right(spark, src, dst, *a, **k)

    monkeypatch.setattr(I, "copy_to_bronze", noted)
    audit = audit_of(ingest(spark, cfg))
    assert {n for n, r in audit.items() if r.bronze_copied} == set(made)
    return sorted(made)


def test_only_changed_files_are_copied(spark, tmp_path, monkeypatch):
    silver = unique_name("silver")
    cfg = config(tmp_path, silver)
    for name in ("a.csv", "b.csv", "c.csv"):
        land(tmp_path, name, GOOD)
    assert copies(spark, cfg, monkeypatch) == ["a.csv", "b.csv", "c.csv"]
    assert copies(spark, cfg, monkeypatch) == []
    assert spark.table(f"{silver}.a").count() == 3 and spark.table(f"{silver}.audit").count() == 6
    land(tmp_path, "b.csv", [*GOOD, "4,d,w"])                       # changed
    (tmp_path / "landing" / "c.csv").unlink()                       # gone
    land(tmp_path, "d.csv", GOOD)                                   # new
    assert copies(spark, cfg, monkeypatch) == ["b.csv", "d.csv"]
    assert sorted(p.name for p in (tmp_path / "bronze").iterdir()) == ["a.csv", "b.csv", "d.csv"]
    assert spark.table(f"{silver}.b").count() == 4
    # other options, a lost copy, and a full refresh are copied again
    semi = {**cfg, "bronze_silver_mapping": {"a.csv": {"read_options": {"header": "true", "inferSchema": "true", "nullValue": "-"}}}}
    assert "a.csv" in copies(spark, semi, monkeypatch)
    copies(spark, cfg, monkeypatch)
    import shutil
    shutil.rmtree(tmp_path / "bronze" / "d.csv")
    assert copies(spark, cfg, monkeypatch) == ["d.csv"]
    assert copies(spark, {**cfg, "full_refresh": True}, monkeypatch) == ["a.csv", "b.csv", "d.csv"]
    assert spark.read.parquet(f"{cfg['bronze']['path']}.manifest").select("file_name").distinct().count() == 3


def test_a_broken_copy_is_made_again(spark, tmp_path, monkeypatch):
    cfg = config(tmp_path, unique_name("silver"))
    land(tmp_path, "a.csv", GOOD)
    land(tmp_path, "b.csv", GOOD)
    ingest(spark, cfg)
    land(tmp_path, "b.csv", [*GOOD, "4,d,w"])
    import medallion.plans.ingest as I

    def broken(*a, **k):
        raise OSError("injected")
    monkeypatch.setattr(I, "copy_to_bronze", broken)
    with pytest.raises(OSError, match="injected"):
        ingest(spark, cfg)
    monkeypatch.undo()
    assert copies(spark, cfg, monkeypatch) == ["b.csv"]


def test_a_folder_of_files_is_one_entry(spark, tmp_path, monkeypatch):
    cfg = config(tmp_path, silver := unique_name("silver"))
    (tmp_path / "landing" / "part.csv").mkdir(parents=True)
    for i in range(3):
        (tmp_path / "landing" / "part.csv" / f"{i}.csv").write_text("k,v\n1,2\n")
    assert copies(spark, cfg, monkeypatch) == ["part.csv"] and copies(spark, cfg, monkeypatch) == []
    (tmp_path / "landing" / "part.csv" / "1.csv").unlink()
    assert copies(spark, cfg, monkeypatch) == ["part.csv"] and spark.table(f"{silver}.part").count() == 2
