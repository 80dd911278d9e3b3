import pytest

from medallion.plans.ingest import ingest, resolve_settings
from medallion.session import unique_name


def test_precedence_weakest_first():                            # W1
    cfg = {"landing": {"file_format": "csv", "read_options": {"header": "true"}},
           "bronze": {"format": "json", "write_command": "insert into"},
           "silver": {"table_format": "orc"},
           "bronze_silver_mapping": {"a.csv": {"table_name": "A", "file_format": "csv",
                                               "read_options": {"sep": ";"}}}}
    s = resolve_settings(cfg, "a.csv")
    assert (s.source_format, s.read_options, s.table_format, s.write_command, s.table_name) == \
        ("csv", {"sep": ";"}, "orc", "insert into", "A")
    u = resolve_settings(cfg, "b.data.csv")                     # unmapped file (D8)
    assert (u.source_format, u.read_options, u.table_name) == ("json", {"header": "true"}, "b")
    bare = resolve_settings({}, "c.csv")
    assert (bare.source_format, bare.table_format, bare.write_command) == \
        ("csv", "parquet", "insert overwrite")


def _cfg(root, silver, **per_file):
    return {"landing": {"path": f"{root}/landing",
                        "read_options": {"header": "true", "inferSchema": "true"}},
            "bronze": {"path": f"{root}/bronze"},
            "silver": {"db": silver},
            "bronze_silver_mapping": per_file,
            "audit": {"db": silver, "table": "audit"}}


def test_ingest_end_to_end_with_audit(spark, tmp_path):         # W1, W2, S10
    root = str(tmp_path)
    (tmp_path / "landing").mkdir()
    (tmp_path / "landing" / "Wards.csv").write_text(
        "City,Slum Population - Total,Rate (%)\nPune,10,1.5\nAgra,NA,2\n")
    (tmp_path / "landing" / "water.csv").write_text("a b,c\n1,2\n")
    silver = unique_name("silver")
    audit = ingest(spark, _cfg(root, silver, **{"Wards.csv": {"table_name": "wards"}}))
    assert spark.table(f"{silver}.wards").columns == ["City", "SlumPopulation_Total", "Rate%"]
    assert spark.table(f"{silver}.water").collect()[0].asDict() == {"ab": 1, "c": 2}
    rec = {r.file_name: r for r in audit.collect()}
    assert set(rec) == {"Wards.csv", "water.csv"}
    assert rec["Wards.csv"].rows_written == 2 and rec["Wards.csv"].seconds >= 0
    assert rec["Wards.csv"].end_time >= rec["Wards.csv"].start_time
    # a second run overwrites silver and appends to the audit table
    ingest(spark, _cfg(root, silver, **{"Wards.csv": {"table_name": "wards"}}))
    assert spark.table(f"{silver}.wards").count() == 2
    assert spark.table(f"{silver}.audit").count() == 4
    # bronze mirrors landing: a file gone from landing leaves bronze too
    (tmp_path / "landing" / "water.csv").unlink()
    ingest(spark, _cfg(root, silver, **{"Wards.csv": {"table_name": "wards"}}))
    assert sorted(p.name for p in (tmp_path / "bronze").iterdir()) == ["Wards.csv"]


def test_merge_without_keys_raises(spark, tmp_path):            # D7
    (tmp_path / "landing").mkdir()
    (tmp_path / "landing" / "x.csv").write_text("k,v\n1,2\n")
    cfg = _cfg(str(tmp_path), unique_name("silver"), **{"x.csv": {"write_command": "merge"}})
    with pytest.raises(ValueError, match="merge_cols"):
        ingest(spark, cfg)


def test_merge_with_keys_upserts(spark, tmp_path):
    (tmp_path / "landing").mkdir()
    f = tmp_path / "landing" / "x.csv"
    f.write_text("k,v\n1,2\n2,3\n")
    silver = unique_name("silver")
    cfg = _cfg(str(tmp_path), silver, **{"x.csv": {"write_command": "merge", "merge_cols": ["k"]}})
    ingest(spark, cfg)
    f.write_text("k,v\n2,30\n3,4\n")
    ingest(spark, cfg)
    assert sorted(tuple(r) for r in spark.table(f"{silver}.x").collect()) == \
        [(1, 2), (2, 30), (3, 4)]


def test_command_line_entry(spark, tmp_path, capsys):
    import json as js

    from medallion.__main__ import main
    (tmp_path / "landing").mkdir()
    (tmp_path / "landing" / "w.csv").write_text("a b,c\n1,2\n3,4\n")
    cfg = {**_cfg(str(tmp_path), unique_name("silver")), "jobs": {}}
    p = tmp_path / "cfg.json"
    p.write_text(js.dumps(cfg))
    assert main([str(p)], spark=spark) == 0
    rows = [js.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]
    assert [r["file_name"] for r in rows] == ["w.csv"] and rows[0]["rows_written"] == 2


def test_declared_schema_skips_inference(spark, tmp_path):
    (tmp_path / "landing").mkdir()
    (tmp_path / "landing" / "x.csv").write_text("k,v\n1,2.5\n")
    silver = unique_name("silver")
    cfg = _cfg(str(tmp_path), silver, **{"x.csv": {"schema": "k STRING, v DOUBLE"}})
    ingest(spark, cfg)
    assert spark.table(f"{silver}.x").dtypes == [("k", "string"), ("v", "double")]


def test_json_and_csv_landing_files(spark, tmp_path):             # S10 per format
    (tmp_path / "landing").mkdir()
    (tmp_path / "landing" / "a.csv").write_text("k,v\n1,2\n")
    (tmp_path / "landing" / "b.json").write_text('{"k": 1, "Nested Obj": {"x": 2}}\n{"k": 3}\n')
    silver = unique_name("silver")
    cfg = _cfg(str(tmp_path), silver, **{"b.json": {"file_format": "json", "read_options": {}}})
    ingest(spark, cfg)
    b = spark.table(f"{silver}.b")
    assert b.columns == ["NestedObj", "k"] and b.count() == 2
    assert spark.table(f"{silver}.a").count() == 1


def test_options_as_quoted_text():
    cfg = {"landing": {"read_options": "{'header':'true','delimiter':',','inferSchema':'true'}"}}
    assert resolve_settings(cfg, "a.csv").read_options == {
        "header": "true", "delimiter": ",", "inferSchema": "true"}


def test_original_config_layout(spark, tmp_path):
    """The original JSON layout: layers under 'ingestion', options as text."""
    (tmp_path / "landing").mkdir()
    (tmp_path / "landing" / "rivers.csv").write_text("River Name;Level (m)\nTapti;3\n")
    silver = unique_name("silver")
    # key names of the layout are fixed; every value is this test's own
    cfg = {"temp_log_file_path": str(tmp_path),
           "ingestion": {
               "landing": {"read_options": "{'header':'true','delimiter':';','inferSchema':'true'}",
                           "file_format": "csv", "path": str(tmp_path / "landing")},
               "bronze": {"format": "csv", "path": str(tmp_path / "bronze"), "write_command": "insert into"},
               "silver": {"db": silver, "table_format": "parquet"},
               "bronze_silver_mapping": {"rivers.csv": {"table_name": "River_Levels"}}}}
    ingest(spark, cfg)
    assert spark.table(f"{silver}.river_levels").collect()[0].asDict() == {"RiverName": "Tapti", "Levelm": 3}


RAGGED = "a,b\n1,2\n3,4,5\n"
CASES = {                      # text of a file, its options, the cells it holds
    "semicolon": ("a;b\n1,5;2\n", {"header": "true", "sep": ";"}, [("1,5", "2")]),
    "padded": ("a,b\n ' x ' , y \n", {"header": "true"}, [(" ' x ' ", " y ")]),
    "lines": ('a,b\n"one\ntwo",3\n', {"header": "true", "multiLine": "true"}, [("one\ntwo", "3")]),
    "quotes": ('a,b\n"say ""hi""",\n"",x\n', {"header": "true", "escape": '"'},
               [('say "hi"', None), (None, "x")]),
    "empty": ('a,b\n"",x\n,y\nNA,z\n', {"header": "true", "nullValue": "NA"}, [("", "x"), (None, "y"), (None, "z")]),
    "backslash": ('a,b\n"say \\"hi\\"",2\n', {"header": "true"}, [('say "hi"', "2")]),
    "marks": ("a,b\nNA,2020-01-01\n", {"header": "true", "nullValue": "NA"}, [(None, "2020-01-01")]),
}


@pytest.mark.parametrize("case", CASES)
def test_bronze_keeps_every_cell(spark, tmp_path, case):         # S10
    from medallion.sources import readers as Rd
    text, options, cells = CASES[case]
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.csv").write_text(text)
    Rd.copy_to_bronze(spark, str(tmp_path / "in"), str(tmp_path / "out"), "csv", options)
    got = spark.read.options(**Rd.bronze_read_options(options)).csv(str(tmp_path / "out"))
    raw = spark.read.options(**options).csv(str(tmp_path / "in"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, raw.collect()), key=repr) == sorted(
        cells * 3, key=repr)


def test_bronze_of_a_headerless_file_in_parts(spark, tmp_path):
    from medallion.sources import readers as Rd
    (tmp_path / "n.csv").write_text("".join(f"{i},v{i}\n" for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        Rd.copy_to_bronze(spark, str(tmp_path / "n.csv"), str(tmp_path / "out"), "csv", {})
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = spark.read.options(**Rd.bronze_read_options({})).csv(str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("part-*"))) > 1
    assert sorted(int(r[0]) for r in got.collect()) == list(range(2000))


def test_bronze_refuses_ragged_lines(spark, tmp_path):
    from medallion.sources import readers as Rd
    (tmp_path / "r.csv").write_text(RAGGED)
    with pytest.raises(Exception, match="(?i)malformed"):
        Rd.copy_to_bronze(spark, str(tmp_path / "r.csv"), str(tmp_path / "out"), "csv", {"header": "true"})


def test_audit_counts_what_a_load_wrote(spark, tmp_path):        # W2
    (tmp_path / "landing").mkdir()
    (tmp_path / "landing" / "x.csv").write_text("k;v\n1;2\n2;3\n")
    silver = unique_name("silver")
    cfg = _cfg(str(tmp_path), silver, **{"x.csv": {"write_command": "insert into", "read_options": {
        "header": "true", "sep": ";"}}})
    for _ in range(3):
        audit = ingest(spark, cfg)
    assert [r.rows_written for r in audit.collect()] == [2] and spark.table(f"{silver}.x").count() == 6
