import json

import pytest

from medallion.sources import json_docs as J
from medallion.sources import readers as Rd
from tests.conftest import SF


def test_csv_scan_infers_types(spark, tmp_path):                # S1
    p = tmp_path / "wards.csv"
    p.write_text("City,Slum Population - Total,Rate\nPune,10,1.5\nAgra,NA,2\n")
    df = Rd.read_csv(spark, str(p))
    assert dict(df.dtypes) == {"City": "string", "Slum Population - Total": "string",
                               "Rate": "double"}


def test_format_from_extension():                               # S6
    assert Rd.format_from_extension("/x/y/data.csv") == "csv"
    assert Rd.format_from_extension("/x/y/data.json.gz") == "json"
    with pytest.raises(ValueError):
        Rd.format_from_extension("/x/noext")


def test_read_by_extension_all_text(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("x,y\n1,2\n")
    assert Rd.read_by_extension(spark, str(p)).dtypes == [("x", "string"), ("y", "string")]


def test_csv_dir_merges_semicolon_files(spark, tmp_path):       # S7
    d = tmp_path / "parts"
    d.mkdir()
    (d / "a.csv").write_text("k;v\n1;x\n")
    (d / "b.csv").write_text("k;v\n2;y\n")
    rows = sorted(tuple(r) for r in Rd.read_csv_dir(spark, str(d)).collect())
    assert rows == [(1, "x"), (2, "y")]


def test_table_and_path_reads_agree(spark, db):                 # S2 vs S3 / S4
    src = spark.read.parquet(f"{SF}/nation.parquet")
    src.write.saveAsTable(f"{db}.nation")
    by_table = Rd.read_source(spark, "table", table="nation", schema=db)
    by_query = Rd.read_source(spark, "table", table="ignored", query=f"SELECT * FROM {db}.nation")
    by_path = Rd.read_source(spark, "parquet", path=f"{SF}/nation.parquet")
    a, b, c = (sorted(tuple(r) for r in d.collect()) for d in (by_table, by_query, by_path))
    assert a == b == c


def test_json_records_flatten_normalise_select(spark, tmp_path):  # S8, P3-P5
    doc = {"count": 2, "entries": [
        {"API": "a", "Description ": "d1", "Auth": {"Kind": "key"}, "Catégorie": "c1"},
        {"API": "b", "Description ": "d2", "Auth": {"Kind": None}, "Catégorie": "c2"}]}
    p = tmp_path / "api.json"
    p.write_text(json.dumps(doc, ensure_ascii=False, indent=2))
    df = J.read_json_records(spark, str(p), key="entries",
                             fields=["api", "description", "authkind", "categorie"],
                             multi_line=True)
    assert sorted(df.columns) == ["api", "authkind", "categorie", "description"]
    rows = sorted(tuple(r[c] for c in ("api", "authkind", "categorie")) for r in df.collect())
    assert rows == [("a", "key", "c1"), ("b", None, "c2")]


def test_json_no_allowed_field_raises(spark, tmp_path):         # D21
    p = tmp_path / "d.json"
    p.write_text(json.dumps({"entries": [{"x": 1}]}))
    with pytest.raises(ValueError, match="available"):
        J.read_json_records(spark, str(p), key="entries", fields=["api"])


def test_list_files_and_bronze_refresh(spark, tmp_path):        # S9, S10
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "w.csv").write_text('name,note\n"a","say ""hi"""\nb,\n')
    out = Rd.refresh_bronze(spark, str(landing), str(tmp_path / "bronze"), ["w.csv"],
                            {"w.csv": {"header": "true", "escape": '"'}})
    back = spark.read.options(**Rd.bronze_read_options({"header": "true"})).csv(out["w.csv"])
    assert back.columns == ["name", "note"]
    assert sorted((r.name, r.note) for r in back.collect()) == [("a", 'say "hi"'), ("b", None)]
    files = Rd.list_files(spark, str(landing)).collect()
    assert [f.name for f in files] == ["w.csv"] and files[0].size_bytes > 0


def test_flatten_keeps_arrays_and_separator(spark):
    df = spark.createDataFrame(
        [((1, (2, "x")), [1, 2])],
        "a struct<b:int, c:struct<d:int, e:string>>, tags array<int>")
    flat = J.flatten(df)
    assert flat.columns == ["a_b", "a_c_d", "a_c_e", "tags"]
    assert dict(flat.dtypes)["tags"] == "array<int>"
    assert J.flatten(df, ".").columns == ["a.b", "a.c.d", "a.c.e", "tags"]


def test_json_records_with_declared_schema(spark, tmp_path):
    p = tmp_path / "d.json"
    p.write_text(json.dumps({"entries": [{"API": "a", "City": "x", "extra": 1}]}) + "\n")
    df = J.read_json_records(spark, str(p), "entries", ["api", "city"],
                             schema="entries array<struct<API:string, City:string>>")
    assert sorted(df.columns) == ["api", "city"] and df.count() == 1


def test_csv_dir_infers_dates(spark, tmp_path):
    d = tmp_path / "dated"
    d.mkdir()
    (d / "a.csv").write_text("k;day\n1;2020-01-01\n")
    (d / "b.csv").write_text("k;day\n2;2021-12-31\n")
    assert dict(Rd.read_csv_dir(spark, str(d)).dtypes) == {"k": "int", "day": "date"}
