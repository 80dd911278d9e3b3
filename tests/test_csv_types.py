"""Types from the copy's own pass, against Spark's inference."""

import random

import pytest

from medallion.plans.ingest import ingest_file, ingest
from medallion.session import unique_name
from medallion.sources import csv_types as C
from medallion.sources import readers as Rd

OPTIONS = {"header": "true", "inferSchema": "true"}
CELLS = {"int": ["0", "-5", "+7", "2147483647", "-2147483648", ""],
         "bigint": ["2147483648", "1", "-999999999999999999", ""],
         "double": ["1.5", "-.25", "+3.0", "12", "999999999999", ""],
         "boolean": ["true", "FALSE", "False", ""],
         "string": ["Pune", "naïve", "x1", "true story", "5 apples and", "NA", "T", ""],
         "open": ["2020-01-01", "1e5", " 5", "5.", "12345678901234567890", "NaN", "2020-01-01 10:00:00", "T10:30", "-", "١٢"]}


def inferred(spark, path, options=OPTIONS):
    return [t for _, t in spark.read.options(**Rd.bronze_read_options(options)).csv(path).dtypes]


def copied(spark, tmp_path, columns, options=OPTIONS, sep=","):
    (tmp_path / "in").mkdir(exist_ok=True)
    names = [f"c {i}" for i in range(len(columns))]
    text = "\n".join(sep.join(r) for r in [names, *zip(*columns)]) + "\n"
    (tmp_path / "in" / "x.csv").write_text(text)
    Rd.copy_to_bronze(spark, str(tmp_path / "in"), str(tmp_path / "out"), "csv", options, "quarantine")
    return str(tmp_path / "out")


@pytest.mark.parametrize("seed", range(6))
def test_same_types_as_inference(spark, tmp_path, seed):
    rng = random.Random(seed)
    kinds = ["int", "bigint", "double", "boolean", "string"]
    columns = [[rng.choice(CELLS[k]) for _ in range(30)] for k in kinds * 2]
    # mixtures, a column without values, and whole numbers among decimals
    columns += [[rng.choice(CELLS["int"] + CELLS["string"]) for _ in range(30)], [""] * 30,
                [rng.choice(CELLS["bigint"] + CELLS["double"]) for _ in range(30)],
                [rng.choice(CELLS["open"]) for _ in range(29)] + ["Pune"]]
    path = copied(spark, tmp_path, columns)
    ddl = C.kept(spark, path, Rd.bronze_read_options(OPTIONS))
    assert ddl is not None
    typed = spark.read.options(**Rd.bronze_read_options(OPTIONS)).schema(ddl).csv(path)
    assert [t for _, t in typed.dtypes] == inferred(spark, path)
    plain = spark.read.options(**Rd.bronze_read_options(OPTIONS)).csv(path)
    assert typed.columns == plain.columns and sorted(map(str, typed.collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("cell", CELLS["open"])
def test_what_is_open_is_left_to_inference(spark, tmp_path, cell):
    path = copied(spark, tmp_path, [["1", "2", cell], ["a", "b", "c"]])
    assert C.kept(spark, path, Rd.bronze_read_options(OPTIONS)) is None or \
        inferred(spark, path)[0] == "string"


@pytest.mark.parametrize("options", [{"header": "true"}, {**OPTIONS, "dateFormat": "dd/MM/yyyy"},
                                     {**OPTIONS, "ignoreLeadingWhiteSpace": "true"}])
def test_other_rules_are_left_to_the_reader(spark, tmp_path, options):
    path = copied(spark, tmp_path, [["1", "2"], ["a", "b"]], options)
    assert C.kept(spark, path, Rd.bronze_read_options(options)) is None


def test_null_marks(spark, tmp_path):
    options = {**OPTIONS, "nullValue": "NA", "sep": ";"}
    path = copied(spark, tmp_path, [["1", "NA", "3"], ["NA", "NA", "NA"]], options, ";")
    own = Rd.bronze_read_options(options)
    assert C.kept(spark, path, own) == "`c 0` int, `c 1` string"
    assert inferred(spark, path, options) == ["int", "string"]
    assert C.kept(spark, path, Rd.bronze_read_options(OPTIONS)) is None         # read with another mark


def jobs(spark, work):
    sc = spark.sparkContext
    name = unique_name("jobs")
    sc.setJobGroup(name, name)
    try:
        work()
    finally:
        sc.setJobGroup("", "")
    return len(sc.statusTracker().getJobIdsForGroup(name))


def test_one_scan_fewer(spark, tmp_path):
    """The same load with settled types and, the file of them gone, with
    inference: fewer jobs, the same table."""
    (tmp_path / "landing").mkdir()
    (tmp_path / "landing" / "x.csv").write_text("k,v,w\n" + "".join(f"{i},{i}.5,n{i}\n" for i in range(500)))
    silver = unique_name("silver")
    cfg = {"landing": {"path": str(tmp_path / "landing"), "read_options": OPTIONS},
           "bronze": {"path": str(tmp_path / "bronze")}, "silver": {"db": silver}}
    ingest(spark, cfg)
    path = str(tmp_path / "bronze" / "x.csv")
    types = dict(spark.table(f"{silver}.x").dtypes)
    with_types = jobs(spark, lambda: ingest_file(spark, cfg, path, "x.csv"))
    (tmp_path / "bronze" / "x.csv" / C.TYPES_FILE).unlink()
    inferring = jobs(spark, lambda: ingest_file(spark, cfg, path, "x.csv"))
    assert with_types < inferring
    assert types == dict(spark.table(f"{silver}.x").dtypes) == {"k": "int", "v": "double", "w": "string"}
    assert spark.table(f"{silver}.x").count() == 500
