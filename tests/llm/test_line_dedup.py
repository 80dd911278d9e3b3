"""Line dedup against a plain version in Python."""

import pytest

from medallion.llm import line_dedup as L
from tests.llm.conftest import CLASHING, EDGE_ROWS, by_key, rows_of

SPACES = " \t\n\x0b\x0c\r"
LONG = "this line is certainly longer than forty code points"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(SPACES).translate(LOWER)


def expected(rows, min_chars=40, min_docs=5):
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or
                i == max((h for h in holders[key(x)] if h is not None), default=None)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def line_rows():
    rows = [(i, f"own line of document {i}\n  {LONG.upper()}\t\nshort\n{LONG}\r") for i in range(6)]
    rows += [(5, f"{LONG} \nsecond row of document five"), (None, f"a null id\n{LONG}")]
    rows += [(20 + i, f"four documents only hold this one, which is long enough\n{i}") for i in range(4)]
    rows += [(30 + i, "É" + "x" * 38 + f"\n{'É' * 40}\n\n") for i in range(5)]      # 39 and 40 code points
    rows += [(40 + i, f" {LONG}\n {LONG}") for i in range(5)]             # not stripped: a key of its own
    return rows + EDGE_ROWS


@pytest.fixture(scope="module")
def docs(spark):
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(i, t, *["?"] * len(CLASHING)) for i, t in line_rows()], schema).repartition(4)


@pytest.mark.parametrize("min_chars, min_docs", [(40, 5), (1, 2), (1, 1)])
def test_against_plain_python(docs, min_chars, min_docs):
    got = rows_of(L.dedup_lines(docs, min_chars=min_chars, min_docs=min_docs))
    assert by_key(got) == by_key(expected(line_rows(), min_chars, min_docs))


def test_carried_columns(docs):
    found = L.dedup_lines(docs, carry=True)
    assert set(found.schema["row"].dataType.names) == {"doc_id", *CLASHING}
    assert {r["row"]["hash"] for r in found.collect()} == {"?"}


def test_empty_table(no_docs):
    assert rows_of(L.dedup_lines(no_docs)) == []


def test_rows_without_an_id_may_stand_apart(spark):
    rows = [(None, f"{i}\n{LONG}") for i in range(6)] + [(None, f"0\n{LONG}")] + [(None, f"{LONG} x\n{i}") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    together, apart = (L.dedup_lines(df, null_rows_apart=x).collect() for x in (False, True))
    assert all(r["n_dropped"] == 0 for r in together)               # one document holds them all
    left = [r["text"] for r in apart if r["text"].endswith(LONG)]
    assert len(set(left)) == 1 and sum(r["n_dropped"] for r in apart) == 7 - len(left)
    mixed = L.dedup_lines(df.union(spark.createDataFrame([(3, LONG)], df.schema)), null_rows_apart=True).collect()
    assert [r["doc_id"] for r in mixed if LONG in r["text"].split("\n")] == [3]      # an id goes before none


def test_time_grows_with_the_lines(spark):
    """A third of the rows without an id, one text of 100,000 repeated lines
    and one of 10 MB: results by counting."""
    import time
    many = [f"{LONG} number {i}" for i in range(2000)]
    rows = [(None if i % 3 == 0 else i, "\n".join(many[(i * 7) % 1900:(i * 7) % 1900 + 60])) for i in range(900)]
    rows += [(5000 + i, "\n".join(many)) for i in range(5)]
    rows += [(4000, "\n".join(many * 50)), (4001, "\n".join(f"{LONG} own {i}" for i in range(160_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    started = time.time()
    found = {r["doc_id"]: r for r in L.dedup_lines(df).where("doc_id >= 4000").select(
        "doc_id", "n_lines", "n_dropped").collect()}
    assert time.time() - started < 60
    assert (found[4000]["n_lines"], found[4000]["n_dropped"]) == (100_000, 100_000)
    assert found[4001]["n_dropped"] == 0 and [found[5000 + i]["n_dropped"] for i in range(5)] == [2000] * 4 + [0]
