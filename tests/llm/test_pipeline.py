"""The corpus pipeline, stage by stage, against plain versions."""

import hashlib

import pytest

import corpus_pipeline as C
from medallion.llm.common import staged
from tests.llm.conftest import CLASHING, by_key, prose, rows_of
from tests.llm.test_decontaminate import plain as best_window
from tests.llm.test_line_dedup import expected as line_expected
from tests.llm.test_simhash_tiles import expected as simhash_expected

LINE = "a line that repeats in very many of these documents, over and over"
ITEM = prose(77, 30)


def corpus():
    rows = [(i, prose(i, 30) + (f"\n{LINE}" if i % 2 else "")) for i in range(40)]
    rows += [(100 + i, prose(200 + i, 20) + " moron scum " * 3) for i in range(12)]
    rows += [(200 + i, prose(5, 30)) for i in range(3)]                       # copies of document 5, less its line
    rows += [(300, f"{prose(8, 20)} {ITEM} {prose(9, 9)}"), (301, ITEM)]
    return rows + [(400, None), (401, ""), (None, prose(400, 20)), (403, prose(401, 20)), (403, prose(401, 20))]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"{c} string" for c in CLASHING)
    spark.createDataFrame([(i, t, "en", None, len(t or ""), *["?"] * len(CLASHING)) for i, t in corpus()],
                          schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= (i or 0) < 200)) for i, _ in corpus()],
                          "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def id_texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_one_by_one(spark, tables):
    assert [n for n, _ in C.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination",
                                        "byte_level_bpe"]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    outputs = []
    for name, stage in C.STAGES:
        docs = staged(stage(spark, docs, tables), f"test-{name}")
        outputs.append(docs)
    clean, lines, single, fair, tokens = outputs
    assert all(df.columns == columns for df in outputs[:4])

    # toxic documents go, no other does
    assert by_key(id_texts(clean)) == by_key([(i, t) for i, t in corpus() if not 100 <= (i or 0) < 200])
    # repeated lines stay in one document; n_chars follows; other columns stay
    assert by_key(id_texts(lines)) == by_key([r[:2] for r in line_expected(id_texts(clean))])
    assert all(r["n_chars"] == len(r["text"]) and r["hash"] == "?" and r["lang"] == "en" for r in lines.collect())
    # one row of each group of near copies stays, the one that names it
    kept = {(i, t) for (i, t), (_, _, c) in zip(id_texts(lines), simhash_expected(id_texts(lines)))
            if i is None or i == c}
    assert by_key(id_texts(single)) == by_key(kept)
    assert not {i for i, _ in id_texts(single)} & {200, 201, 202}
    # documents with a benchmark item go
    assert by_key(id_texts(fair)) == by_key([(i, t) for i, t in id_texts(single) if best_window(t, ITEM) < 0.8])
    assert {300, 301} & {i for i, _ in id_texts(single)} and not {300, 301} & {i for i, _ in id_texts(fair)}
    # whole texts come back from the ids
    got = [(r["doc_id"], r["decoded_sha256"]) for r in tokens.collect()]
    assert by_key(got) == by_key([(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in id_texts(fair)])
    assert all(r["n_tokens"] == len(r["ids"]) for r in tokens.collect())


def test_run_is_the_stages_in_a_row(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in C.STAGES:
        docs = staged(stage(spark, docs, tables), f"test-{name}")
    assert by_key(rows_of(C.run(spark, tables))) == by_key(rows_of(docs))


def test_empty_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, tables)
    assert rows_of(docs) == []
