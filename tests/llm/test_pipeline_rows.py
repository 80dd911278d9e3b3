"""Pipeline decisions on rows without an id and on rows that share one."""

import corpus_pipeline as C
from tests.llm.conftest import prose
from tests.llm.test_pipeline import ITEM, id_texts


def test_each_row_is_judged_by_its_own_text(spark, tmp_path):
    toxic = [(100 + i, prose(200 + i, 20) + " moron scum " * 3) for i in range(12)]
    clean = [(i, prose(i, 30)) for i in range(40)]
    near = prose(600, 60)
    rows = toxic + clean + [
        (None, prose(300, 20) + " moron scum " * 3), (None, near), (None, near + " end"), (None, prose(301, 30)),
        (None, f"{prose(302, 9)} {ITEM}"), (7, prose(303, 20) + " moron scum " * 3), (8, f"{prose(304, 9)} {ITEM}"),
        (9, prose(20, 30)), (900, prose(9, 30)), (901, prose(305, 60)), (None, prose(305, 60))]
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long").repartition(
        3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i >= 100)) for i, _ in toxic + clean], "doc_id long, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    after = id_texts(C.toxicity_stage(spark, docs, folder))
    assert sorted(after, key=repr) == sorted([r for r in rows if "moron" not in r[1]], key=repr)

    left = id_texts(C.simhash_stage(spark, docs.where("NOT contains(text, 'moron')"), folder))
    assert len(left) == len(set(left))
    assert sum(t in (near, near + " end") for _, t in left) == 1            # near copies without an id
    assert [i for i, t in left if t == prose(305, 60)] == [901]             # a row with an id goes first
    assert [i for i, t in left if t == prose(20, 30)] == [9]                # of 9 and 20
    assert [i for i, t in left if t == prose(9, 30)] == [9]                 # its sister of the same id stays
    assert {t for _, t in left} >= {t for _, t in clean} | {prose(301, 30)}

    fair = id_texts(C.decontamination_stage(spark, docs, folder))
    assert sorted(fair, key=repr) == sorted([r for r in rows if ITEM not in r[1]], key=repr)
