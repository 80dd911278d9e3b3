"""Toxicity terms: all beyond the chance level, however strong the strongest is."""

import numpy as np

from medallion.llm import toxicity as X
from tests.llm.conftest import prose, rows_of


def test_rare_toxic_words_stay_beside_a_frequent_one(spark):
    docs = [(i, f"{prose(i, 6)} insultum", 1) for i in range(116)]
    docs += [(i, f"{prose(i, 3)} rarissimus zzz{i}", 1) for i in range(116, 120)]
    docs += [(i, prose(i, 6), 0) for i in range(120, 1300)]
    asked = [(5000, "rarissimus", 1)]
    labels = spark.createDataFrame([(i, t) for i, _, t in docs], "doc_id long, toxic int")
    table = spark.createDataFrame([(i, t) for i, t, _ in docs + asked], "doc_id long, text string")
    model, vectors = X.fit(table, labels, held_out=None)
    assert "rarissimus" in model.terms and "insultum" in model.terms
    found = {r[0]: r for r in rows_of(X.score(vectors, model))}
    assert found[5000][2] == 1 and found[5000][3]


def test_every_term_beyond_chance_is_chosen(spark):
    """More than a thousand of them."""
    words = [[f"w{i}x{j}" for j in range(40)] for i in range(30)]
    held = spark.createDataFrame(
        [(n * 30 + i, 1, sorted([*w, f"own{n}{i}"])) for i, w in enumerate(words) for n in range(5)] +
        [(10_000 + i, 0, [f"clean{i}"]) for i in range(2000)], "doc_id long, toxic int, terms array<string>")
    assert set(X._chosen_terms(held)) == {x for w in words for x in w}
    assert len(X._chosen_terms(held, 7)) == 7


def test_sparse_rows_build_the_same_index():
    rng = np.random.default_rng(6)
    rows = [(np.sort(rng.choice(30, rng.integers(0, 9), replace=False)), rng.integers(1, 5, 9)) for _ in range(150)]
    rows = [(t, c[:len(t)].astype(float)) for t, c in rows]
    made = []
    for sparse in (True, False):
        index = X.BlockIndex(np.arange(150), np.zeros(150, dtype=int), rng.random(30) * 0 + 1.5, 30)
        index.build(X.SparseRows(index, rows) if sparse else index.vectors(rows))
        made.append(index.search(index.vectors(rows[:40]), 9))
    assert all(np.array_equal(a, b) for a, b in zip(*made))
