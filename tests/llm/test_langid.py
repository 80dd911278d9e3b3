"""Language identification: kernels, defined cases, held-out accuracy."""

import zlib

import numpy as np

from medallion.llm import langid as G
from tests.llm.conftest import EDGE_ROWS, rows_of

TEXTS = ["the cat sat on the mat", "der hund und die katze", "le chat et la souris", "un perro y un gato",
         "ÜBER die brücke", "été à l'école", "x", "ñandú"]


def grams(text, table):
    codes = [0, *(int(table[ord(c)]) for c in text.lower()), 0]
    return {tuple(codes[i:i + n]) for n in (1, 2, 3) for i in range(len(codes) - n + 1)}


def test_kernel_is_the_blended_presence_kernel():
    model = G.fit_rows(TEXTS, list("abcdabcd"), n_landmarks=8)
    sets = [grams(t, model.alphabet.table) for t in TEXTS]
    got, letters = model.kernels(TEXTS, np.zeros(G.N_GRAMS, dtype=bool))
    order = [TEXTS.index(t) for g in range(1) for t in TEXTS]
    landmarks = [i for turn in range(2) for i in (turn * 4, turn * 4 + 1, turn * 4 + 2, turn * 4 + 3)]
    want = [[len(a & sets[j]) / (len(a) * len(sets[j])) ** 0.5 for j in landmarks] for a in (sets[i] for i in order)]
    assert np.allclose(got, want, atol=1e-5) and letters.all()


def test_all_landmarks_give_exact_kernel_ridge_regression():
    langs = list("abcdabcd")
    model = G.fit_rows(TEXTS, langs, n_landmarks=8, ridge=1e-3)
    kernels, _ = model.kernels(TEXTS, np.zeros(G.N_GRAMS, dtype=bool))
    assert (np.array(model.languages)[(kernels @ model.weights + model.bias).argmax(axis=1)] == langs).all()


def test_work_array_is_left_clean():
    model, seen = G.fit_rows(TEXTS, list("abcdabcd")), np.zeros(G.N_GRAMS, dtype=bool)
    first = model.predict(TEXTS, seen)[1]
    assert not seen.any() and np.allclose(first, model.predict(TEXTS, seen)[1])


def test_edge_rows(edge_docs):
    got = rows_of(G.identify(edge_docs, G.fit(edge_docs)))
    assert len(got) == len(EDGE_ROWS)
    by_id = {}
    for i, lang, score in got:
        assert 0.0 <= score <= 1.0
        by_id.setdefault(i, set()).add((lang, score))
    assert by_id[3] == by_id[4] == by_id[5] == {("und", 0.0)}
    assert len(by_id[2]) == 1 and all(g in ("en", "de") for g, _ in by_id[9])


def test_without_training_rows(spark, edge_docs, no_docs):
    assert G.fit(no_docs) is None
    assert {(g, s) for _, g, s in rows_of(G.identify(edge_docs, None))} == {("und", 0.0)}
    assert rows_of(G.identify(no_docs, G.fit(edge_docs))) == []
    one = spark.createDataFrame([(0, "nur eine sprache", "de"), (1, "123", "de")], "doc_id long, text string, lang string")
    assert sorted(g for _, g, _ in rows_of(G.identify(one, G.fit(one, held_out=None)))) == ["de", "und"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = [(truth[i], g) for i, g, _ in rows_of(G.identify(docs, G.fit(docs)))
           if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(a == b for a, b in got) >= 0.98 * len(got)
