"""Licence scans against the coefficient of every unit and template."""

from medallion.llm import licenses as L
from tests.llm.conftest import EDGE_ROWS, by_key, prose, rows_of


def rows():
    out = [(100 + i, f"{prose(i, 30)}\n{text}\n{prose(i + 50, 20)}") for i, (_, text) in enumerate(L.TEMPLATES)]
    out += [(200 + i, text.upper().replace(" ", "  ")) for i, (_, text) in enumerate(L.TEMPLATES)]
    out += [(300 + i, prose(i, 5) + "\n\n" + "\n".join(text.split(". ")) + "\n\n" + prose(9, 9))
            for i, (_, text) in enumerate(L.TEMPLATES)]
    out += [(400, "Released under the MIT licence."), (401, "Licensed under the Apache License, Version 3.0."),
            (402, prose(1, 10) + " Released under the MIT License. " + prose(2, 10))]
    return out + out[:2] + EDGE_ROWS


def plain(text):
    sets = [(name, L.bigrams(t)) for name, t in L.TEMPLATES]
    found = {}
    for first, n, unit in L.units(text or ""):
        score, name = min((-L.dice(L.bigrams(unit), s), name) for name, s in sets)
        if -score >= 0.8 and (name not in found or -score > found[name][0]):
            found[name] = (-score, first, n)
    return [(name, *hit) for name, hit in found.items()]


def test_against_every_template(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    got = rows_of(L.scan_licenses(docs))
    assert by_key(got) == by_key([(i, *hit) for i, t in rows() for hit in plain(t)])
    assert {name for _, name, *_ in got} == {name for name, _ in L.TEMPLATES}


def test_size_bounds_prune_nothing_that_counts():
    index = L.TemplateIndex(L.TEMPLATES, 0.5)
    for _, text in L.TEMPLATES:
        words = text.split()
        for cut in range(2, len(words), 3):
            part = " ".join(words[:cut])
            best = max(L.dice(L.bigrams(part), L.bigrams(t)) for _, t in L.TEMPLATES)
            hit = index.best(part)
            assert (hit is not None and abs(hit[1] - best) < 1e-12) if best >= 0.5 else hit is None


def test_empty_table(no_docs):
    assert rows_of(L.scan_licenses(no_docs)) == []
