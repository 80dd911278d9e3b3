"""Licence notices inside other text, against every window of words."""

import random

import pytest

from medallion.llm import licenses as L
from tests.llm.conftest import prose, rows_of

GPL = dict(L.TEMPLATES[::-1])["GPL-3.0"]
GPL_HEADER = next(t for name, t in L.TEMPLATES if name == "GPL-3.0" and t.startswith("This program"))


def best_window(words, template):
    """The best coefficient of all windows of a text, plainly."""
    pairs, own, best = list(zip(words, words[1:])), L.bigrams(template), 0.0
    for s in range(len(pairs)):
        for e in range(s + 1, len(pairs) + 1):
            best = max(best, L.dice(set(pairs[s:e]), own))
    return best


def texts():
    rng = random.Random(5)
    short = [t for t in L.TEMPLATES if len(t[1]) < 160]
    for i in range(60):
        words = L.words_of(rng.choice(short)[1])
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(words))
            words[at:at + rng.randrange(2)] = rng.choice(["", "the", "license under", "under the"]).split()
        yield prose(i, rng.randrange(12)) + rng.choice([" ", "\n", "\n\n"]) + "\n".join(
            [" ".join(words[:5]), " ".join(words[5:])]) + " " + prose(i + 70, rng.randrange(12))
    yield "under the under the under the mit under the mit license under the"


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_best_window_is_exact(threshold):
    found = 0
    for text in texts():
        for template in L.TEMPLATES:
            if len(template[1]) > 160:
                continue
            got = L.TemplateIndex((template,), threshold).scan(text)
            best = best_window(L.words_of(text), template[1])
            assert [c for _, c, *_ in got] == ([best] if best >= threshold else [])
            found += len(got)
    assert found > 60


def test_notices_that_share_their_line_or_paragraph(spark):
    comment = "\n".join("# " + line for line in ["Tool for " + prose(1, 9), "", *GPL_HEADER.split(", "), "", prose(2, 40)])
    rows = [(1, "Copyright 2020 Jane Doe. Released under the MIT License. See the docs.", "MIT", 1.0),
            (2, "The project is released under the MIT License.", "MIT", 1.0), (3, comment, "GPL-3.0", 1.0),
            (4, prose(3, 50) + " " + GPL + " " + prose(4, 50), "GPL-3.0", 1.0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = sorted((i, name, dice) for i, name, dice, *_ in rows_of(L.scan_licenses(docs)))
    assert got == [(i, name, dice) for i, _, name, dice in rows]


def test_sister_notices_are_read_once():
    index = L.TemplateIndex(L.TEMPLATES)
    for version in ("2", "3"):
        text = f"{prose(5, 9)} This work is licensed under the GNU General Public License, version {version}. {prose(6, 9)}"
        assert [(n, c) for n, c, *_ in index.scan(text)] == [(f"GPL-{version}.0", 1.0)]


def test_lines_of_a_window():
    index = L.TemplateIndex(L.TEMPLATES)
    text = f"{prose(1, 5)}\n{prose(2, 4)} Released under\nthe MIT License. {prose(3, 4)}\n" + "Released under the MIT License. " * 3
    assert index.scan(text) == [("MIT", 1.0, 1, 2)]


def test_every_template_has_its_own_name():
    """Near variants too: no text comes out as its sister licence, alone or inside other text."""
    templates = L.all_templates()
    index = L.TemplateIndex(templates)
    for i, (name, text) in enumerate(templates):
        for whole in (text, f"{prose(i, 9)} {text}\n{prose(i + 9, 9)}", "\n".join(
                "# " + " ".join(text.split()[j:j + 9]) for j in range(0, len(text.split()), 9))):
            found = {n: c for n, c, *_ in index.scan(whole)}
            assert found == {name: 1.0}, (name, text[:60], found)


def test_complete_texts_headers_and_near_variants_are_there():
    names = {name for name, _ in L.all_templates()}
    assert {"Apache-2.0", "MIT", "ISC", "Unlicense", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "EPL-1.0", "EPL-2.0",
            "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "CC-BY-4.0", "CC-BY-ND-4.0",
            "CC-BY-SA-4.0"} <= names
    complete = {name for name, text in L.all_templates() if len(text) > 5000}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0"} <= complete


def test_headers_of_sister_licences(spark):
    rows = []
    for i, (name, what, version) in enumerate([("GPL-2.0", "General", "2"), ("GPL-3.0", "General", "3"),
                                               ("LGPL-3.0", "Lesser General", "3"), ("AGPL-3.0", "Affero General", "3")]):
        text = GPL_HEADER.replace("GNU General", f"GNU {what}").replace("version 3", f"version {version}")
        rows.append((i, f"{prose(i, 8)}\n/* {text} */\n{prose(i + 5, 8)}", name))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = sorted((i, name, dice) for i, name, dice, *_ in rows_of(L.scan_licenses(docs)))
    assert got == [(i, name, 1.0) for i, _, name in rows]
