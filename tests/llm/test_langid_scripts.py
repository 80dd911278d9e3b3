"""Language identification of many scripts: letters beyond the frequent ones differ."""

import random

import numpy as np

from medallion.llm import langid as G
from tests.llm.conftest import rows_of


def letters(first: int, n: int) -> list[str]:
    return [c for c in map(chr, range(first, first + 4 * n)) if c.isalpha()][:n]


#: letters of Latin and Cyrillic (frequent), Thai, Khmer, Chinese and Korean (rare)
SCRIPTS = {"la": letters(0x61, 26), "ru": letters(0x430, 40), "th": letters(0xE01, 44), "km": letters(0x1780, 33),
           "zh": letters(0x4E00, 300), "ko": letters(0xAC00, 300)}


def text(rng, lang, n=12):
    return " ".join("".join(rng.choices(SCRIPTS[lang], k=4)) for _ in range(n))


def rows(seed, per_lang):
    rng = random.Random(seed)
    return [(text(rng, g), g) for g, n in per_lang.items() for _ in range(n)]


MANY = {"la": 80, "ru": 80, "th": 12, "km": 12, "zh": 12, "ko": 12}


def grams(text):
    own = [c if c.isalpha() else " " for c in " " + text.lower() + " "]
    return {tuple(own[i:i + n]) for n in (1, 2, 3) for i in range(len(own) - n + 1)}


def test_kernels_are_those_of_code_points():
    train = rows(1, {g: 4 for g in SCRIPTS})
    model = G.fit_rows([t for t, _ in train], [g for _, g in train], n_landmarks=24)
    order = [i for turn in range(4) for g in sorted(SCRIPTS) for i in [[k for k, r in enumerate(train) if r[1] == g][turn]]]
    asked = [t for t, _ in rows(2, {g: 3 for g in SCRIPTS})] + ["mixed ไทย ខ្មែរ 漢字 한국어 text", "ΑΒΓ unseen", "漢", "12"]
    seen = np.zeros(G.N_GRAMS, dtype=bool)
    got, _ = model.kernels(asked, seen)
    sets = [grams(train[i][0]) for i in order]
    want = [[len(a & b) / (len(a) * len(b)) ** 0.5 for b in sets] for a in map(grams, asked)]
    assert np.allclose(got, want, atol=1e-5) and not seen.any()


def test_rare_scripts_are_told_apart(spark):
    train, asked = rows(3, MANY), rows(4, {g: 10 for g in SCRIPTS})
    assert len({c for t, _ in train for c in t if c.isalpha()}) > 62
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(train)], "doc_id long, text string, lang string")
    new = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(asked)], "doc_id long, text string")
    got = rows_of(G.identify(new, G.fit(docs, held_out=None)))
    assert sum(asked[i][1] == g for i, g, _ in got) == len(asked)
