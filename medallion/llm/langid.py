"""Language identification by string kernels.

The kernel of two texts counts the character n-grams (orders 1 to 3, blended
spectrum) present in both, normalised by the geometric mean of the numbers
present in each.  A few training texts are landmarks; the Nyström map sends a
text to its kernels with them, whitened; one-versus-rest ridge regression on
these features is the classifier.  Scoring is one matrix product per batch.

What is fitted on a bounded sample (``max_examples`` texts of at most
``MAX_EXAMPLE_CHARS``, ``n_landmarks`` of them landmarks): the whole model.  Every row is scored from its whole text.

Defined cases: a null text, or one without a letter, is ``und`` with score
0; with a single training language every other text gets it; without
training rows every text is ``und``; repeated rows are scored alike; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_list, fold_remainder, id_text, share, shared_value, text_slices

MAX_EXAMPLES = 6000          # training texts, at most
MAX_EXAMPLE_CHARS = 50_000   # longer texts are not trained on (they are scored)
N_LANDMARKS = 256            # landmark texts, at most
RIDGE = 1e-2
SHARPNESS = 6.0              # of the soft maximum that turns margins into scores
UNDETERMINED = "und"

BITS = 6                     # of a character code: 0 any non-letter, 1..62 frequent letters, 63 other letters
_CODES = 1 << BITS
_OTHER = _CODES - 1
_OFFSETS = (0, _CODES, _CODES + _CODES ** 2)
N_GRAMS = _CODES + _CODES ** 2 + _CODES ** 3   # an n-gram with a letter of code 63 has a number from here on
_POINT_BITS = 21             # of a code point, plus one


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)


@dataclass
class Alphabet:
    """Code of every character; letters are numbered by their frequency.

    The codes are a short cut for frequent letters: an n-gram of these has a
    number below ``N_GRAMS`` and is looked up in flags.  Any other n-gram is
    numbered by its code points, so that all letters of all scripts differ.
    """

    table: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> "Alphabet":
        points, counts = np.unique(np.concatenate([_points(t) for t in texts] or [np.zeros(0, np.uint32)]),
                                   return_counts=True)
        order = np.lexsort((points, -counts))
        letters = [int(p) for p in points[order] if chr(p).isalpha()][:_OTHER - 1]
        table = np.zeros(0x110000, dtype=np.uint8)
        table[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]] = _OTHER
        table[letters] = np.arange(1, len(letters) + 1)
        return cls(table)

    def present(self, text: str, seen: np.ndarray) -> tuple[np.ndarray, bool]:
        """(numbers of the n-grams present, ascending, whether there is a
        letter); ``seen`` is an all-false work array of N_GRAMS flags."""
        points = _points(text)
        own = self.table[points]
        codes = np.zeros(len(own) + 2, dtype=np.int32)
        codes[1:-1] = own
        pairs = codes[:-1] * _CODES + codes[1:]
        triples = pairs[:-1] * _CODES + codes[2:]
        rare = codes == _OTHER
        if not rare.any():
            seen[codes] = True
            seen[_OFFSETS[1] + pairs] = True
            seen[_OFFSETS[2] + triples] = True
            found = np.flatnonzero(seen)
            seen[found] = False
            return found, bool(own.any())
        rare_pairs = rare[:-1] | rare[1:]
        rare_triples = rare_pairs[:-1] | rare[2:]
        seen[codes[~rare]] = True
        seen[_OFFSETS[1] + pairs[~rare_pairs]] = True
        seen[_OFFSETS[2] + triples[~rare_triples]] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        # one is any non-letter, so that n-grams of different orders differ
        letters = np.ones(len(codes), dtype=np.int64)
        letters[1:-1][own > 0] += points[own > 0]
        wide = (letters[:-1] << _POINT_BITS) | letters[1:]
        others = np.unique(np.concatenate([
            letters[rare], wide[rare_pairs], ((wide[:-1] << _POINT_BITS) | letters[2:])[rare_triples]]))
        return np.concatenate([found, N_GRAMS + others]), True


@dataclass
class LanguageModel:
    languages: list[str]
    alphabet: Alphabet
    column: np.ndarray           # n-gram below N_GRAMS -> column of the landmark matrix, or -1
    others: np.ndarray           # the other n-grams of the landmarks, ascending: the last columns
    landmarks: np.ndarray        # column x landmark: present, over the root of the landmark's count
    weights: np.ndarray          # landmark x language (whitening and regression in one)
    bias: np.ndarray

    def columns(self, found: np.ndarray) -> np.ndarray:
        """Columns of those n-grams that a landmark has."""
        split = int(np.searchsorted(found, N_GRAMS))
        near = self.column[found[:split]]
        near = near[near >= 0]
        if split == len(found) or not len(self.others):
            return near
        rest = found[split:]
        at = np.minimum(np.searchsorted(self.others, rest), len(self.others) - 1)
        first = len(self.landmarks) - len(self.others)
        return np.concatenate([near, first + at[self.others[at] == rest]])

    def kernels(self, texts: list[str], seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(kernels with the landmarks, whether each text has a letter)."""
        rows = np.zeros((len(texts), len(self.landmarks)), dtype=np.float32)
        letters = np.zeros(len(texts), dtype=bool)
        for i, text in enumerate(texts):
            found, letters[i] = self.alphabet.present(text, seen)
            rows[i, self.columns(found)] = 1.0 / np.sqrt(len(found))
        return rows @ self.landmarks, letters

    def predict(self, texts: list[str], seen: np.ndarray) -> tuple[list[str], np.ndarray]:
        kernels, letters = self.kernels(texts, seen)
        margins = SHARPNESS * (kernels @ self.weights + self.bias)
        odds = np.exp(margins - margins.max(axis=1, keepdims=True))
        odds /= odds.sum(axis=1, keepdims=True)
        best = odds.argmax(axis=1)
        names = [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letters)]
        return names, np.where(letters, odds[np.arange(len(texts)), best], 0.0)


def fit_rows(texts: list[str], langs: list[str], n_landmarks: int = N_LANDMARKS,
             ridge: float = RIDGE) -> LanguageModel | None:
    """The model of texts and their languages, in the order given."""
    rows = [(t, g) for t, g in zip(texts, langs) if any(map(str.isalpha, t))]
    if not rows:
        return None
    texts, langs = [t for t, _ in rows], [g for _, g in rows]
    languages = sorted(set(langs))
    alphabet = Alphabet.of(texts)
    seen = np.zeros(N_GRAMS, dtype=bool)
    # landmarks: as many of each language as possible, in turns
    by_lang = {g: [i for i, x in enumerate(langs) if x == g] for g in languages}
    chosen = [own[turn] for turn in range(max(map(len, by_lang.values()))) for own in by_lang.values()
              if turn < len(own)][:n_landmarks]
    grams = [alphabet.present(texts[i], seen)[0] for i in chosen]
    known = np.unique(np.concatenate(grams))
    split = int(np.searchsorted(known, N_GRAMS))
    column = np.full(N_GRAMS, -1, dtype=np.int32)
    column[known[:split]] = np.arange(split)
    landmarks = np.zeros((len(known), len(chosen)), dtype=np.float32)
    model = LanguageModel(languages, alphabet, column, known[split:], landmarks, None, None)
    for j, found in enumerate(grams):
        landmarks[model.columns(found), j] = 1.0 / np.sqrt(len(found))
    among = (landmarks.T @ landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh(among)
    keep = values > 1e-8 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    kernels = np.concatenate([model.kernels(texts[lo:lo + 256], seen)[0] for lo in range(0, len(texts), 256)])
    features = kernels.astype(np.float64) @ whiten
    goal = np.where(np.array(langs)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    centre, mean = features.mean(axis=0), goal.mean(axis=0)
    x, y = features - centre, goal - mean
    solved = np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ y)
    model.weights = (whiten @ solved).astype(np.float32)
    model.bias = (mean - centre @ solved).astype(np.float32)
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        held_out: int | None = 1, folds: int = 3, max_examples: int = MAX_EXAMPLES,
        n_landmarks: int = N_LANDMARKS) -> LanguageModel | None:
    """Fit on at most ``max_examples`` rows (the lowest hashes of the id) with
    a language, outside the held-out fold."""
    usable = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"),
                         docs[lang_col].cast("string").alias("lang")).dropna().where(
        F.char_length("text") <= MAX_EXAMPLE_CHARS)
    if held_out is not None:
        usable = usable.where(fold_remainder(F.col("doc_id"), folds) != held_out)
    chosen = usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    rows = usable.join(F.broadcast(chosen), "doc_id").orderBy(
        F.xxhash64("doc_id"), "doc_id", "lang", "text").limit(max_examples).collect()
    return fit_rows([r["text"] for r in rows], [r["lang"] for r in rows], n_landmarks)


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    shared = share(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = shared_value(shared), np.zeros(N_GRAMS, dtype=bool)
        for big in text_slices(batches):
            for lo in range(0, big.num_rows, 256):
                part = big.slice(lo, 256)
                texts = [t or "" for t in column_list(part, "text")]
                names, scores = m.predict(texts, seen) if m is not None else (
                    [UNDETERMINED] * len(texts), np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(np.asarray(scores, dtype=np.float64))],
                    ["doc_id", "lang_pred", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")
