"""Toxicity by nearest labelled examples.

A text becomes a TF-IDF vector over the terms (words and their beginnings)
that tell the two labels apart; its nearest labelled examples under exact cosine come out of a
block-max inverted index; their distance-weighted votes, calibrated on the
examples themselves, are the score, and the neighbours are the evidence.

What is fitted on a bounded sample (parameter ``max_examples``): the examples
and the term choice, which keeps every term beyond the chance level.  What covers every row of
the corpus: document frequencies, scores.  Texts are read whole, once.

Defined cases: a null text is an empty one; a text without any chosen term
has no neighbours and gets the share of toxic labels among the examples of
that kind; examples at equal cosine are taken in index order; repeated
rows are scored alike; a document labelled more than once is toxic if any
of its labels says so; without usable labels every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_list, fold_remainder, share, shared_value, staged, text_slices, texts_of

MAX_EXAMPLES = 6000          # labelled rows used, at most
MIN_CHI2 = 24.0              # chance level with some 10**6 candidate terms
PREFIXES = (4, 5, 6)         # lengths of the beginnings that are terms beside the word
MIN_EXAMPLES_WITH_TERM = 3
NEIGHBOURS = 15
BLOCK_ROWS = 64
THRESHOLD = 0.7
NEAREST = 1e-2               # added to distances, so that a copy has a finite weight
CLEAN_VOTE = 1.0             # weight of the clean vote that every text has

WORD = re.compile(r"[^\W\d_]+")


def word_terms(word: str) -> list[str]:
    """A word and its beginnings, marked as such: inflected and compound
    forms that were never seen whole still share a term."""
    return [word, *(word[:k] + "~" for k in PREFIXES if len(word) > k)]


@dataclass
class BlockIndex:
    """Examples as unit vectors in blocks; each block keeps the weights of the
    terms it holds (its posting lists) and every term its largest weight."""

    ids: np.ndarray                    # example -> document id
    toxic: np.ndarray                  # example -> 0/1
    idf: np.ndarray                    # term -> weight
    n_terms: int
    block_rows: int = BLOCK_ROWS
    bounds: np.ndarray = None          # block x term: largest weight
    postings: list = field(default_factory=list)   # block -> (terms, weights, first, n)

    def batch_rows(self) -> int:
        """Rows at a time, so that their vectors take some 16 MB at most."""
        return max(1, min(512, (4 << 20) // max(1, self.n_terms)))

    def vectors(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Unit TF-IDF vectors (rows of zeros where no term occurs)."""
        out = np.zeros((len(rows), self.n_terms), dtype=np.float32)
        for i, (terms, counts) in enumerate(rows):
            if len(terms):
                out[i, terms] = (1.0 + np.log(counts)) * self.idf[terms]
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norm, out=out, where=norm > 0)

    def build(self, vectors) -> None:
        """Index the examples; ``vectors`` is an array, or gives the vectors
        of a slice as one (see ``SparseRows``)."""
        n = len(vectors)
        self.bounds = np.zeros((-(-n // self.block_rows), self.n_terms), dtype=np.float32)
        for b in range(len(self.bounds)):
            first = b * self.block_rows
            block = vectors[first:first + self.block_rows]
            self.bounds[b] = block.max(axis=0)
            terms = np.flatnonzero(self.bounds[b])
            self.postings.append((terms, np.ascontiguousarray(block[:, terms].T), first, len(block)))

    def search(self, queries: np.ndarray, k: int, skip: np.ndarray | None = None):
        """The k examples of largest cosine per query: (cosines, examples),
        cosine 0 where there are fewer.  ``skip`` names one example per query
        that may not be its own neighbour.

        Blocks are met in the order of their bounds' sum; a query skips a
        block whose bound lies below its k-th cosine so far.  The bound is
        never below a cosine in the block, so the result is exact.
        """
        n = len(queries)
        best = np.zeros((n, k), dtype=np.float32)
        who = np.full((n, k), -1, dtype=np.int64)
        if not len(self.bounds):
            return best, who
        upper = queries @ self.bounds.T
        # every query sees its own best block first: later bounds then prune
        seed = upper.argmax(axis=1)
        for b in np.unique(seed):
            self._visit(b, np.flatnonzero((seed == b) & (upper[:, b] > 0)), queries, best, who, skip)
        for b in np.argsort(-upper.sum(axis=0), kind="stable"):
            rows = np.flatnonzero((upper[:, b] > 0) & (seed != b) & (upper[:, b] >= best[:, -1] - 1e-6))
            self._visit(b, rows, queries, best, who, skip)
        return best, who

    def _visit(self, b, rows, queries, best, who, skip) -> None:
        if not len(rows):
            return
        terms, weights, first, m = self.postings[b]
        sims = queries[np.ix_(rows, terms)] @ weights
        ids = np.broadcast_to(np.arange(first, first + m), sims.shape)
        if skip is not None:
            sims = np.where(ids == skip[rows, None], 0, sims)
        k = best.shape[1]
        sims = np.concatenate([best[rows], np.minimum(sims, 1.0)], axis=1)
        ids = np.concatenate([who[rows], np.where(sims[:, k:] > 0, ids, -1)], axis=1)
        # equal cosines: the lower example first, whatever block came first
        order = np.lexsort((ids, -np.round(sims, 6)), axis=1)[:, :k]
        best[rows] = np.take_along_axis(sims, order, axis=1)
        who[rows] = np.take_along_axis(ids, order, axis=1)


@dataclass
class SparseRows:
    """Term counts of examples, made into vectors a slice at a time: no array
    of all examples by all terms is held."""

    index: BlockIndex
    rows: list[tuple[np.ndarray, np.ndarray]]

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, part: slice) -> np.ndarray:
        return self.index.vectors(self.rows[part])


def votes(cosines: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Share of the toxic votes, each weighted by inverse distance (NaN where
    there is no neighbour), beside one clean vote that every text has: far
    neighbours alone, which share one weak term, make no toxic text."""
    weight = np.where(cosines > 0, cosines / (1.0 - cosines + NEAREST), 0.0)
    total = weight.sum(axis=1)
    with np.errstate(invalid="ignore"):
        return np.where(total > 0, (weight * labels).sum(axis=1) / (total + CLEAN_VOTE), np.nan)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of y on x (pool adjacent
    violators), one knot per pooled block at its mean x."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []          # [weight, mean y, mean x]
    for xv, yv in zip(x[order], y[order]):
        blocks.append([1.0, float(yv), float(xv)])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, y2, x2 = blocks.pop()
            w1, y1, x1 = blocks.pop()
            w = w1 + w2
            blocks.append([w, (w1 * y1 + w2 * y2) / w, (w1 * x1 + w2 * x2) / w])
    return np.array([b[2] for b in blocks]), np.array([b[1] for b in blocks])


@dataclass
class ToxicityModel:
    terms: list[str]
    index: BlockIndex
    knots: tuple[np.ndarray, np.ndarray]
    no_evidence: float               # score of a text without any chosen term
    neighbours: int

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        """(scores, cosines, examples) of sparse term counts."""
        vectors = self.index.vectors(rows)
        cosines, who = self.index.search(vectors, self.neighbours)
        return self.calibrated(votes(cosines, self.index.toxic[who] * (who >= 0)) if len(self.index.toxic)
                               else np.full(len(rows), np.nan)), cosines, who

    def calibrated(self, vote: np.ndarray) -> np.ndarray:
        if not len(self.knots[0]):
            return np.full(len(vote), self.no_evidence)
        level = np.interp(np.nan_to_num(vote), *self.knots)
        # a trace of the raw vote keeps the order inside a pooled level
        return np.where(np.isnan(vote), self.no_evidence, 0.99 * level + 0.01 * np.nan_to_num(vote))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, max_examples: int,
                  held_out: int | None, folds: int = 3) -> DataFrame:
    """(doc_id, text, toxic) of a bounded sample of the labelled documents.

    The sample is the ``max_examples`` lowest hashes of the id; it is sent to
    every task, its size being bounded by the parameter, so that the texts
    are read in place and never shuffled.
    """
    usable = labels.select(labels["doc_id"].cast("long").alias("doc_id"),
                           labels[label_col].cast("int").alias("toxic")).dropna()
    if held_out is not None:
        usable = usable.where(fold_remainder(F.col("doc_id"), folds) != held_out)
    sample = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    return docs.join(F.broadcast(sample), "doc_id")


def _chosen_terms(held: DataFrame, max_terms: int | None = None) -> list[str]:
    """Terms whose presence depends on the label beyond chance (chi-square of
    the two-by-two table), the strongest first: all of them, unless a number
    is asked for.  Copies count as one example."""
    single = held.groupBy("terms").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = single.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < n_toxic < n:
        return []
    per_term = single.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).cast("double").alias("n_with"), F.sum("toxic").cast("double").alias("n_toxic"))
    a, w = F.col("n_toxic"), F.col("n_with")
    diff = a * F.lit(float(n)) - w * F.lit(float(n_toxic))
    chi2 = diff * diff * F.lit(float(n)) / (w * (F.lit(float(n)) - w + 0.5) *
                                            F.lit(float(n_toxic) * float(n - n_toxic)))
    found = per_term.where(F.col("n_with") >= MIN_EXAMPLES_WITH_TERM).withColumn("chi2", chi2).where(
        F.col("chi2") >= MIN_CHI2).orderBy(F.desc("chi2"), "term")
    return [r["term"] for r in (found if max_terms is None else found.limit(max_terms)).select("term").collect()]


def _with_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        yield pa.RecordBatch.from_arrays([
            part.column(0), part.column(2),
            pa.array([sorted({x for w in set(WORD.findall(t.lower())) for x in word_terms(w)})
                      for t in texts_of(part)], pa.list_(pa.string()))], ["doc_id", "toxic", "terms"])


class _TermLookup(dict):
    """Word -> the numbers of its chosen terms, worked out once per word."""

    def __init__(self, position: dict[str, int]):
        super().__init__()
        self.position = position

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = tuple(self.position[t] for t in word_terms(word) if t in self.position)
        return found


def vectorize(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, terms, counts): the chosen terms of every whole text; a column
    ``row`` goes along."""
    position = {t: i for i, t in enumerate(terms)}
    also = [c for c in docs.columns if c == "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _TermLookup(position)
        for part in text_slices(batches):
            found = []
            for text in texts_of(part):
                counts: Counter = Counter()
                for word in WORD.findall(text.lower()):
                    if hit := lookup[word]:
                        counts.update(hit)
                found.append(counts)
            yield pa.RecordBatch.from_arrays([
                part.column(0),
                pa.array([sorted(c) for c in found], pa.list_(pa.int32())),
                pa.array([[c[t] for t in sorted(c)] for c in found], pa.list_(pa.int32())),
                *[part.column(part.schema.get_field_index(c)) for c in also]],
                ["doc_id", "terms", "counts", *also])

    return docs.mapInArrow(run, ", ".join(["doc_id long, terms array<int>, counts array<int>",
                                           *[f"{c} long" for c in also]]))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", held_out: int | None = 1,
        max_examples: int = MAX_EXAMPLES, max_terms: int | None = None,
        neighbours: int = NEIGHBOURS, row_col: str | None = None) -> tuple[ToxicityModel, DataFrame]:
    """The model, and the term counts of all documents it was fitted with;
    ``row_col`` is a number of the caller's that stays with each row, as ``row``."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"),
                       *([docs[row_col].cast("long").alias("row")] if row_col is not None else []))
    sample = training_rows(docs, labels, label_col, max_examples, held_out)
    held = staged(sample.select("doc_id", "text", "toxic").mapInArrow(
        _with_terms, "doc_id long, toxic int, terms array<string>"), "toxicity-examples")
    terms = _chosen_terms(held, max_terms)

    vectors = staged(vectorize(docs, terms), "toxicity-vectors")
    n_docs = vectors.count()
    frequency = {r["t"]: r["n"] for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(
        F.count(F.lit(1)).alias("n")).collect()}          # at most one row per chosen term
    idf = np.array([np.log((1 + n_docs) / (1 + frequency.get(i, 0))) + 1 for i in range(len(terms))],
                   dtype=np.float32)

    # the sample's rows again, now as vectors: max_examples of them, also where ids repeat
    labelled = held.select("doc_id", "toxic").distinct()
    examples = vectors.join(F.broadcast(labelled), "doc_id").orderBy("doc_id", "terms", "counts").limit(
        max_examples).collect()
    sparse = [(np.array(r["terms"], dtype=np.int64), np.array(r["counts"], dtype=np.float64)) for r in examples]
    toxic = np.array([r["toxic"] for r in examples], dtype=np.int64)
    ids = np.array([r["doc_id"] for r in examples], dtype=np.int64)

    index = BlockIndex(ids, toxic, idf, len(terms))
    used = np.array([i for i, (own, _) in enumerate(sparse) if len(own)], dtype=np.int64)
    empty = np.setdiff1d(np.arange(len(examples)), used)
    base = float(toxic.mean()) if len(toxic) else 0.0
    no_evidence = float((toxic[empty].sum() + base) / (len(empty) + 1)) if len(examples) else 0.0
    if len(used):
        # like examples share blocks: bounds stay tight
        leading = np.array([own[((1.0 + np.log(counts)) * idf[own]).argmax()] for own, counts in
                            (sparse[i] for i in used)])
        order = used[np.lexsort((ids[used], leading, toxic[used]))]
        index.ids, index.toxic = ids[order], toxic[order]
        vectors_of = SparseRows(index, [sparse[i] for i in order])
        index.build(vectors_of)
        step = index.batch_rows()
        near = [index.search(vectors_of[lo:lo + step], neighbours, skip=np.arange(lo, min(lo + step, len(order))))
                for lo in range(0, len(order), step)]
        cosines, who = (np.concatenate(x) for x in zip(*near))
        vote = votes(cosines, index.toxic[who] * (who >= 0))
        sure = ~np.isnan(vote)
        knots = isotonic(vote[sure], index.toxic[sure].astype(float))
    else:
        index.ids, index.toxic = ids[:0], toxic[:0]
        index.bounds = np.zeros((0, len(terms)), dtype=np.float32)
        knots = (np.zeros(0), np.zeros(0))
    return ToxicityModel(terms, index, knots, no_evidence, neighbours), vectors


def score(vectors: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD,
          n_evidence: int = 3) -> DataFrame:
    """(doc_id, score, predicted, evidence) of every row; the evidence lists
    the nearest examples (doc_id, toxic, cosine).  A column ``row`` goes along."""
    also = [c for c in vectors.columns if c == "row"]
    shared = share(vectors.sparkSession, model)
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared_value(shared)
        for batch in batches:
            step = m.index.batch_rows()
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                rows = [(np.asarray(t, dtype=np.int64), np.asarray(c, dtype=np.float64))
                        for t, c in zip(column_list(part, "terms"), column_list(part, "counts"))]
                scores, cosines, who = m.score(rows)
                scores = np.clip(scores, 0.0, 1.0)
                near = [[{"doc_id": int(m.index.ids[w]), "toxic": int(m.index.toxic[w]), "cosine": float(c)}
                         for c, w in zip(cs[:n_evidence], ws[:n_evidence]) if w >= 0]
                        for cs, ws in zip(cosines, who)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)),
                    pa.array(near, evidence), *[part.column(part.schema.get_field_index(c)) for c in also]],
                    ["doc_id", "score", "predicted", "evidence", *also])

    return vectors.mapInArrow(
        run, ", ".join(["doc_id long, score double, predicted int, "
                        "evidence array<struct<doc_id:long,toxic:int,cosine:double>>", *[f"{c} long" for c in also]]))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Fit on the labelled rows outside the held-out fold and score every row."""
    model, vectors = fit(docs, labels, **options)
    return score(vectors, model)
