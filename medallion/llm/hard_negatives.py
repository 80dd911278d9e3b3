"""Hard-negative mining by a vertical scan in the manner of BOND.

Each task lays its candidates out vertically, a row per dimension, and keeps
the least and greatest value of every dimension.  An anchor reads dimensions
in the order of its own components' magnitude.  After each few of them the
least and greatest that the remaining dimensions can contribute give every
candidate an interval for its score; the candidates whose interval meets no
window any more leave the bitmap.  Those left at the end have exact scores.

Two scans a block of anchors: one for the positives (same label, the best
few; one window without ends whose floor rises), one for the negatives
(another label, a window for each positive, ``low`` to ``high`` hundredths of
the positive's score, the best few in it).  Anchor blocks have a fixed size,
each broadcast by itself and its rows written; tasks keep a few candidates
for each window, and a window function over these gives the answer.

Defined cases: rows with a null id or label, a null vector or a null or
non-finite component take no part; vectors of unlike length end in zeros; a
row with the anchor's id is its own, neither positive nor negative;
candidates that agree in id and score count once; an id that comes with
several labels or vectors is an anchor with each, and equal anchors once;
positives with a score below zero have an empty window; fewer candidates
than asked for give all; an empty table gives no rows; scores beyond a long
are held at its ends.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import share, shared_value
from .vectors import Best, big_scores, first_ranks, fits, packed, query_blocks, same_height, vector_rows, \
    vertical_blocks

SCALE = 256.0
DIMENSIONS = 8              # read between two looks at the bitmap
BLOCK_ROWS = 8192           # candidates in one vertical block
ANCHOR_ROWS = 2048          # anchors in one broadcast, at most
ANCHOR_CELLS = 1 << 22      # and components (32 MB)


class Span:
    """Scores from ``low`` to ``high`` of which the first ``k`` are kept."""

    def __init__(self, k: int, low: float = -np.inf, high: float = np.inf):
        self.low, self.high, self.best = low, high, Best(k)

    def meets(self, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whose interval of scores may still bring something into it."""
        return (most >= max(self.low, self.best.floor)) & (least <= self.high)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        inside = (scores >= self.low) & (scores <= self.high)
        self.best.add(scores[inside], ids[inside])


def scan_block(anchor: np.ndarray, columns: np.ndarray, low: np.ndarray, high: np.ndarray, bitmap: np.ndarray,
               ids: np.ndarray, spans: list[Span], step: int = DIMENSIONS) -> None:
    """Resolve one anchor against the candidates of one block that are set
    in the bitmap; ``low`` and ``high`` are the dimensions' extremes."""
    order = np.argsort(-np.abs(anchor), kind="stable")
    order = order[anchor[order] != 0]
    q = anchor[order]
    ends = np.sort(np.stack([q * low[order], q * high[order]]), axis=0)
    # what the dimensions from place i on contribute, at the least and most
    least = np.append(np.cumsum(ends[0][::-1])[::-1], 0.0)
    most = np.append(np.cumsum(ends[1][::-1])[::-1], 0.0)
    alive = np.flatnonzero(bitmap)
    score = np.zeros(len(alive))
    for at in range(0, len(order) + 1, step):
        keep = np.zeros(len(alive), dtype=bool)
        for span in spans:
            keep |= span.meets(score + least[at], score + most[at])
        if not keep.all():
            alive, score = alive[keep], score[keep]
        if not len(alive) or at >= len(order):
            break
        dims = order[at:at + step]
        score = score + anchor[dims] @ (columns[dims] if len(alive) == columns.shape[1] else
                                        columns[np.ix_(dims, alive)])
    for span in spans:
        span.add(score, ids[alive])


def _scan(candidates: DataFrame, block, scale: float, block_rows: int, same_label: bool) -> DataFrame:
    """(span, id, score) of what each task finds for the spans of a block
    of anchors: (ids, labels, matrix, spans per anchor as (k, low, high))."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, labels, matrix, limits = shared_value(block)
        spans = [[Span(*s) for s in of] for of in limits]
        for ids, classes, columns in vertical_blocks(batches, block_rows, scale):
            anchors, columns = same_height(matrix, columns)
            exact = fits(anchors, columns)
            low, high = columns.min(axis=1), columns.max(axis=1)
            for i, anchor in enumerate(anchors):
                if not spans[i]:
                    continue
                bitmap = ((classes == labels[i]) == same_label) & (ids != own[i])
                if exact:
                    scan_block(anchor, columns, low, high, bitmap, ids, spans[i])
                    continue
                scores = big_scores(anchor, columns[:, bitmap])
                for span in spans[i]:
                    span.add(scores, ids[bitmap])
        flat = [s for of in spans for s in of]
        sizes = [len(s.best.ids) for s in flat]
        none = np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(flat)), sizes)),
             pa.array(np.concatenate([none, *[s.best.ids for s in flat]])),
             pa.array(np.concatenate([none, *[s.best.scores for s in flat]]))], ["span", "id", "score"])

    return candidates.mapInArrow(run, "span long, id long, score long")


def mine(rows: DataFrame, is_anchor: Column, low: int = 30, high: int = 90, n_positives: int = 5,
         n_negatives: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         scale: float = SCALE, anchor_rows: int = ANCHOR_ROWS, anchor_cells: int = ANCHOR_CELLS,
         block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): for every row that satisfies ``is_anchor`` (an
    expression on ``rows``) and each of its first positives, the first
    negatives with low * positive_score <= 100 * score <= high * positive_score."""
    spark = rows.sparkSession
    candidates = vector_rows(rows, id_col, vector_col, label_col, scale)
    anchors = packed(vector_rows(rows.where(is_anchor), id_col, vector_col, label_col, scale), scale)
    folder = scratch_path(spark, "hard-negatives")
    schema = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
              "negative_score long")
    spark.createDataFrame([], schema).write.parquet(folder)
    for own, labels, matrix in query_blocks(anchors, anchor_rows, anchor_cells):
        block = share(spark, (own, labels, matrix, [[(n_positives,)]] * len(own)))
        # a few rows for each anchor of the block
        found = first_ranks(_scan(candidates, block, scale, block_rows, True), ["span"], "score", "id",
                            n_positives).orderBy("span", "rank").collect()
        block.destroy()
        pairs = [(r["span"], r["id"], r["score"]) for r in found]
        limits: list[list] = [[] for _ in own]
        for anchor, _, score in pairs:
            limits[anchor].append((n_negatives, -(-low * score // 100), high * score // 100))
        block = share(spark, (own, labels, matrix, limits))
        hard = first_ranks(_scan(candidates, block, scale, block_rows, False), ["span"], "score", "id", n_negatives)
        names = spark.createDataFrame(
            [(i, int(own[a]), p, s) for i, (a, p, s) in enumerate(pairs)],
            "span long, anchor_id long, positive_id long, positive_score long")
        hard.join(F.broadcast(names), "span").select(
            "anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(folder)
        block.destroy()
    return spark.read.schema(schema).parquet(folder)
