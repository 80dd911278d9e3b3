"""Whole-number vectors, packed rows and blocks of them.

Every component x becomes floor(scale * x), computed in doubles.  Scores are
inner products of these whole numbers: exact in doubles while their sums
stay below 2^53, in Python integers beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EXACT = 2.0 ** 53
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def vector_rows(rows: DataFrame, id_col: str, vector_col: str, label_col: str | None, scale: float) -> DataFrame:
    """(id, label, vec) of the rows that take part: the id is there, the
    vector is there with every component finite (also when scaled) and, if
    labels are asked for, so is the label."""
    whole = F.forall("vec", lambda x: F.coalesce(F.abs(x * F.lit(float(scale))) < F.lit(float("inf")), F.lit(False)))
    label = F.col(f"`{label_col}`").cast("long") if label_col else F.lit(0).cast("long")
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.alias("label"),
                       F.col(f"`{vector_col}`").cast("array<double>").alias("vec")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & whole)


def floored(column: pa.Array, scale: float) -> np.ndarray:
    """(rows, dimensions) of a list column; shorter vectors end in zeros."""
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale) + 0.0     # no negative zero
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def packed(rows: DataFrame, scale: float) -> DataFrame:
    """(id, label, vec binary): the distinct rows, floored, as doubles
    without the zeros at the end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.trim_zeros(v, "b").tobytes() for v in floored(batch.column(2), scale)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())],
                                             ["id", "label", "vec"])
    return rows.mapInArrow(run, "id long, label long, vec binary").distinct()


def query_blocks(frame: DataFrame, rows: int, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, matrix) of the packed rows, a block at a time: at most
    ``rows`` rows and ``cells`` components (one row at least).  The driver
    holds one block and the partition it reads from."""
    held: list = []
    width = 0
    for r in frame.toLocalIterator():
        width = max(width, len(r["vec"]) // 8)
        if held and (len(held) >= rows or (len(held) + 1) * width > cells):
            yield _block(held)
            held, width = [], len(r["vec"]) // 8
        held.append((r["id"], r["label"], r["vec"]))
    if held:
        yield _block(held)


def _block(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vectors = [np.frombuffer(v) for _, _, v in held]
    out = np.zeros((len(held), max(map(len, vectors), default=0)))
    for row, v in zip(out, vectors):
        row[:len(v)] = v
    return np.array([h[0] for h in held], dtype=np.int64), np.array([h[1] for h in held], dtype=np.int64), out


def vertical_blocks(batches: Iterator[pa.RecordBatch], rows: int, scale: float) -> Iterator[tuple]:
    """(ids, labels, matrix with a row per dimension) of at most ``rows``
    candidates."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            part = batch.slice(lo, rows)
            yield (part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False),
                   np.ascontiguousarray(floored(part.column(2), scale).T))


def same_height(queries: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Queries (a row each) and candidates (a column each) with as many
    dimensions; missing ones are zero."""
    d = max(queries.shape[1], columns.shape[0])
    if queries.shape[1] < d:
        queries = np.pad(queries, ((0, 0), (0, d - queries.shape[1])))
    if columns.shape[0] < d:
        columns = np.pad(columns, ((0, d - columns.shape[0]), (0, 0)))
    return queries, columns


def fits(queries: np.ndarray, columns: np.ndarray) -> bool:
    """Whether no partial sum can leave the whole numbers a double holds."""
    top = np.abs(queries).max(initial=0.0) * np.abs(columns).max(initial=0.0) * max(1, len(columns))
    return bool(top < EXACT)


def big_scores(query: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Scores in Python integers, held within a long."""
    q = [int(x) for x in query]
    found = [sum(a * int(b) for a, b in zip(q, c)) for c in columns.T]
    return np.array([min(max(s, LONG_MIN), LONG_MAX) for s in found], dtype=object)


class Best:
    """The ``k`` first distinct (score, id) pairs seen, higher scores first,
    ties by smaller id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    @property
    def floor(self) -> float:
        """What a score must reach to enter."""
        return self.scores[-1] if len(self.scores) == self.k else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(ids):
            return
        scores = np.concatenate([self.scores, scores.astype(np.int64)])
        ids = np.concatenate([self.ids, ids])
        order = np.lexsort((ids, ~scores))
        scores, ids = scores[order], ids[order]
        new = np.ones(len(ids), dtype=bool)
        new[1:] = (scores[1:] != scores[:-1]) | (ids[1:] != ids[:-1])
        self.scores, self.ids = scores[new][:self.k], ids[new][:self.k]


def first_ranks(found: DataFrame, group: list[str], score: str, tie: str, k: int) -> DataFrame:
    """Of each group the ``k`` first distinct (score, id) pairs with their
    rank; tasks have kept no more than ``k`` each."""
    order = Window.partitionBy(*group).orderBy(F.desc(score), tie)
    return found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).dropDuplicates(
        [*group, "rank"])
