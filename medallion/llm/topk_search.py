"""Exact top-k search by inner product: columnar branch and bound.

Each task lays its candidates out vertically, a row per dimension.  For a
query the scores are accumulated one block of dimensions at a time.  By
Cauchy and Schwarz what the remaining dimensions can still add is at most
the product of the remaining masses (norms) of query and candidate; those
that cannot reach the k-th best score any more leave, and the others close
up before the next block.  A task keeps k candidates a query; a window over
these gives the answer.

Queries come in blocks of a fixed size, each broadcast by itself and its
answers written, so neither side is ever whole in one place and a lost
executor repeats its tasks only.

Defined cases: rows with a null id, a null vector or a null or non-finite
component take no part; vectors of unlike length end in zeros; a candidate
with the query's id is its own and never an answer; candidates of a query
that agree in id and score count once; an id that comes with several vectors
is asked with each, and equal queries once; fewer than k candidates give
all; no queries or candidates give no rows; scores beyond a long are held
at its ends.  Extra columns are not read.
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
DIMENSIONS = 8              # accumulated between two bounds
BLOCK_ROWS = 8192           # candidates in one vertical block
QUERY_ROWS = 4096           # queries in one broadcast, at most
QUERY_CELLS = 1 << 22       # and components (32 MB)
AT_ONCE = 256               # queries whose first dimensions are one product
SLACK = 1.0                 # on bounds from rounded norms; scores are whole


def masses(columns: np.ndarray, edges: list[int]) -> np.ndarray:
    """Norm of what is left of every column from each edge on."""
    squares = np.add.reduceat(columns * columns, edges[:-1], axis=0) if len(columns) else np.zeros((0, columns.shape[1]))
    left = np.zeros((len(edges), columns.shape[1]))
    left[:-1] = np.cumsum(squares[::-1], axis=0)[::-1]
    return np.sqrt(left) * (1 + 1e-9)


def search_block(queries: np.ndarray, own: np.ndarray, columns: np.ndarray, ids: np.ndarray,
                 best: list[Best], step: int = DIMENSIONS) -> None:
    """Bring the candidates of one block into the queries' best lists."""
    queries, columns = same_height(queries, columns)
    if not fits(queries, columns):
        for q, me, kept in zip(queries, own, best):
            other = ids != me
            kept.add(big_scores(q, columns[:, other]), ids[other])
        return
    d = len(columns)
    edges = [*range(0, d, step), d]
    left, q_left = masses(columns, edges), masses(np.ascontiguousarray(queries.T), edges).T
    for lo in range(0, len(queries), AT_ONCE):
        first = queries[lo:lo + AT_ONCE, :step] @ columns[:step]
        for i, part in enumerate(first, lo):
            q, kept, alive = queries[i], best[i], np.flatnonzero(ids != own[i])
            part = part[alive]
            if len(kept.ids) < kept.k and len(alive) > 8 * kept.k:
                # whole scores of some that begin well set a first limit
                lead = alive[np.argpartition(part, -4 * kept.k)[-4 * kept.k:]]
                kept.add(q @ columns[:, lead], ids[lead])
            for b in range(1, len(edges)):
                reach = part + q_left[i, b] * left[b, alive] + SLACK >= kept.floor
                alive, part = alive[reach], part[reach]
                if b == len(edges) - 1 or not len(alive):
                    break
                at = slice(edges[b], edges[b + 1])
                part = part + q[at] @ columns[at, alive]
            kept.add(part, ids[alive])


def top_k(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: float = SCALE, query_rows: int = QUERY_ROWS, query_cells: int = QUERY_CELLS,
          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other rows of every
    row that satisfies ``is_query`` (an expression on ``rows``)."""
    spark = rows.sparkSession
    candidates = vector_rows(rows, id_col, vector_col, None, scale)
    queries = packed(vector_rows(rows.where(is_query), id_col, vector_col, None, scale), scale)
    folder, schema = scratch_path(spark, "top-k"), "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(folder)
    for own, _, matrix in query_blocks(queries, query_rows, query_cells):
        block = share(spark, (own, matrix))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            own, matrix = shared_value(block)
            best = [Best(k) for _ in own]
            for ids, _, columns in vertical_blocks(batches, block_rows, scale):
                search_block(matrix, own, columns, ids, best)
            sizes = [len(b.ids) for b in best]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(own)), sizes)), pa.array(np.repeat(own, sizes)),
                 pa.array(np.concatenate([b.ids for b in best])),
                 pa.array(np.concatenate([b.scores for b in best]))], ["query", "query_id", "vec_id", "score"])

        found = candidates.mapInArrow(run, "query long, query_id long, vec_id long, score long")
        first_ranks(found, ["query"], "score", "vec_id", k).select(
            "query_id", F.col("rank").cast("int"), "vec_id", "score").write.mode("append").parquet(folder)
        block.destroy()
    return spark.read.schema(schema).parquet(folder)
