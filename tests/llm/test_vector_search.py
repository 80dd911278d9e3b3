"""Top-k search and hard negatives against brute force over all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from medallion.llm import hard_negatives as H
from medallion.llm import topk_search as S
from medallion.llm.vectors import Best

from tests.llm.conftest import CLASHING, by_key, rows_of

SCHEMA = "vec_id long, embedding array<double>, label int, " + ", ".join(f"{c} string" for c in [
    *CLASHING, "id", "vec", "score", "rank", "query", "query_id", "span"])


def frame(spark, rows, parts=3):
    extra = ["?"] * (len(CLASHING) + 7)
    return spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA).repartition(parts)


def whole(v):
    out = [math.floor(256 * float(x)) for x in v]
    while out and not out[-1]:
        out.pop()
    return tuple(out)


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def usable(rows, labelled):
    return {(i, label if labelled else 0, whole(v)) for i, v, label in rows
            if i is not None and v is not None and (label is not None or not labelled)
            and all(x is not None and math.isfinite(x) for x in v)}


def best(pairs, k):
    return sorted(set(pairs), key=lambda p: (-p[0], p[1]))[:k]


def plain_top(rows, k=5, each=50):
    rows = usable(rows, False)
    return [(i, rank, j, s) for i, _, v in rows if i % each == 0
            for rank, (s, j) in enumerate(best([(dot(v, w), j) for j, _, w in rows if j != i], k), 1)]


def plain_mine(rows, each=100, low=30, high=90):
    rows, out = usable(rows, True), []
    for i, label, v in rows:
        if i % each:
            continue
        for ps, p in best([(dot(v, w), j) for j, c, w in rows if c == label and j != i], 5):
            hard = [(s, j) for j, c, w in rows if c != label and j != i
                    for s in [dot(v, w)] if low * ps <= 100 * s <= high * ps]
            out += [(i, p, rank, j, ps, s) for rank, (s, j) in enumerate(best(hard, 10), 1)]
    return out


def vectors(n, d, seed, labels=4):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(labels, d))
    out = []
    for i in range(n):
        v = heads[i % labels] + 0.7 * rng.normal(size=d)
        out.append((i, [float(x) for x in v / np.linalg.norm(v)], int(rng.integers(labels))))
    return out


def edge_vectors():
    nan, inf = float("nan"), float("inf")
    copies = [(7, [0.5, 0.5, 0.0], 1)] * 40                       # one row many times
    tied = [(i, [0.25, 0.25, 0.25], 2) for i in range(201, 215)]  # ties, to the smaller id
    return [*vectors(120, 3, 2), *copies, *tied, (300, None, 1), (301, [0.1, None, 0.2], 1), (302, [nan, 0.1, 0.1], 1),
            (303, [inf, 0.1, 0.1], 2), (None, [0.9, 0.9, 0.9], 1), (304, [0.3, 0.3, 0.3], None), (305, [], 2),
            (400, [0.6], 1), (400, [0.6, 0.1], 1), (400, [0.6], 1), (400, [0.6, 0.1, 0.2, 0.4], 2),
            (500, [0.0, 0.0, 0.0], 1), (-100, [-0.5, -0.5, -0.5], 2), (600, [0.5, 0.5, 0.1], 1), (700, [], 1)]


@pytest.mark.parametrize("block_rows", [7, 8192])
@pytest.mark.parametrize("query_rows", [2, 4096])
def test_top_k_edge_rows(spark, block_rows, query_rows):
    rows = edge_vectors()
    found = S.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, block_rows=block_rows, query_rows=query_rows)
    assert by_key(rows_of(found)) == by_key(plain_top(rows))


@pytest.mark.parametrize("block_rows", [7, 8192])
@pytest.mark.parametrize("anchor_rows", [2, 4096])
def test_hard_negatives_edge_rows(spark, block_rows, anchor_rows):
    rows = edge_vectors()
    found = H.mine(frame(spark, rows), F.col("vec_id") % 100 == 0, block_rows=block_rows, anchor_rows=anchor_rows)
    assert by_key(rows_of(found)) == by_key(plain_mine(rows))


def test_many_dimensions(spark):
    rows = vectors(900, 70, 5)
    data = frame(spark, rows, 4)
    assert by_key(rows_of(S.top_k(data, F.col("vec_id") % 50 == 0))) == by_key(plain_top(rows))
    assert by_key(rows_of(H.mine(data, F.col("vec_id") % 100 == 0))) == by_key(plain_mine(rows))


def test_sums_beyond_doubles(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(1 << 27)) + rng.random() for _ in range(6)], i % 2) for i in range(60)]
    data = frame(spark, rows)
    top = plain_top(rows)
    assert max(s for *_, s in top) > 1 << 62
    longest = (1 << 63) - 1
    # beyond a long, scores are held at its end and the smaller ids come first
    held = {(i, whole(v)): [(min(dot(whole(v), whole(w)), longest), j) for j, w, _ in rows if j != i]
            for i, v, _ in rows if i % 50 == 0}
    want = [(i, r, j, s) for (i, _), pairs in held.items() for r, (s, j) in enumerate(best(pairs, 5), 1)]
    assert by_key(rows_of(S.top_k(data, F.col("vec_id") % 50 == 0))) == by_key(want)


def test_empty_tables(spark):
    data = frame(spark, vectors(20, 3, 1)).limit(0)
    top, hard = S.top_k(data, F.col("vec_id") % 50 == 0), H.mine(data, F.col("vec_id") % 100 == 0)
    assert top.columns == ["query_id", "rank", "vec_id", "score"] and rows_of(top) == [] == rows_of(hard)
    assert rows_of(S.top_k(frame(spark, vectors(20, 3, 1)), F.lit(False))) == []


def test_bounds_shrink_the_candidates():
    """Clustered vectors: few candidates see the last dimensions."""
    rows = vectors(4000, 64, 9, labels=20)
    columns = np.floor(256 * np.array([v for _, v, _ in rows])).T
    ids = np.arange(len(rows))
    spans = [H.Span(10, 1.0)]
    H.scan_block(columns[:, 0].copy(), columns, columns.min(axis=1), columns.max(axis=1), ids != 0, ids, spans)
    found = Best(5)
    S.search_block(columns.T[:1], ids[:1], columns, ids, [found])
    scores = columns.T[0] @ columns
    order = [j for j in np.lexsort((ids, -scores)) if j]
    assert found.ids.tolist() == order[:5] and spans[0].best.ids.tolist() == order[:10]
