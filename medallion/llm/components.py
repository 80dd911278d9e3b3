"""Connected components of an edge table by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _star(pairs: DataFrame, low: DataFrame) -> DataFrame:
    """Each neighbour of a node pointed at the smallest node near it.

    The minimum of a node is a partial aggregate and the way back a plain
    join, so a node with very many neighbours is never one task's group.
    """
    m = low.groupBy("u").agg(F.min("v").alias("m"))
    joined = pairs.join(m, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v); the root is
    the smallest node of the component.  Nodes are longs; loops and repeated
    edges are harmless, no edges give no rows.

    Rounds of large star and small star, each written to the shared folder,
    until the edge set stays the same; it is then a star per component.
    """
    cur = staged(edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-0")
    seen, round_no = _digest(cur), 0
    while seen[0]:
        round_no += 1
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        with_self = both.unionByName(both.select("u", F.col("u").alias("v")))
        # large star: larger neighbours of a node point at its smallest one
        large = _star(both.where("v > u"), with_self)
        # small star: a node and its smaller neighbours point at the smallest
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        small = _star(down.unionByName(down.select("u", F.col("u").alias("v"))), down)
        cur = staged(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                     f"cc-{round_no}")
        now = _digest(cur)
        if now == seen:
            break
        seen = now
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
