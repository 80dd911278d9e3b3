"""Document fingerprints by SimHash, in DataFrame functions only.

Terms are pairs of neighbouring words; each term's 64-bit hash votes on the
64 bits of the fingerprint with the term's length as weight, a set bit for
and a clear bit against; a bit is set if its signed sum is positive.  The
votes are sums of a grouping whose rows already lie together, so no text or
term is shuffled for them.

Fingerprints within a Hamming radius ``r`` are found with permuted block
tables: the bits are cut into ``r + 2`` blocks, of which two stay equal
whatever ``r`` bits differ, so a table per pair of blocks, keyed by their
values, brings together every pair within the radius.

Defined cases: a null text is an empty one, whose only term is the empty
word; a null id comes before all others; rows of one id are ordered by text,
each with a result of its own; the document after the last is the first (a
single one follows itself); an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_text, staged

RADIUS = 3
BITS = 64
BUCKETS_PER_PARTITION = 8


# ---- fingerprints

def _terms(words: Column) -> Column:
    """array<struct<hash, weight>> of neighbouring words (the last alone)."""
    after = F.slice(words, 2, F.size(words))
    return F.zip_with(words, after, lambda a, b: F.struct(
        F.xxhash64(a, b).alias("hash"), (F.char_length(a) + 1).cast("long").alias("weight")))


def _votes(hash_: Column, weight: Column) -> list[Column]:
    """Sums of the weights of set bits, two 32-bit counters to a long, and of
    all weights (at most the length of a text, so no counter overflows)."""
    pair = F.lit((1 << 32) | 1)
    return [F.sum(F.shiftrightunsigned(hash_, i).bitwiseAND(pair) * weight).alias(f"v{i}")
            for i in range(BITS // 2)] + [F.sum(weight).alias("total")]


def _signs() -> Column:
    """The fingerprint: a bit is set if more weight voted for it than against."""
    low = F.lit((1 << 32) - 1)
    fp = F.lit(0).cast("long")
    for i in range(BITS // 2):
        for bit, votes in ((i, F.col(f"v{i}").bitwiseAND(low)), (i + 32, F.shiftrightunsigned(f"v{i}", 32))):
            mask = 1 << bit if bit < 63 else -(1 << 63)
            fp = fp.bitwiseOR(F.when(votes * 2 > F.col("total"), F.lit(mask).cast("long")).otherwise(
                F.lit(0).cast("long")))
    return fp


def fingerprint_texts(rows: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, fp) of every row; the keys must tell the rows apart.  Rows that
    are partitioned by any of the keys are not shuffled again."""
    words = rows.select(*keys, F.split(F.lower(F.col(text_col)), r"\s+").alias("words"))
    terms = words.select(*keys, F.explode(_terms(F.col("words"))).alias("term")).select(
        *keys, F.col("term.hash").alias("hash"), F.col("term.weight").alias("weight"))
    votes = terms.groupBy(*keys).agg(*_votes(F.col("hash"), F.col("weight")))
    return votes.select(*keys, _signs().alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


# ---- the document after each one

def id_bucket(doc_id: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below the id, searched in two steps; -1 for a
    null id."""
    if not bounds:
        return F.when(doc_id.isNull(), -1).otherwise(0)
    step = max(1, int(len(bounds) ** 0.5))
    cuts = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    below = lambda values: F.size(F.filter(values, lambda b: b <= doc_id))
    block = below(longs([c[0] for c in cuts]))
    inside = below(F.element_at(F.array(*[longs(c) for c in cuts]), F.greatest(block, F.lit(1))))
    found = F.when(block == 0, 0).otherwise((block - 1) * step + inside)
    return F.when(doc_id.isNull(), -1).otherwise(found).cast("int")


def in_order(docs: DataFrame) -> DataFrame:
    """(bucket, rn, doc_id, text, next_text) of (doc_id, text): the texts are
    shuffled once, into ranges of ids; the first text of each range, at most
    one per range, is brought to the range before it."""
    spark = docs.sparkSession
    n = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * max(n, 1000))).first()[0]
    bounds = sorted(set(cuts or []))
    bucket = id_bucket(F.col("doc_id"), bounds)
    # one row per range: as many as the shuffle has partitions, times a constant
    firsts = sorted((r["bucket"], r["first"]) for r in ids.groupBy(bucket.alias("bucket")).agg(
        F.min("doc_id").alias("first")).collect())
    after = [(b, *firsts[(i + 1) % len(firsts)]) for i, (b, _) in enumerate(firsts)]
    pairs = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(nb).alias("next_bucket"),
                               F.lit(f).cast("long").alias("next_id")) for b, nb, f in after])
    borders = spark.range(1).select(F.inline(pairs)) if after else spark.range(0).select(
        F.lit(0).alias("bucket"), F.lit(0).alias("next_bucket"), F.col("id").alias("next_id"))

    placed = docs.withColumn("bucket", bucket)
    order = W.partitionBy("bucket").orderBy("doc_id", "text")
    rows = placed.withColumn("rn", F.row_number().over(order)).withColumn("after", F.lead("text").over(order))
    heads = docs.join(F.broadcast(borders), F.col("doc_id").eqNullSafe(F.col("next_id"))).groupBy(
        "bucket").agg(F.min("text").alias("border_text"))
    return rows.join(heads, "bucket", "left").select(
        "bucket", "rn", "doc_id", "text", F.coalesce("after", "border_text").alias("next_text"))


def edited_text(text: Column, next_text: Column) -> Column:
    """The second half of the code points replaced by the first of the next text."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half),
                    F.substring(next_text, F.lit(1), half))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, rn, doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp):
    one row per input row, in order of (bucket, rn)."""
    docs = id_text(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = in_order(docs).withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    both = rows.select("bucket", "rn", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.inline(F.array(
        F.struct(F.lit(0).alias("version"), F.col("text").alias("body"), F.lit("").alias("sha")),
        F.struct(F.lit(1).alias("version"), F.col("edited").alias("body"),
                 F.sha2(F.col("edited").cast("binary"), 256).alias("sha")))))
    keys = ["bucket", "rn", "version", "doc_id", "n_chars", "sha"]
    found = fingerprint_texts(both, keys, "body")
    of = lambda v: F.max(F.when(F.col("version") == v, F.col("fp")))
    single = staged(found.groupBy("bucket", "rn", "doc_id", "n_chars").agg(
        F.max("sha").alias("edited_sha256"), of(0).alias("fp"), of(1).alias("edited_fp")), "fingerprints")

    # the next fingerprint: inside the range, or the first of the range after
    order = W.partitionBy("bucket").orderBy("rn")
    first = single.where("rn = 1").select("bucket", "fp")
    whole = W.orderBy("bucket")               # one row per range
    wrap = F.first("fp").over(whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    border = first.select("bucket", F.coalesce(F.lead("fp").over(whole), wrap).alias("border_fp"))
    led = single.withColumn("after", F.lead("fp").over(order))
    return led.join(border, "bucket").withColumn("next_fp", F.coalesce("after", "border_fp")).drop(
        "after", "border_fp")


# ---- neighbours

def block_masks(radius: int) -> list[int]:
    """The bits of each table's two blocks, as signed longs."""
    n = radius + 2
    edges = [i * BITS // n for i in range(n + 1)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    masks = [a | b for a, b in itertools.combinations(blocks, 2)]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]


def near_fingerprints(queries: DataFrame, corpus: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(query, fp): every pair of a fingerprint in ``queries`` and one in
    ``corpus`` (columns ``fp``, distinct) that differ in ``radius`` or fewer
    bits, once.  A pair that meets in several tables counts in the first."""
    masks = block_masks(radius)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).cast("long").alias("mask"))
                       for t, m in enumerate(masks)])

    def tabled(fps: DataFrame, name: str) -> DataFrame:
        return fps.select(F.col("fp").alias(name), F.inline(tables)).select(
            name, "t", F.col(name).bitwiseAND(F.col("mask")).alias("key"))

    q, c = tabled(queries, "query").alias("q"), tabled(corpus, "fp").alias("c")
    differ = F.col("query").bitwiseXOR(F.col("fp"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(t))
                         for t, m in enumerate(masks)])
    return q.join(c, (F.col("q.t") == F.col("c.t")) & (F.col("q.key") == F.col("c.key")) &
                  (F.bit_count(differ) <= radius) & (first == F.col("q.t"))).select("query", "fp")


def near_counts(fps: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(query, n_near): rows of ``fps`` within the radius of each distinct
    fingerprint of ``queries``; copies are counted, never paired."""
    classes = fps.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    pairs = near_fingerprints(queries.select("fp").distinct(), classes.select("fp"), radius)
    return pairs.join(classes, "fp").groupBy("query").agg(F.sum("n").alias("n_near"))
