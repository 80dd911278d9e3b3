"""Document fingerprints and block tables against brute force."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from medallion.llm import fingerprints as P
from medallion.llm.queries import QUERIES
from tests.llm.conftest import EDGE_ROWS, by_key, rows_of


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def plain_fingerprints(spark, texts):
    """Signed votes of term hashes, counted in Python."""
    words = {t: re.split(r"\s+", t.lower()) for t in texts}
    # java's split keeps an empty word at an end too
    pairs = {(a, b) for ws in words.values() for a, b in zip(ws, [*ws[1:], None])}
    hashed = {(a, b): h for a, b, h in rows_of(spark.createDataFrame(
        sorted(pairs, key=repr), "a string, b string").select("a", "b", F.xxhash64("a", "b")))}
    out = {}
    for t, ws in words.items():
        votes = [0] * 64
        for a, b in zip(ws, [*ws[1:], None]):
            for bit in range(64):
                votes[bit] += (1 if hashed[a, b] >> bit & 1 else -1) * (len(a) + 1)
        out[t] = signed(sum(1 << bit for bit in range(64) if votes[bit] > 0))
    return out


def test_against_brute_force(spark, edge_docs):
    rows = sorted(((i, t or "") for i, t in EDGE_ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = []
    edited = []
    for n, (i, t) in enumerate(rows):
        after, half = rows[(n + 1) % len(rows)][1], len(t) // 2
        edited.append(t[:len(t) - half] + after[:half])
    fps = plain_fingerprints(spark, {t for _, t in rows} | set(edited))
    for n, ((i, t), e) in enumerate(zip(rows, edited)):
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fps[t], fps[e],
                     fps[rows[(n + 1) % len(rows)][1]]))
    got = [r[2:] for r in rows_of(P.document_fingerprints(edge_docs))]
    assert by_key(got) == by_key(want)


def test_single_document_follows_itself(spark):
    row = P.document_fingerprints(spark.createDataFrame([(7, "abcdef ghi")], "doc_id long, text string")).first()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdeabcde").hexdigest() and row["fp"] == row["next_fp"]


def test_empty_table(no_docs):
    assert rows_of(P.document_fingerprints(no_docs)) == []


def test_buckets_follow_the_bounds(spark):
    bounds = sorted(random.Random(1).sample(range(-1000, 1000), 37))
    ids = spark.range(-1100, 1100).select(F.col("id"), P.id_bucket(F.col("id"), bounds).alias("b"))
    assert all(b == sum(x <= i for x in bounds) for i, b in rows_of(ids))
    assert spark.range(1).select(P.id_bucket(F.lit(None).cast("long"), bounds)).first()[0] == -1


def test_block_tables_find_every_pair_once(spark):
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(50)}
    for v in list(values):
        for _ in range(6):
            w = v
            for bit in rng.sample(range(64), rng.randint(0, 6)):
                w ^= 1 << bit
            values.add(w)
    values |= {0, (1 << 64) - 1}
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    for radius in (0, 2, 3):
        got = rows_of(P.near_fingerprints(fps, fps, radius))
        want = {(signed(a), signed(b)) for a in values for b in values if (a ^ b).bit_count() <= radius}
        assert len(got) == len(want) and set(got) == want


def test_near_counts_count_copies(spark):
    fps = spark.createDataFrame([(5,), (5,), (5,), (4,), (1 << 40,)], "fp long")
    assert rows_of(P.near_counts(fps, fps.where("fp = 5"), 1)) == [(5, 4)]


def test_masks_cover_the_radius():
    for radius in (1, 3, 5):
        masks = P.block_masks(radius)
        for _ in range(300):
            flips = sum(1 << b for b in random.Random(_).sample(range(64), radius))
            assert any(flips & (m & (1 << 64) - 1) == 0 for m in masks)


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op6_fingerprints"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_half_kept_is_nearer_than_another_document(spark):
    rows = rows_of(QUERIES["op6_fingerprints"](spark, "/root/testdata/sf0.001").select("near_edited", "near_next"))
    assert sum(a > b for a, b in rows) > 0.85 * len(rows)
