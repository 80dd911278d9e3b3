"""Token files: exact round trip, offsets, checksums, short-document access."""

import zlib

import numpy as np
import pytest
import xxhash
import public_tokenizers as P
from tokenizers import Tokenizer

from medallion.llm import token_store as T
from medallion.session import scratch_path

from tests.llm.conftest import EDGE_ROWS, rows_of

PATH = P.path("byte_bpe_50k.json")


def lists(encoded):
    ids, lengths = encoded
    return [a.tolist() for a in np.split(ids, np.cumsum(lengths)[:-1])]


def order(text):
    """Rows of one id come in the order of their texts' hashes."""
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


@pytest.fixture(scope="module")
def expected():
    tokenizer = Tokenizer.from_file(PATH)
    rows = sorted(EDGE_ROWS, key=lambda r: (r[0] is not None, r[0] or 0, order(r[1]), (r[1] or "").encode()))
    out, start = [], 0
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((i, start, ids))
        start += len(ids)
    return out


@pytest.fixture(scope="module", params=[200, 1 << 20])
def folder(request, spark, edge_docs):
    path = scratch_path(spark, "token-test")
    T.write(edge_docs, path, PATH, 50257, shard_bytes=request.param)
    return path


def test_ids_come_back(spark, folder, expected):
    got = [(i, s, list(ids)) for i, s, ids in rows_of(T.read(spark, folder))]
    assert sorted(got, key=lambda r: r[1]) == expected


def test_digests(spark, folder, expected):
    want = [(i, s, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())) for i, s, ids in expected]
    assert sorted(rows_of(T.digests(spark, folder)), key=lambda r: r[1]) == want


def test_lookup_of_single_documents(spark, folder, expected):
    for doc_id in (-5, 2, 9, 13, 99):
        got = [(i, s, list(ids)) for i, s, ids in rows_of(T.lookup(spark, folder, doc_id))]
        assert sorted(got, key=lambda r: r[1]) == [r for r in expected if r[0] == doc_id]


def test_width_and_hash_are_written(spark, folder):
    row = spark.read.parquet(f"{folder}/dictionary").first()
    assert row["width"] == 2 and row["end_id"] == 0
    assert {r[0] for r in rows_of(spark.read.parquet(f"{folder}/shards").select("dict_hash"))} == {row["dict_hash"]}


def test_shard_of_another_dictionary_is_refused(spark, folder):
    from pyspark.sql import functions as F
    other = spark.read.parquet(f"{folder}/shards").withColumn("dict_hash", F.lit("0" * 64))
    with pytest.raises(Exception, match="another dictionary"):
        T.read(spark, folder, other).collect()


def test_empty_table(spark, no_docs):
    path = scratch_path(spark, "token-empty")
    T.write(no_docs, path, PATH, 50257)
    assert rows_of(T.digests(spark, path)) == []


def test_wide_ids(spark, edge_docs, expected):
    path = scratch_path(spark, "token-wide")
    T.write(edge_docs, path, PATH, 1 << 20)
    assert sorted((i, s, list(ids)) for i, s, ids in rows_of(T.read(spark, path)) if i is not None) == sorted(
        r for r in expected if r[0] is not None)


def test_strings_of_special_tokens_as_the_library_takes_them(spark):
    tokenizer = Tokenizer.from_file(PATH)
    texts = ["a<|endoftext|>b", "<|endoftext|>", "one <|endoftext|> two  three", "<|endoftext|", "x<|endoftext|><|endoftext|> "]
    own = T._encoder(open(PATH, "rb").read())
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 50256, 65] and lists(own.encode(texts)) == want


def test_lines_and_odd_spaces_as_the_library():
    import random
    tokenizer = Tokenizer.from_file(PATH)
    own, rng = T._encoder(open(PATH, "rb").read()), random.Random(8)
    pieces = ["word", "end.", "a,", "\n", "\r\n", " ", "  ", "\t", "\x85", "\xa0", "é", "漢", "\x02", "\x05", "\x1f", "42", "'s",
              ", ", ". ", ".\n", "!", "\u2028", "Next"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(12))) for _ in range(4000)]
    assert lists(own.encode(texts)) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    # with a space in front; an empty text stays one without ids
    assert lists(own.encode(texts, spaced=True)) == [
        e.ids if t else [] for t, e in zip(texts, tokenizer.encode_batch([" " + t for t in texts], add_special_tokens=False))]


def test_rows_without_an_id_are_more_than_one_range(spark):
    rows = [(None, f"text number {i}") for i in range(3000)] + [(i, "x") for i in range(100)]
    path = scratch_path(spark, "token-hot")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        T.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), path, PATH, 50257)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    shards = spark.read.parquet(f"{path}/shards").selectExpr("part", "size(filter(doc_ids, x -> x is null)) AS n")
    assert shards.groupBy("part").sum("n").where("`sum(n)` > 0").count() > 3
    assert T.digests(spark, path).where("doc_id is null").count() == 3000
