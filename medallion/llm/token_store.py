"""Token ids in binary files.

Every document's ids, the end id last, are serialised as little-endian
integers and compressed alone against one shared zstandard dictionary, so a
short document can be read without its neighbours.

Files under one folder, all written and read by Spark:

``dictionary/``  one row: ``dict_hash`` (SHA-256 of the dictionary, hex),
    ``dictionary``, ``width`` (bytes of an id: 2 or 4), ``end_id``.
``shards/``  rows in ascending document order: ``part``, ``seq``,
    ``dict_hash``, ``blob`` (frames in a row), and per document ``doc_ids``,
    ``ends`` (byte after its frame), ``n_tokens``, ``starts`` (ids before it
    in the shard); parts are ranges of id and text, a shard ends after ``shard_bytes``.
``offsets/``  one row per shard: ``part``, ``seq``, ``first_doc``,
    ``last_doc``, ``base`` (ids before the shard).

A reader checks ``dict_hash`` against the dictionary it holds.

Defined cases: a null text is an empty one (its frame holds the end id
alone); null ids come first; rows of one id are ordered by their texts'
XXH64, then by text, and stay repeated; strings of special tokens are taken
as the library takes them by default (one id); with too little text to train on, the dictionary is raw content, and empty for an empty
table, which gives files without rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chunks import LibraryEncoder
from .common import id_text, process_cache, text_slices, texts_of

END_ID = 0
SAMPLE_DOCS = 2000          # documents the dictionary is trained on, at most
DICTIONARY_BYTES = 64 << 10
SHARD_BYTES = 1 << 20
LEVEL = 3
MAX_CACHED = 500_000        # chunks a process keeps


def _encoder(vocabulary: bytes) -> LibraryEncoder:
    """One per process and vocabulary."""
    key, cache = hashlib.sha256(vocabulary).digest(), process_cache()
    if key not in cache:
        cache[key] = LibraryEncoder(vocabulary, MAX_CACHED)
    return cache[key]


def _vocabulary(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _ids(part: pa.RecordBatch, encoder: LibraryEncoder, end_id: int) -> list[np.ndarray]:
    ids, lengths = encoder.encode(texts_of(part))
    return [np.append(own, end_id) for own in np.split(ids, np.cumsum(lengths)[:-1])]


def train_dictionary(docs: DataFrame, vocabulary, width: int, end_id: int,
                     sample_docs: int, dictionary_bytes: int) -> bytes:
    """A dictionary from serialised id arrays of at most ``sample_docs``
    documents (the lowest hashes of the id), the first ``dictionary_bytes``
    of each; it only affects file size."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary.value)
        for part in text_slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(
                [a.astype(f"<u{width}").tobytes()[:dictionary_bytes] for a in _ids(part, encoder, end_id)],
                pa.binary())], ["raw"])

    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    raw = [r["raw"] for r in docs.join(F.broadcast(ids), "doc_id").select("doc_id", "text").mapInArrow(
        run, "raw binary").limit(sample_docs).collect()]
    raw.sort()
    try:
        return zstandard.train_dictionary(dictionary_bytes, raw).as_bytes()
    except zstandard.ZstdError:
        return b"".join(raw)[:dictionary_bytes]


def _dictionary(data: bytes):
    import zstandard
    return zstandard.ZstdCompressionDict(data) if data else None


def write(docs: DataFrame, folder: str, vocabulary_path: str, n_vocabulary: int, end_id: int = END_ID,
          id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS,
          dictionary_bytes: int = DICTIONARY_BYTES, shard_bytes: int = SHARD_BYTES, level: int = LEVEL) -> None:
    """Encode every whole text and write the files described above."""
    spark = docs.sparkSession
    docs = id_text(docs, id_col, text_col)
    vocabulary = _vocabulary(spark, vocabulary_path)
    width = 2 if n_vocabulary <= 1 << 16 else 4
    dictionary = train_dictionary(docs, vocabulary, width, end_id, sample_docs, dictionary_bytes)
    dict_hash = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(dict_hash, dictionary, width, end_id)],
                          "dict_hash string, dictionary binary, width int, end_id int").coalesce(1).write.parquet(
        f"{folder}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("dict_hash", pa.string()),
                        ("blob", pa.binary()), ("doc_ids", pa.list_(pa.int64())),
                        ("ends", pa.list_(pa.int32())), ("n_tokens", pa.list_(pa.int32())),
                        ("starts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder = _encoder(vocabulary.value)
        compressor = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(shared.value))
        part_no, seq = TaskContext.get().partitionId(), 0
        frames, doc_ids, counts, held = [], [], [], 0

        def shard() -> pa.RecordBatch:
            n = np.array(counts, dtype=np.int64)
            return pa.RecordBatch.from_pylist([{
                "part": part_no, "seq": seq, "dict_hash": dict_hash, "blob": b"".join(frames),
                "doc_ids": doc_ids, "ends": np.cumsum([len(f) for f in frames]).tolist(),
                "n_tokens": counts, "starts": (np.cumsum(n) - n).tolist()}], schema)

        for part in text_slices(batches, 2 << 20):
            for doc_id, ids in zip(part.column(0).to_pylist(), _ids(part, encoder, end_id)):
                frames.append(compressor.compress(ids.astype(f"<u{width}").tobytes()))
                doc_ids.append(doc_id)
                counts.append(len(ids))
                held += len(frames[-1])
                if held >= shard_bytes:
                    yield shard()
                    frames, doc_ids, counts, held, seq = [], [], [], 0, seq + 1
        if frames:
            yield shard()

    # ranges of id and text (its hash: no text goes to the driver's sample): rows of one id, or without one, are not one range
    order = ["doc_id", F.xxhash64("text")]
    ordered = docs.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    ordered.mapInArrow(run, "part int, seq int, dict_hash string, blob binary, doc_ids array<long>, "
                            "ends array<int>, n_tokens array<int>, starts array<long>").write.option(
        "compression", "none").parquet(f"{folder}/shards")

    # ids before each part (as many rows as partitions), then before each shard
    sums = spark.read.parquet(f"{folder}/shards").select(
        "part", "seq", F.element_at("doc_ids", 1).alias("first_doc"), F.element_at("doc_ids", -1).alias("last_doc"),
        (F.element_at("starts", -1) + F.element_at("n_tokens", -1)).alias("total"))
    before = W.rowsBetween(W.unboundedPreceding, -1)
    parts = sums.groupBy("part").agg(F.sum("total").alias("part_total")).withColumn(
        "part_base", F.coalesce(F.sum("part_total").over(before.orderBy("part")), F.lit(0))).drop("part_total")
    inside = F.coalesce(F.sum("total").over(before.partitionBy("part").orderBy("seq")), F.lit(0))
    sums.withColumn("inside", inside).join(parts, "part").select(
        "part", "seq", "first_doc", "last_doc", (F.col("part_base") + F.col("inside")).alias("base")).write.parquet(
        f"{folder}/offsets")


def _open_dictionary(spark: SparkSession, folder: str):
    row = spark.read.parquet(f"{folder}/dictionary").first()
    if hashlib.sha256(row["dictionary"]).hexdigest() != row["dict_hash"]:
        raise ValueError("the dictionary does not have the hash written beside it")
    return row


def read(spark: SparkSession, folder: str, shards: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, ids array<long>) of all documents of the files (or of
    some of their shards)."""
    return _decoded(spark, folder, shards, "ids array<long>", pa.list_(pa.int64()),
                    lambda ids: ids.astype(np.int64))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: the checksum is
    over the ids read back, as little-endian unsigned 32-bit integers."""
    return _decoded(spark, folder, None, "n_tokens long, ids_crc32 long",
                    pa.struct([("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]),
                    lambda ids: {"n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())})


def _decoded(spark, folder, shards, fields, kind, value) -> DataFrame:
    info = _open_dictionary(spark, folder)
    dict_hash, width = info["dict_hash"], info["width"]
    shared = spark.sparkContext.broadcast(bytes(info["dictionary"]))
    shards = spark.read.parquet(f"{folder}/shards") if shards is None else shards
    based = shards.join(spark.read.parquet(f"{folder}/offsets").select("part", "seq", "base"), ["part", "seq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(shared.value))
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["dict_hash"] != dict_hash:
                    raise ValueError(f"shard {row['part']}/{row['seq']} was written with another dictionary")
                blob, values = memoryview(row["blob"]), []
                for lo, hi in zip([0, *row["ends"]], row["ends"]):
                    values.append(value(np.frombuffer(decompressor.decompress(blob[lo:hi]), dtype=f"<u{width}")))
                column = pa.array(values, kind)
                out = [pa.array(row["doc_ids"], pa.int64()),
                       pa.array(np.array(row["starts"], dtype=np.int64) + row["base"])]
                out += column.flatten() if pa.types.is_struct(kind) else [column]
                yield pa.RecordBatch.from_arrays(
                    out, ["doc_id", "start", *(f.split()[0] for f in fields.split(", "))])

    return based.select("part", "seq", "dict_hash", "blob", "doc_ids", "ends", "starts", "base").mapInArrow(
        run, f"doc_id long, start long, {fields}")


def lookup(spark: SparkSession, folder: str, doc_id: int) -> DataFrame:
    """The rows of one document: the shard is found in the offsets, its place
    in the shard's own arrays, and only its frame is decompressed."""
    # a shard that begins with null ids has no first id: they come before all others
    hits = spark.read.parquet(f"{folder}/offsets").where(
        (F.col("first_doc").isNull() | (F.col("first_doc") <= doc_id)) & (F.col("last_doc") >= doc_id)).select(
        "part", "seq")
    shards = spark.read.parquet(f"{folder}/shards").join(hits, ["part", "seq"])
    place = F.explode(F.filter(F.sequence(F.lit(1), F.size("doc_ids")),
                               lambda i: F.element_at("doc_ids", i) == doc_id))
    one = shards.where(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).withColumn("i", place)
    begin = F.when(F.col("i") > 1, F.element_at("ends", F.col("i") - 1)).otherwise(0)
    return read(spark, folder, one.select(
        "part", "seq", "dict_hash",
        F.substring("blob", begin + 1, F.element_at("ends", F.col("i")) - begin).alias("blob"),
        F.array(F.lit(doc_id).cast("long")).alias("doc_ids"),
        F.array(F.element_at("ends", F.col("i")) - begin).alias("ends"),
        F.array(F.element_at("starts", F.col("i"))).alias("starts")))
