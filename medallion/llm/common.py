"""Helpers shared by the training-data operators.

Every operator reads two columns, an id and a text, under names of the
caller's choice; nothing else of the input flows through its plan, so extra
columns, whatever they are called, cannot clash with internal ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared folder and read it back.

    Cuts the lineage with files that outlive any executor: a task that is
    lost later is computed again from them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def process_cache() -> dict:
    """What tasks of one Python process keep from one another (tables built
    from a vocabulary).  It hangs on ``sys``: functions sent by value have
    module globals of their own in every task."""
    import sys
    return sys.__dict__.setdefault("_medallion_llm_cache", {})


def share(spark: SparkSession, value):
    """Broadcast an object whose class is defined here; the size of what is
    shared is bounded by the caller's parameters."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared_value(shared):
    return cloudpickle.loads(shared.value)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator needs, under fixed names (id as a long)."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"),
                       docs[text_col].cast("string").alias("text"))


def fold_remainder(id_column: Column, folds: int = 3) -> Column:
    """crc32 of the id written in decimal, modulo the number of folds."""
    return F.crc32(id_column.cast("string")) % F.lit(folds)


def text_slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of one piece stay near a bound
    (one longer text is a piece of its own)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
        sizes = np.zeros(n, dtype=np.int64)
        ends = np.frombuffer(col.buffers()[1], dtype=np.int64, count=n + col.offset + 1)[col.offset:]
        sizes[:] = np.diff(ends)
        total, start = 0, 0
        for i in range(n):
            if i > start and total + sizes[i] > max_bytes:
                yield batch.slice(start, i - start)
                total, start = 0, i
            total += sizes[i]
        yield batch.slice(start, n - start)


def column_list(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def texts_of(batch: pa.RecordBatch) -> list[str]:
    """The texts, null read as empty."""
    return [t or "" for t in column_list(batch, "text")]


def ragged_gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``values[starts[i]:starts[i] + lengths[i]]``."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    shift = np.repeat(starts - (ends - lengths), lengths)
    return values[np.arange(total, dtype=np.int64) + shift]
