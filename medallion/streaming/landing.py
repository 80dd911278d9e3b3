"""Incremental form of the ingest (W1) with Structured Streaming.

The landing folder is read as a file stream; each run picks up only files
not seen before (the checkpoint keeps the list) and cleans the headers (P1).
``availableNow`` processes everything present and stops, so the job can be
scheduled like the batch ingest.

Spark may hand a micro-batch over again after a failure (at least once).
Both modes make that harmless:

* append: the table is partitioned by stream and batch, and a micro-batch
  overwrites its own partition (Spark's dynamic partition overwrite).  A
  replay writes the same partition again, so its rows count once.  Batch
  appends to the same table go to the partition without a stream, so both
  add up.  ``streamed_rows`` reads the table without the two columns.
* merge: the batch is upserted on its keys; a replay writes the same rows
  over themselves.  That holds only for rows that can match, so a NULL key
  or a NULL ``partition_by`` value is refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import clean_silver_names
from ..sinks import files
from ..sinks.upsert import upsert
from ..sinks.writers import DEFAULT_FORMAT, STREAM_COLUMNS, create_table, insert_table


def create_streamed(df: DataFrame, table: str, fmt: str = DEFAULT_FORMAT) -> None:
    """A table that streams and batch jobs append to; ``df`` are its first
    rows (of no stream)."""
    create_table(df.withColumns({c: F.lit(None).cast(t) for c, t in STREAM_COLUMNS.items()}), table, fmt,
                 list(STREAM_COLUMNS))


def streamed_rows(spark: SparkSession, table: str) -> DataFrame:
    """The rows of such a table without its layout columns."""
    return spark.table(table).drop(*STREAM_COLUMNS)


def append_once(batch: DataFrame, batch_id: int, table: str, stream: str) -> None:
    """Add a micro-batch, replacing what an earlier try of it left."""
    target = batch.sparkSession.table(table)
    if files.partition_columns(target) != list(STREAM_COLUMNS):
        raise ValueError(f"{table} is not laid out for streamed appends; make it with create_streamed")
    rows = batch.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name)
                          for f in target.schema.fields if f.name not in STREAM_COLUMNS])
    marked = rows.withColumns({"ingest_stream": F.lit(stream), "ingest_batch": F.lit(batch_id).cast("bigint")})
    insert_table(marked, table, overwrite=True, partition_by=list(STREAM_COLUMNS), partition_mode="dynamic")


def stream_ingest(spark: SparkSession, landing: str, table: str, checkpoint: str,
                  fmt: str = "csv", options: Mapping | None = None,
                  schema=None, max_files_per_trigger: int | None = None,
                  mode: str = "append", keys: Sequence[str] | None = None,
                  partition_by: Sequence[str] | None = None) -> None:
    """Append (or merge) new landing files into ``table`` (created on first run).

    Without a ``schema`` the header of the files already present names the
    columns and every column is text (no inference on a stream, as bronze).
    ``mode="merge"`` upserts each micro-batch on ``keys`` (K7/K8)."""
    if mode not in ("append", "merge"):
        raise ValueError(f"unknown stream mode {mode!r}")
    if mode == "merge" and not keys:
        raise ValueError("a merge stream needs keys")
    opts = {"header": "true", **{k: str(v) for k, v in (options or {}).items()}}
    if schema is None:
        schema = spark.read.format(fmt).options(**opts).load(landing).schema
    reader = spark.readStream.format(fmt).options(**opts).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = clean_silver_names(reader.load(landing))
    name = hashlib.sha1(files.qualified(spark, checkpoint).encode()).hexdigest()[:10]
    needed = [*(keys or []), *(partition_by or [])]

    def take(batch: DataFrame, batch_id: int) -> None:
        if mode == "append":
            if not spark.catalog.tableExists(table):
                create_streamed(spark.createDataFrame([], batch.schema), table)
            append_once(batch, batch_id, table, name)
            return
        unmatched = F.lit(False)
        for c in needed:
            unmatched = unmatched | F.col(f"`{c}`").isNull()
        if not batch.where(unmatched).isEmpty():
            raise ValueError(f"a merge stream needs values in {needed}: rows without them would be "
                             "inserted again by every replay")
        upsert(batch, list(keys), table=table, partition_by=partition_by)

    q = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take)
    q.start().awaitTermination()
    if spark.catalog.tableExists(table):
        spark.catalog.refreshTable(table)         # batches ran in a session of their own
