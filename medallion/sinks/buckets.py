"""A table laid out by key hash, for upserts of small batches.

Every row's bucket is the hash of the merge keys modulo the number of
buckets.  The bucket is a partition column (``key_bucket``), so a bucket can
be read and replaced by itself; and the table is clustered by the same keys
into as many buckets, so Spark knows how each partition's files are spread.
An upsert reads and rewrites only the buckets that the batch has keys for,
and joins them without moving them: only the batch is shuffled.

NULL keys match nothing.  Their rows lie in a partition of their own
(``key_bucket = -1``) that no upsert reads; new ones are appended to it after
the switch.  A key that fills a bucket beyond ``MAX_BUCKET_BYTES`` (by the
files' sizes) would make one long task; such a batch reads its buckets as
plain files, joined with Spark's own shuffle and its splitting of skew.

The new files of the touched buckets are switched in as ``versions`` says.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files, versions
from .upsert import _key_join, _quoted, _typed, check_columns, check_single_match
from .writers import DEFAULT_FORMAT, _cols

BUCKET = "key_bucket"
NO_KEY = -1
MAX_BUCKET_BYTES = 4 << 30


def bucket_of(keys: Sequence[str], n_buckets: int) -> Column:
    """The bucket of a row: Spark's own hash of its bucketing columns."""
    empty = F.lit(False)
    for k in keys:
        empty = empty | _quoted(k).isNull()
    return F.when(empty, F.lit(NO_KEY)).otherwise(F.pmod(F.hash(*[_quoted(k) for k in keys]), F.lit(n_buckets)))


def _write(rows: DataFrame, table: str, keys: list[str], n_buckets: int, fmt: str, path: str | None) -> None:
    w = rows.write.format(fmt).partitionBy(BUCKET).bucketBy(n_buckets, *keys).sortBy(*keys)
    (w.option("path", path) if path else w).saveAsTable(table)


def create_bucketed(df: DataFrame, table: str, keys: str | Sequence[str], n_buckets: int,
                    fmt: str = DEFAULT_FORMAT, location: str | None = None) -> None:
    """Create the table.  Choose ``n_buckets`` so that a bucket is some
    hundred megabytes: it is what one task rewrites."""
    keys = _cols(keys)
    if not keys:
        raise ValueError("a bucketed table needs its merge keys")
    rows = df.withColumn(BUCKET, bucket_of(keys, n_buckets))
    # rows of one bucket together; rows without a key in several tasks
    _write(rows.hint("rebalance", F.col(BUCKET)), table, keys, n_buckets, fmt, location)


def is_bucketed(spark: SparkSession, table: str) -> bool:
    target = spark.table(table)
    return BUCKET in target.columns and files.partition_columns(target) == [BUCKET] and \
        "Num Buckets" in versions.table_properties(spark, table)


def read_bucketed(spark: SparkSession, table: str) -> DataFrame:
    """The table's rows without the layout column."""
    return spark.table(table).drop(BUCKET)


def bucket_files(part: DataFrame) -> dict[int, tuple[str, int]]:
    """Folder and bytes of each bucket that holds rows (a row per file of
    the touched buckets reaches the driver)."""
    found: dict[int, tuple[str, int]] = {}
    for r in part.select(F.col(BUCKET).alias("bucket"), F.col("_metadata.file_path").alias("path"),
                         F.col("_metadata.file_size").alias("size")).distinct().collect():
        path = files.parent(files.from_uri(part.sparkSession, r["path"]))
        found[r["bucket"]] = (path, found.get(r["bucket"], (path, 0))[1] + r["size"])
    return found


def merged_buckets(part: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """The touched buckets after the MERGE.  The anti join finds the target
    side clustered by the keys already; the batch is dealt by bucket."""
    kept = _key_join(part, updates, keys, F.lit(True), "left_anti")
    return kept.unionByName(updates.select(*[_quoted(c) for c in part.columns]).repartition(F.col(BUCKET)))


def merged_files(part: DataFrame, folders: list[str], updates: DataFrame, keys: list[str], n_buckets: int,
                 fmt: str) -> DataFrame:
    """The same from the buckets' files as they are, for Spark to shuffle."""
    rows = part.drop(BUCKET)
    if folders:
        rows = part.sparkSession.read.format(fmt).schema(rows.schema).load(folders)
    rows = rows.withColumn(BUCKET, bucket_of(keys, n_buckets))
    kept = _key_join(rows, updates, keys, F.lit(True), "left_anti")
    return kept.unionByName(updates.select(*[_quoted(c) for c in rows.columns])).hint("rebalance", F.col(BUCKET))


def merge(spark: SparkSession, table: str, target: DataFrame, updates: DataFrame, keys: list[str],
          predicate: list[str]) -> None:
    """Upsert a staged batch into a bucketed table (called by ``upsert``)."""
    properties = versions.table_properties(spark, table)
    n_buckets, fmt = int(properties["Num Buckets"]), properties["Provider"]
    own = [c.strip(" `") for c in properties["Bucket Columns"].strip("[]").split(",")]
    if sorted(own) != sorted(keys) or predicate:
        raise ValueError(f"{table} is bucketed by {own}: its merge keys are these, without a partition predicate")
    rows = target.drop(BUCKET)
    updates = _typed(rows, check_columns(rows, updates.drop(BUCKET))).withColumn(BUCKET, bucket_of(own, n_buckets))
    keyed = updates.where(F.col(BUCKET) != NO_KEY)
    touched = [r[0] for r in keyed.select(BUCKET).distinct().collect()]       # n_buckets at most
    (root,) = files.scan_roots(target)
    new = versions.new_folder(root, True)
    if touched:
        part = target.where(F.col(BUCKET).isin(touched))
        held = bucket_files(part)
        check_single_match(part, keyed, own)
        if max((size for _, size in held.values()), default=0) > MAX_BUCKET_BYTES:
            result = merged_files(part, [f for f, _ in held.values()], keyed, own, n_buckets, fmt)
        else:
            result = merged_buckets(part, keyed, own)
        db = table.rpartition(".")[0]
        stage = f"{db}.version_{uuid.uuid4().hex[:12]}".lstrip(".")
        try:
            _write(result, stage, own, n_buckets, fmt, new)
            spark.sql(f"DROP TABLE {stage}")               # external: its files stay
            versions.switch_partitions(spark, table, root, {((BUCKET, str(b)),): f for b, (f, _) in held.items()},
                                       versions.folders_written(spark, new))
        except BaseException:
            spark.sql(f"DROP TABLE IF EXISTS {stage}")
            files.delete_path(spark, new)
            raise
        spark.catalog.refreshTable(table)
    rest = updates.where(F.col(BUCKET) == NO_KEY)
    if not rest.isEmpty():
        rest.select(*[_quoted(c) for c in target.columns]).write.insertInto(table)
