"""Table and path writes (K1-K6, K10-K12) and the write dispatcher.

Parquet is the default table format (no Delta jar here); any format name
Spark knows can be passed.  Inserts match columns by name unless
``by_position`` is set (D13); an empty input is skipped by default (K10),
checked with ``isEmpty`` (a one-row probe, not a count).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, unique_name
from . import files

DEFAULT_FORMAT = "parquet"


def _cols(part_cols: str | Sequence[str] | None) -> list[str]:
    if not part_cols:
        return []
    if isinstance(part_cols, str):
        return [c.strip() for c in part_cols.split(",") if c.strip()]
    return list(part_cols)


OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"


def own_session(spark: SparkSession, settings: Mapping[str, str]) -> SparkSession:
    """A session of its own over the same catalog, cache and cluster: the
    settings of ``spark`` with some changed, seen by nobody else."""
    own = spark.newSession()
    for key, value in {**spark.conf.getAll, **settings}.items():
        if own.conf.isModifiable(key) and own.conf.get(key, None) != value:
            own.conf.set(key, value)
    own.catalog.setCurrentDatabase(spark.catalog.currentDatabase())
    return own


@contextmanager
def in_overwrite_mode(df: DataFrame, mode: str):
    """``df`` in a session whose partition overwrite mode is ``mode``.

    ``insertInto`` ignores the write option of that name and takes the
    session's setting when it runs.  Where the frame's session has another
    one, the frame is handed to a session of its own (as a global temporary
    view, which keeps the plan as it is), so writes of several threads go on
    side by side and no setting changes under them.  An ``Observation`` on the
    frame hears of writes in its own session only: give that the mode first
    (``own_session``), as the ingest does."""
    spark = df.sparkSession
    if spark.conf.get(OVERWRITE_MODE).upper() == mode.upper():
        yield df
        return
    own = own_session(spark, {OVERWRITE_MODE: mode.upper()})
    name = unique_name("overwrite")
    df.createGlobalTempView(name)
    try:
        yield own.table(f"{spark.conf.get('spark.sql.globalTempDatabase', 'global_temp')}.{name}")
    finally:
        spark.catalog.dropGlobalTempView(name)


def table_exists(spark: SparkSession, table: str, schema: str | None = None) -> bool:
    """Case-insensitive; temporary views do not count."""
    name = f"{schema}.{table}" if schema else table
    return spark.catalog.tableExists(name)


def _skip(df: DataFrame, on_empty: str) -> bool:
    return on_empty == "skip" and df.isEmpty()


def create_table(df: DataFrame, table: str, fmt: str = DEFAULT_FORMAT,
                 partition_by: str | Sequence[str] | None = None,
                 location: str | None = None) -> None:
    """K1/K2: create a (partitioned) table from a frame."""
    w = df.write.format(fmt)
    parts = _cols(partition_by)
    if parts:
        w = w.partitionBy(*parts)
    if location:
        w = w.option("path", location)
    w.saveAsTable(table)


#: Partition columns of a table that streams append to (see ``streaming``).
STREAM_COLUMNS = {"ingest_stream": "string", "ingest_batch": "bigint"}


def unstreamed(df: DataFrame, target: DataFrame) -> DataFrame:
    """Rows of a batch job for a table that streams append to as well: they
    belong to no stream."""
    if any(c not in target.columns or c in df.columns for c in STREAM_COLUMNS):
        return df
    return df.withColumns({c: F.lit(None).cast(t) for c, t in STREAM_COLUMNS.items()})


def _order_for_insert(df: DataFrame, target_cols: list[str], parts: list[str],
                      by_position: bool) -> DataFrame:
    if by_position:
        if parts:  # K5: partition columns go last, as the original does
            return df.select(*[c for c in df.columns if c not in parts], *parts)
        return df
    missing = [c for c in target_cols if c not in df.columns]
    extra = [c for c in df.columns if c not in target_cols]
    if missing or extra:
        raise ValueError(f"input does not match the target: missing {missing}, extra {extra}")
    return df.select(*[f"`{c}`" for c in target_cols])


def insert_table(df: DataFrame, table: str, overwrite: bool = False,
                 partition_by: str | Sequence[str] | None = None,
                 fmt: str = DEFAULT_FORMAT, partition_mode: str = "static",
                 by_position: bool = False, on_empty: str = "skip",
                 location: str | None = None) -> bool:
    """K3/K4/K5 (+K1 when the table is absent).  ``partition_mode`` 'static'
    empties every partition on overwrite, 'dynamic' only those written.
    Returns False when the write was skipped for an empty input."""
    spark = df.sparkSession
    exists = spark.catalog.tableExists(table)
    # An empty append to an existing table changes nothing, so only a
    # create or an overwrite pays for the emptiness probe.
    if (overwrite or not exists) and _skip(df, on_empty):
        return False
    parts = _cols(partition_by)
    if not exists:
        create_table(df, table, fmt, parts, location)
        return True
    target = spark.table(table)
    ordered = _order_for_insert(unstreamed(df, target), target.columns, parts, by_position)
    if not overwrite:
        ordered.write.insertInto(table)
        return True
    try:
        with in_overwrite_mode(ordered, partition_mode) as frame:
            frame.write.insertInto(table, overwrite=True)
    except AnalysisException as exc:
        if "UNSUPPORTED_OVERWRITE" not in (exc.getCondition() or ""):
            raise
        # the frame reads the table it overwrites: stage it, then swap it in
        with staged(ordered) as held, in_overwrite_mode(held, partition_mode) as frame:
            frame.write.insertInto(table, overwrite=True)
    spark.catalog.refreshTable(table)
    return True


def write_path(df: DataFrame, path: str, mode: str = "append", fmt: str = DEFAULT_FORMAT,
               partition_by: str | Sequence[str] | None = None,
               partition_mode: str = "static", on_empty: str = "skip",
               options: dict | None = None) -> bool:
    """K6: append or overwrite a path, optionally partitioned (D6: explicit
    save modes)."""
    if mode not in ("append", "overwrite", "error", "errorifexists", "ignore"):
        raise ValueError(f"unknown save mode {mode!r}")
    if _skip(df, on_empty):
        return False

    def save(frame: DataFrame) -> None:
        w = frame.write.mode(mode).format(fmt).option("partitionOverwriteMode", partition_mode)
        parts = _cols(partition_by)
        if parts:
            w = w.partitionBy(*parts)
        w.options(**(options or {})).save(path)

    # Spark would empty the folder before reading it: stage such a frame
    if mode == "overwrite" and reads_from(df, path):
        with staged(df) as held:
            save(held)
    else:
        save(df)
    return True


@contextmanager
def staged(df: DataFrame, name: str = "overwrite-stage"):
    """``df`` written to a fresh folder under the shared checkpoint folder and
    read back, for as long as the block lasts: a frame that no longer depends
    on its sources (lineage cut; safe to overwrite what it was read from).
    The folder is deleted afterwards."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        files.delete_path(spark, path)


def reads_from(df: DataFrame, path: str) -> bool:
    """Whether ``df`` scans files under ``path``, or a folder above it (from
    the root folders of its scans; no file is listed for it)."""
    target = files.qualified(df.sparkSession, path) + "/"
    return any((root + "/").startswith(target) or target.startswith(root + "/") for root in files.scan_roots(df))


#: Cells are written as they are: the CSV writer would trim them by default.
CSV_AS_IS = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def export_csv(df: DataFrame, path: str, on_empty: str = "skip") -> bool:
    """Header CSV folder, overwritten; written by the executors (the
    original collects to the driver), no index column (D22), cells untrimmed."""
    if _skip(df, on_empty):
        return False

    def save(frame: DataFrame) -> None:
        frame.write.mode("overwrite").option("header", "true").options(**CSV_AS_IS).csv(path)

    if reads_from(df, path):
        with staged(df) as held:
            save(held)
    else:
        save(df)
    return True


def write_sink(df: DataFrame, *, table: str | None = None, path: str | None = None,
               mode: str = "append", keys: str | Sequence[str] | None = None,
               partition_by: str | Sequence[str] | None = None,
               fmt: str = DEFAULT_FORMAT, partition_mode: str = "static",
               on_empty: str = "skip", by_position: bool = False) -> bool:
    """Table or path x append / overwrite / merge."""
    m = mode.lower().strip()
    if m.startswith("insert"):
        m = "overwrite" if "overwrite" in m else "append"
    if m == "merge":
        from .upsert import upsert
        return upsert(df, keys=keys, table=table, path=path, partition_by=partition_by,
                      fmt=fmt, on_empty=on_empty)
    if m not in ("append", "overwrite"):
        raise ValueError(f"unknown write mode {mode!r}")
    if table:
        return insert_table(df, table, overwrite=(m == "overwrite"), partition_by=partition_by,
                            fmt=fmt, partition_mode=partition_mode, by_position=by_position,
                            on_empty=on_empty)
    if path:
        return write_path(df, path, m, fmt, partition_by, partition_mode, on_empty)
    raise ValueError("write_sink needs a table or a path")
