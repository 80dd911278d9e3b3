"""Config-driven ingest (W1) with its audit table (W2) and the bronze
refresh (S10).

Configuration is a plain dict (read options may be a dict, or text of a
JSON object written with single quotes as in the original config); per-file
settings override layer defaults, which override built-in literals, weakest
first:

* source format: ``csv`` < landing.file_format < bronze.format < file.file_format
* read options:  ``{}``  < landing.read_options < file.read_options
* table format:  ``parquet`` < silver.table_format < file.table_format
* write command: ``insert overwrite`` < bronze.write_command < file.write_command
* table name:    file stem < file.table_name

A file's entry may also give ``schema`` (a DDL string such as
``"id INT, name STRING"``).  Without it the types come from the bronze copy's
own pass where that settles them (see ``sources.csv_types``), else from type
inference, which on a large CSV is a full extra pass; ``read_options`` may
then carry ``samplingRatio``.

The bronze refresh copies only what changed since the last one: a manifest
(a folder of Parquet files beside bronze, ``<bronze>.manifest``) keeps path,
bytes and modification time of every landing file with the options it was copied by, and is compared with
the landing folder's listing.  ``"full_refresh": true`` copies everything.  A
file that changes within one tick of its clock without changing its size is
not noticed.

A CSV record with too many or too few cells does not stop a load: the file's
other rows go to silver, the record goes word for word to the quarantine
table (``quarantine: {"db", "table"}``, by default ``QUARANTINE`` in the
silver database), and the audit counts it.  ``"bad_lines": "fail"`` makes it
an error.

Unmapped files use the defaults (D8).  A ``merge`` command needs
``merge_cols`` in the file's entry (D7).
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import clean_silver_names
from ..sinks import files, versions
from ..sinks.writers import OVERWRITE_MODE, create_table, own_session, staged, write_path, write_sink
from ..sources import csv_types
from ..sources.readers import BRONZE_MARK, bronze_read_options, copy_to_bronze, list_files, read_format, rejected_lines

# Built-in defaults, weakest in the precedence chain.
DEFAULT_SOURCE_FORMAT = "csv"
DEFAULT_WRITE_COMMAND = "insert overwrite"
DEFAULT_TABLE_FORMAT = "parquet"
DEFAULT_BAD_LINES = "quarantine"
DEFAULT_WORKERS = 4          # files under way at once
MANIFEST = ".manifest"
MANIFEST_SCHEMA = "file_name string, path string, size_bytes bigint, modified timestamp, settings string"
QUARANTINE = "ingestion_quarantine"

AUDIT_SCHEMA = T.StructType([
    T.StructField("file_name", T.StringType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("write_command", T.StringType()),
    T.StructField("size_kb", T.DoubleType()),
    T.StructField("start_time", T.TimestampType()),
    T.StructField("end_time", T.TimestampType()),
    T.StructField("rows_written", T.LongType()),
    T.StructField("rows_rejected", T.LongType()),
    T.StructField("bronze_copied", T.BooleanType()),
])


@dataclass
class FileSettings:
    file_name: str
    source_format: str
    read_options: dict
    table_format: str
    write_command: str
    table_name: str
    merge_cols: list[str] = field(default_factory=list)
    part_cols: list[str] = field(default_factory=list)
    schema: str | None = None


def _pick(*values, default):
    out = default
    for v in values:
        if v not in (None, "", {}):
            out = v
    return out


def normalise_config(cfg: Mapping) -> dict:
    """Accept the original layout too, where the layers sit under an
    ``ingestion`` key; top-level keys win."""
    nested = cfg.get("ingestion")
    if isinstance(nested, Mapping):
        return {**nested, **{k: v for k, v in cfg.items() if k != "ingestion"}}
    return dict(cfg)


def _options(value) -> dict:
    """Read options as a dict; text in the original config style (a JSON
    object written with single quotes) is parsed too."""
    if isinstance(value, str):
        return json.loads(value.replace("'", '"')) if value.strip() else {}
    return dict(value or {})


def resolve_settings(cfg: Mapping, file_name: str) -> FileSettings:
    """The precedence rules of the module docstring."""
    cfg = normalise_config(cfg)
    landing = cfg.get("landing", {})
    bronze = cfg.get("bronze", {})
    silver = cfg.get("silver", {})
    per_file = cfg.get("bronze_silver_mapping", {}).get(file_name, {})
    stem = file_name.split(".")[0]
    return FileSettings(
        file_name=file_name,
        source_format=_pick(landing.get("file_format"), bronze.get("format"),
                            per_file.get("file_format"), default=DEFAULT_SOURCE_FORMAT),
        read_options=_options(_pick(landing.get("read_options"), per_file.get("read_options"),
                                    default={})),
        table_format=_pick(silver.get("table_format"), per_file.get("table_format"),
                           default=DEFAULT_TABLE_FORMAT),
        write_command=_pick(bronze.get("write_command"), per_file.get("write_command"),
                            default=DEFAULT_WRITE_COMMAND).strip(),
        table_name=_pick(per_file.get("table_name"), default=stem),
        merge_cols=list(per_file.get("merge_cols", [])),
        part_cols=list(per_file.get("part_cols", [])),
        schema=per_file.get("schema"),
    )


def _mode(command: str) -> str:
    c = command.lower()
    if "merge" in c or "upsert" in c:
        return "merge"
    return "overwrite" if "overwrite" in c else "append"


def landed_files(spark: SparkSession, folder: str) -> list[tuple[str, float]]:
    """Top-level entries of a landing or bronze folder with their size in KB
    (a bronze entry is a folder of part files; its size is their sum)."""
    root = files.qualified(spark, folder)
    rel = F.split(F.substring(F.col("path"), len(root) + 2, 1 << 20), "/")
    rows = (list_files(spark, root)
            .where(~F.col("name").startswith("_") & ~F.col("name").startswith("."))
            .select(rel[0].alias("entry"), "size_kb")
            .groupBy("entry").agg(F.sum("size_kb").alias("size_kb")).collect())
    return sorted((r["entry"], float(r["size_kb"])) for r in rows)


def ingest_file(spark: SparkSession, cfg: Mapping, path: str, file_name: str,
                size_kb: float | None = None, copied: bool | None = None) -> dict:
    """W1 for one bronze file: read, clean names (P1), write to silver, and
    return the audit record (W2).  The load has a session of its own, whose
    overwrite mode is this file's, so loads do not wait for one another."""
    cfg = normalise_config(cfg)
    s = resolve_settings(cfg, file_name)
    db = cfg.get("silver", {}).get("db", "silver")
    mode = _mode(s.write_command)
    if mode == "merge" and not s.merge_cols:
        raise ValueError(f"{file_name}: merge needs merge_cols (D7)")
    start = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    partition_mode = "dynamic" if s.part_cols else "static"
    own = own_session(spark, {OVERWRITE_MODE: partition_mode.upper()})
    # the configured format and options exactly as given (no CSV defaults
    # slipped in when the config names no options); a bronze copy is read in
    # its own syntax
    options, schema = s.read_options, s.schema
    if s.source_format.lower() == "csv" and files.exists(spark, f"{path.rstrip('/')}/{BRONZE_MARK}"):
        options = bronze_read_options(options)
        # types that the copy has settled save the pass that infers them
        schema = schema or csv_types.kept(spark, path, options)
    df = clean_silver_names(read_format(own, s.source_format, path, options, schema))
    table, written = f"{db}.{s.table_name}", 0
    if not df.isEmpty():                               # K10
        seen = Observation()
        write_sink(df.observe(seen, F.count(F.lit(1)).alias("rows")), table=table, mode=mode,
                   keys=s.merge_cols, partition_by=s.part_cols, fmt=s.table_format,
                   partition_mode=partition_mode, on_empty="write")
        written = seen.get["rows"]
        spark.catalog.refreshTable(table)
    rejected = quarantine(own, cfg, path, file_name)
    end = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    return {"file_name": file_name, "table_name": table, "write_command": s.write_command,
            "size_kb": size_kb, "start_time": start, "end_time": end, "rows_written": int(written),
            "rows_rejected": rejected, "bronze_copied": copied}


def _quarantine_table(cfg: Mapping) -> str:
    own = cfg.get("quarantine") or {}
    return f"{own.get('db') or cfg.get('silver', {}).get('db', 'silver')}.{own.get('table') or QUARANTINE}"


def quarantine(spark: SparkSession, cfg: Mapping, path: str, file_name: str) -> int:
    """The rejected lines of a bronze copy in place of those that the file
    had in the quarantine table (``line``, ``file_name``); their number."""
    table, lines = _quarantine_table(cfg), rejected_lines(spark, path)
    if lines is None:
        forget_quarantined(spark, cfg, [file_name])
        return 0
    write_sink(lines.withColumn("file_name", F.lit(file_name)), table=table, mode="overwrite",
               partition_by="file_name", partition_mode="dynamic", on_empty="write")
    return lines.count()


def forget_quarantined(spark: SparkSession, cfg: Mapping, names: list[str]) -> None:
    """Drop the quarantined lines of files that have none any more."""
    table = _quarantine_table(cfg)
    if names and spark.catalog.tableExists(table):
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS " + ", ".join(
            versions.partition_sql((("file_name", n),)) for n in names))


def _side_by_side(spark: SparkSession, work: Callable, items: list, workers: int) -> list:
    """``work`` on each item, a few at a time; results in the items' order.
    The items are files of a folder: their names, not their rows."""
    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        return list(pool.map(work, items))


def landing_manifest(spark: SparkSession, cfg: Mapping, landing: str) -> DataFrame:
    """(file_name, path, size_bytes, modified, settings) of every file under
    the landing folder; ``file_name`` is the top-level entry it belongs to."""
    root = files.qualified(spark, landing)
    entry = F.split(F.substring(F.col("path"), len(root) + 2, 1 << 20), "/")[0]
    listed = list_files(spark, root).where(~F.col("name").startswith("_") & ~F.col("name").startswith(".")).select(
        entry.alias("file_name"), "path", "size_bytes", "modified")
    names = [r[0] for r in listed.select("file_name").distinct().collect()]
    # what a copy depends on besides the file itself
    own = {n: resolve_settings(cfg, n) for n in names if not n.startswith(("_", "."))}
    settings = spark.createDataFrame(
        [(n, json.dumps([s.source_format, s.read_options, cfg.get("bad_lines", DEFAULT_BAD_LINES)], sort_keys=True))
         for n, s in own.items()], "file_name string, settings string")
    return listed.join(F.broadcast(settings), "file_name")      # one row for each landing entry


def refresh_changed(spark: SparkSession, cfg: Mapping, landing: str, bronze: str) -> set[str]:
    """Bring bronze up to date with landing.  Files that are new or
    changed since the manifest are copied, entries gone from landing go, the
    others stay as they are.  Returns the names copied."""
    kept_at = f"{bronze}{MANIFEST}"
    with staged(landing_manifest(spark, cfg, landing), "bronze-manifest") as now:
        names = {r[0] for r in now.select("file_name").distinct().collect()}
        changed = set(names)
        there = {n for n, _ in landed_files(spark, bronze)} if files.has_entries(spark, bronze) else set()
        if files.has_entries(spark, kept_at) and not cfg.get("full_refresh"):
            before = spark.read.schema(MANIFEST_SCHEMA).parquet(kept_at).select(*now.columns)
            on = [now[c].eqNullSafe(before[c]) for c in now.columns]
            moved = now.join(before, on, "left_anti").select("file_name").union(
                before.join(now, on, "left_anti").select("file_name"))
            changed = ({r[0] for r in moved.distinct().collect()} | (names - there)) & names

        def copy(name: str) -> None:
            s = resolve_settings(cfg, name)
            copy_to_bronze(spark, f"{landing.rstrip('/')}/{name}", f"{bronze}/{name}", s.source_format,
                           s.read_options, cfg.get("bad_lines", DEFAULT_BAD_LINES))

        # a copy that breaks off must not pass for one: its entries go first
        kept = now.where(~F.col("file_name").isin(sorted(changed))) if changed else now
        write_path(kept, kept_at, "overwrite", on_empty="write")
        _side_by_side(spark, copy, sorted(changed), int(cfg.get("workers", DEFAULT_WORKERS)))
        gone = sorted(there - names)
        for stale in gone:      # bronze holds exactly the landing files
            files.delete_path(spark, f"{bronze}/{stale}")
        forget_quarantined(spark, cfg, gone)
        write_path(now, kept_at, "overwrite", on_empty="write")
    return changed


def ingest(spark: SparkSession, cfg: Mapping, refresh: bool = True) -> DataFrame:
    """W1 + W2 + S10: refresh bronze from landing, ingest every bronze file
    into silver (``workers`` files at once), append the audit rows to the
    audit table, return them.  Files that share a table go one after the
    other, in the order of their names."""
    cfg = normalise_config(cfg)
    bronze = cfg["bronze"]["path"].rstrip("/")
    workers = int(cfg.get("workers", DEFAULT_WORKERS))
    landing = cfg.get("landing", {}).get("path") if refresh else None
    db = cfg.get("silver", {}).get("db", "silver")
    for name in {db, (cfg.get("quarantine") or {}).get("db") or db}:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")
    copied = refresh_changed(spark, cfg, landing, bronze) if landing else None
    by_table: dict[str, list] = {}
    for name, size in landed_files(spark, bronze):
        by_table.setdefault(resolve_settings(cfg, name).table_name.lower(), []).append((name, size))
    if files.exists(spark, bronze) and spark.catalog.tableExists(_quarantine_table(cfg)):
        spark.catalog.refreshTable(_quarantine_table(cfg))
    elif any(rejected_lines(spark, f"{bronze}/{n}") is not None for own in by_table.values() for n, _ in own):
        create_table(spark.createDataFrame([], "line string, file_name string"), _quarantine_table(cfg),
                     partition_by="file_name")

    def load(own: list) -> list[dict]:
        return [ingest_file(spark, cfg, f"{bronze}/{name}", name, size, None if copied is None else name in copied)
                for name, size in own]

    records = sorted((r for done in _side_by_side(spark, load, list(by_table.values()), workers) for r in done),
                     key=lambda r: r["file_name"])
    audit = spark.createDataFrame(records, AUDIT_SCHEMA).withColumn(
        "seconds", F.timestamp_diff("SECOND", F.col("start_time"), F.col("end_time")))   # X8
    audit_cfg = cfg.get("audit")
    if audit_cfg:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{audit_cfg['db']}`")
        table = f"{audit_cfg['db']}.{audit_cfg['table']}"
        if spark.catalog.tableExists(table):        # made before these columns were kept
            new = [f"{f.name} {f.dataType.simpleString()}" for f in AUDIT_SCHEMA
                   if f.name not in spark.table(table).columns]
            if new:
                spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(new)})")
        write_sink(audit, table=table, mode="append")
    if spark.catalog.tableExists(_quarantine_table(cfg)):
        spark.catalog.refreshTable(_quarantine_table(cfg))      # written by the loads' own sessions
    return audit
