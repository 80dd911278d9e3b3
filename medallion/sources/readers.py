"""Scans (S1-S7, S9, S10) and the read dispatcher.

Every reader returns a lazy DataFrame; Spark plans the scan, so filters and
projections placed after it reach the file source (``PushedFilters`` /
``ReadSchema``) for columnar formats.
"""

from __future__ import annotations

import posixpath
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sinks import files
from . import csv_types

# Options of the raw CSV files (header, comma, inferred types)
# and of the directory merge (semicolon files with a header).
CSV_OPTIONS = {"header": "true", "delimiter": ",", "inferSchema": "true"}
CSV_DIR_OPTIONS = {"header": "true", "delimiter": ";", "inferSchema": "true"}
# The CSV options that say where cells begin and end, and the
# one syntax of bronze copies ('"' escapes quotes both ways).
CSV_SYNTAX = ("sep", "delimiter", "quote", "escape", "chartoescapequoteescaping", "unescapedquotehandling",
              "header", "multiline", "linesep", "encoding", "charset", "comment", "maxcolumns",
              "maxcharspercolumn")
BRONZE_SYNTAX = {"sep": ",", "quote": '"', "escape": '"'}
BRONZE_MARK = "_canonical_csv"
REJECTED = "_rejected"


def _opts(options: Mapping | None) -> dict[str, str]:
    return {k: (str(v).lower() if isinstance(v, bool) else str(v))
            for k, v in (options or {}).items()}


def read_csv(spark: SparkSession, path: str, options: Mapping | None = None) -> DataFrame:
    """CSV scan; options default to header, ',' and inferred types."""
    return spark.read.format("csv").options(**_opts(options or CSV_OPTIONS)).load(path)


def read_format(spark: SparkSession, fmt: str, path: str,
                options: Mapping | None = None, schema: str | None = None) -> DataFrame:
    """Any format by path; a DDL ``schema`` skips inference (on a large
    CSV, inference is a full extra pass)."""
    reader = spark.read.format(fmt).options(**_opts(options))
    if schema:
        reader = reader.schema(schema)
    return reader.load(path)


def read_table(spark: SparkSession, table: str, schema: str | None = None) -> DataFrame:
    """S3: a catalog table by schema and name."""
    return spark.table(f"{schema}.{table}" if schema else table)


def read_query(spark: SparkSession, query: str) -> DataFrame:
    """A SQL query as a source."""
    return spark.sql(query)


def read_source(spark: SparkSession, source_type: str = "table", *, fmt: str = "parquet",
                table: str = "", schema: str = "default", query: str = "",
                path: str = "", options: Mapping | None = None) -> DataFrame:
    """``source_type`` 'table' reads ``query`` when it is not blank, else
    the table; 'csv' is S1, 'csv_dir' S7, 'ext' S6; anything else reads
    ``path`` in ``fmt`` (or in ``source_type`` when it names a format)."""
    st = (source_type or "table").lower()
    if st == "table":
        return read_query(spark, query) if query and query.strip() else \
            read_table(spark, table, schema)
    if st == "csv":
        return read_csv(spark, path, options)
    if st == "csv_dir":
        return read_csv_dir(spark, path, options)
    if st == "ext":
        return read_by_extension(spark, path)
    return read_format(spark, fmt if st in ("path", "file", "format") else st, path, options)


def format_from_extension(path: str) -> str:
    """S6 rule: the text between the first and second dot of the base name."""
    base = posixpath.basename(path.rstrip("/"))
    parts = base.split(".")
    if len(parts) < 2 or not parts[1]:
        raise ValueError(f"no format extension in {path!r}")
    return parts[1].lower()


def read_by_extension(spark: SparkSession, path: str) -> DataFrame:
    """Format from the file name, header on, no inference."""
    return spark.read.format(format_from_extension(path)).option("header", "true").load(path)


def read_csv_dir(spark: SparkSession, directory: str,
                 options: Mapping | None = None) -> DataFrame:
    """Every CSV of a directory in one scan (';', header, inference)."""
    return spark.read.options(**_opts(options or CSV_DIR_OPTIONS)).csv(directory)


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Name, path, size (bytes and KB) and modification time of the files
    under a folder.  ``binaryFile`` prunes the unread ``content`` column, so
    this is a distributed listing, not a read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(path).select("path", "length", "modificationTime")
    return df.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
        F.col("path"),
        F.col("length").alias("size_bytes"),
        (F.col("length") / F.lit(1024.0)).alias("size_kb"),
        F.col("modificationTime").alias("modified"))


def bronze_read_options(options: Mapping | None) -> dict[str, str]:
    """The options that read a bronze CSV copy of a file whose own options
    are ``options``: the canonical syntax, the file's header and line rule,
    and everything that says how to understand a cell (types, null marks)."""
    own = _opts(options)
    values = {k: v for k, v in own.items() if k.lower() not in CSV_SYNTAX}
    shape = {k: v for k, v in own.items() if k.lower() in ("header", "multiline")}
    return {**BRONZE_SYNTAX, **shape, **values}


def copy_to_bronze(spark: SparkSession, src: str, dst: str, fmt: str = "csv",
                   options: Mapping | None = None, bad_lines: str = "fail") -> int:
    """Copy one landing file (or folder) to bronze on the executors, without
    loss.  CSV is parsed by the file's own syntax (delimiter, quote, escape,
    header, multi-line records, encoding), every cell kept as text and
    nothing trimmed or turned into NULL, and written in one canonical syntax;
    a folder copied so holds the mark ``BRONZE_MARK``.  Line formats are
    copied line by line, unparsed (whole files where a record may span
    lines); other formats in their own.

    A CSV record with too many or too few cells is never cut: with
    ``bad_lines="fail"`` it is an error, with ``"quarantine"`` it is kept
    word for word under ``REJECTED`` beside the copy (Parquet, column
    ``line``).  Returns how many there were."""
    fmt = (fmt or "csv").lower()
    own = _opts(options)
    if bad_lines not in ("fail", "quarantine"):
        raise ValueError(f"unknown way with bad lines {bad_lines!r}")
    if fmt == "csv":
        return _copy_csv(spark, src, dst, own, bad_lines == "quarantine")
    if fmt in ("json", "text", "txt", "jsonl"):
        spanning = next((v for k, v in own.items() if k.lower() in ("multiline", "wholetext")), "false")
        spark.read.option("wholetext", spanning).text(src).write.mode("overwrite").text(dst)
    else:
        spark.read.format(fmt).load(src).write.mode("overwrite").format(fmt).save(dst)
    return 0


def _copy_csv(spark: SparkSession, src: str, dst: str, own: Mapping[str, str], tolerant: bool) -> int:
    syntax = {k: v for k, v in own.items() if k.lower() in CSV_SYNTAX}
    header = next((v for k, v in own.items() if k.lower() == "header"), "false")
    # a mark no cell has keeps quoted empty cells apart from absent ones
    reader = spark.read.options(**syntax).options(inferSchema="false", nullValue="\0")

    typed = csv_types.settles(own)
    null_value, kinds = csv_types.null_value_of(own), Observation()

    def write(cells: DataFrame) -> None:
        if typed:       # the types come out of the same pass
            cells = cells.observe(kinds, *csv_types.counts(cells.columns, null_value))
        cells.write.mode("overwrite").options(**BRONZE_SYNTAX).options(
            ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").option("header", header).csv(dst)

    rejected, columns = 0, reader.csv(src).schema
    if not tolerant:
        write(reader.options(mode="FAILFAST").schema(columns).csv(src))
    else:
        mark = next(c for c in (f"_line{i or ''}" for i in range(len(columns) + 1))
                    if c not in {n.lower() for n in columns.names})
        # every column is read, so that a record's cells are all counted
        lines = reader.options(mode="PERMISSIVE", columnNameOfCorruptRecord=mark, columnPruning="false").schema(
            T.StructType([*columns.fields, T.StructField(mark, T.StringType())])).csv(src)
        seen = Observation()
        write(lines.observe(seen, F.count(mark).alias("bad")).where(F.col(mark).isNull()).drop(mark))
        rejected = seen.get["bad"]
        if rejected:        # a second pass, for files that have any
            # Spark refuses to read the corrupt records' column alone: look at a cell too
            cell = F.col("`" + columns.names[0].replace("`", "``") + "`")
            lines.where(F.col(mark).isNotNull() & (F.length(F.coalesce(cell, F.lit(""))) >= 0)).select(
                F.col(mark).alias("line")).write.parquet(f"{dst.rstrip('/')}/{REJECTED}")
    if typed and columns.names:
        types = csv_types.settled(columns.names, kinds.get)
        if types:
            csv_types.keep(spark, dst, types, null_value)
    files.touch(spark, f"{dst.rstrip('/')}/{BRONZE_MARK}")
    return int(rejected)


def rejected_lines(spark: SparkSession, bronze_path: str) -> DataFrame | None:
    """The lines that a bronze copy left out (column ``line``), if any."""
    path = f"{bronze_path.rstrip('/')}/{REJECTED}"
    return spark.read.schema("line string").parquet(path) if files.exists(spark, path) else None


def refresh_bronze(spark: SparkSession, landing: str, bronze: str,
                   files: list[str], options: Mapping[str, Mapping] | None = None,
                   formats: Mapping[str, str] | None = None) -> dict[str, str]:
    """Full refresh of bronze from landing.  Every landing file is
    copied to ``bronze/<file>`` with overwrite (``options`` and ``formats``
    per file; a comma CSV with a header by default), so bronze ends up
    holding exactly the landing files.  Returns file name -> bronze path."""
    out = {}
    for name in files:
        src = f"{landing.rstrip('/')}/{name}"
        dst = f"{bronze.rstrip('/')}/{name}"
        copy_to_bronze(spark, src, dst, (formats or {}).get(name, "csv"),
                       (options or {}).get(name, {"header": "true"}))
        out[name] = dst
    return out
