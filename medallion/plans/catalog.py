"""Catalog jobs (C1-C6) and row-count reconciliation.

All of it goes through the Spark catalog; no folder is deleted by path
(D23), and no temporary view is left behind (D20).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rollup import reconcile_counts
from ..sinks.files import exists
from ..sinks.versions import VERSIONS
from ..sinks.writers import table_exists  # noqa: F401  (C3, re-exported)
from ..sources.readers import list_files


def create_layers(spark: SparkSession, dbs: Sequence[str] = ("silver", "gold"),
                  root: str | None = None) -> None:
    """Create the layer databases when missing (under ``root`` if given)."""
    for db in dbs:
        loc = f" LOCATION '{root.rstrip('/')}/{db}.db'" if root else ""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{db}`{loc}")


def use_layer(spark: SparkSession, db: str) -> None:
    """C4: make a layer the current database (``USE silver``)."""
    spark.catalog.setCurrentDatabase(db)


def list_tables(spark: SparkSession, db: str) -> DataFrame:
    """C4: permanent tables of a database as rows (temporary views excluded)."""
    return (spark.sql(f"SHOW TABLES IN `{db}`")
            .where(~F.col("isTemporary"))
            .select(F.col("namespace").alias("database"), F.col("tableName").alias("table_name")))


def reset_layer(spark: SparkSession, db: str) -> list[str]:
    """Drop every table (and permanent view) of a layer through the
    catalog; returns the names.  Folders are never deleted by path (D23)."""
    names = []
    for t in spark.catalog.listTables(db):
        if t.isTemporary:
            continue
        kind = "VIEW" if (t.tableType or "").upper() == "VIEW" else "TABLE"
        spark.sql(f"DROP {kind} IF EXISTS `{db}`.`{t.name}`")
        names.append(t.name)
    return names


def describe_schema(spark: SparkSession, table: str) -> DataFrame:
    """The schema of a table as rows (col_name, data_type), in order (the
    columns come first in DESCRIBE; partition and storage details follow)."""
    n = len(spark.table(table).columns)
    return spark.sql(f"DESCRIBE TABLE {table}").limit(n).select("col_name", "data_type")


def describe_database(spark: SparkSession, db: str) -> DataFrame:
    """DESCRIBE DATABASE as rows."""
    return spark.sql(f"DESCRIBE DATABASE `{db}`")


def table_detail(spark: SparkSession, table: str) -> DataFrame:
    """Format, location, files and bytes of a table.  Format and
    location come from the catalog; files and bytes from a listing of the
    location, versions of partitions included (one row per file, content
    never read), summed on the executors.  Hidden files (``_SUCCESS``,
    ``.crc``) and partitions kept outside the location are left out."""
    meta = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()
            if r.col_name in ("Provider", "Location")}
    loc = meta.get("Location")
    listed = list_files(spark, loc)
    if exists(spark, f"{loc}/{VERSIONS}"):
        listed = listed.union(list_files(spark, f"{loc}/{VERSIONS}"))
    files = (listed
             .where(~F.col("name").startswith("_") & ~F.col("name").startswith("."))
             .agg(F.count(F.lit(1)).alias("num_files"),
                  F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_in_bytes")))
    return files.select(F.lit(table).alias("name"), F.lit(meta.get("Provider")).alias("format"),
                        F.lit(loc).alias("location"), "num_files", "size_in_bytes")


def reconcile(spark: SparkSession, tables: Sequence[str]) -> DataFrame:
    """Row count of each table, one row per table."""
    return reconcile_counts({t: spark.table(t) for t in tables})
