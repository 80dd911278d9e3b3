"""New versions of a table's data, switched in by the catalog.

The new files lie in a folder of their own, written in full before anything
is changed.  An unpartitioned table is then pointed at it with one ``ALTER
TABLE … SET LOCATION``; a partitioned one has each touched partition pointed
at its new folder.  Readers see the old rows up to that statement and the
new ones from it; a failure before it changes nothing, and one between the
partitions points those already switched back.  The old folders go last.

Versions of an unpartitioned table lie beside its first folder
(``orders.v-<hex>``), those of partitions under ``_versions`` in the table's
folder, so the table is read by its name, not by its folder.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

VERSIONS = "_versions"
#: How Spark names the folder of a NULL partition value.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"

#: Values of a partition, as text, by column.
Partition = tuple[tuple[str, str | None], ...]


def table_properties(spark: SparkSession, table: str) -> dict[str, str]:
    return {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}


def switchable(properties: Mapping[str, str], partitioned: bool) -> bool:
    """Whether the catalog knows where the rows lie: always for a table
    without partitions, else if it keeps the partitions itself."""
    return not partitioned or properties.get("Partition Provider") == "Catalog"


def new_folder(root: str, partitioned: bool) -> str:
    """Where the next version of a table at ``root`` is written."""
    mark = uuid.uuid4().hex[:12]
    if partitioned:
        return f"{root}/{VERSIONS}/{mark}"
    return re.sub(r"\.v-[0-9a-f]{12}$", "", root) + f".v-{mark}"


def _unescaped(text: str) -> str:
    return re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), text)


def partition_of(relative: str) -> Partition:
    """The partition that a folder such as ``p=a/q=b%2Fc`` holds."""
    steps = [step.split("=", 1) for step in relative.split("/")]
    return tuple((_unescaped(k), None if v == NULL_FOLDER else _unescaped(v)) for k, v in steps)


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def partition_sql(partition: Partition) -> str:
    return "PARTITION (" + ", ".join(f"`{k}` = {_text(NULL_FOLDER if v is None else v)}" for k, v in partition) + ")"


def folders_now(rows: DataFrame, parts: list[str]) -> dict[Partition, str]:
    """The folder of every partition that the rows of a table's scan lie in."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/[^/]*$", 1)
    spark = rows.sparkSession
    found = rows.select(*[F.col(f"`{p}`").cast("string") for p in parts], folder).distinct().collect()
    return {tuple(zip(parts, r[:-1])): files.from_uri(spark, r[-1]) for r in found}


def folders_written(spark: SparkSession, folder: str) -> dict[Partition, str]:
    return {partition_of(rel): f"{folder}/{rel}" for rel in files.leaf_folders(spark, folder) if rel}


def switch_table(spark: SparkSession, table: str, old: str, new: str) -> None:
    """Point an unpartitioned table at its new folder and delete the old."""
    (now,) = files.scan_roots(spark.table(table))
    if now != old:
        raise OSError(f"{table} was switched to {now} meanwhile; nothing is changed")
    set_location(spark, table, "", new)
    files.delete_path(spark, old)


def set_location(spark: SparkSession, table: str, partition: str, folder: str) -> None:
    spark.sql(f"ALTER TABLE {table} {partition} SET LOCATION {_text(folder)}")


def switch_partitions(spark: SparkSession, table: str, root: str, old: Mapping[Partition, str],
                      new: Mapping[Partition, str]) -> None:
    """Point the partitions at their new folders; those without one go.  Old
    folders below the table's root are deleted, others stay as they are."""
    added = [p for p in new if p not in old]
    moved = [p for p in new if p in old]
    done: list[Partition] = []
    try:
        if added:
            spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS " + " ".join(
                f"{partition_sql(p)} LOCATION {_text(new[p])}" for p in added))
        for p in [*moved, *added]:
            done.append(p)
            set_location(spark, table, partition_sql(p), new[p])
    except BaseException:
        for p in done:
            if p in old:
                set_location(spark, table, partition_sql(p), old[p])
        if added:
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS " + ", ".join(map(partition_sql, added)))
        raise
    gone = [p for p in old if p not in new]
    if gone:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS " + ", ".join(map(partition_sql, gone)))
    for folder in old.values():
        if folder.startswith(f"{root}/"):
            files.delete_path(spark, folder)
            files.delete_empty_parents(spark, folder, root)
