"""Profiles that grow with a table (A4, A5): the counts of every partition
are kept and added up, and only partitions that are new or changed are read.

A partition's state is its number of rows and, per column, how many values
are there and how many look numeric.  These add up, so the merged profile is
the one that a full pass gives.  Whether a partition has changed is told by
its folder's listing (path, bytes, time of each file), which reads no rows.
The states lie in a table of their own, a row per partition folder, under the
name of the table they belong to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks import files
from ..sinks.versions import VERSIONS
from ..sinks.writers import staged, write_sink
from ..sources.readers import list_files
from .clean import ColumnProfile, _numeric_count, _q

STATE_SCHEMA = ("folder string, digest string, n_rows bigint, "
                "columns array<struct<name: string, type: string, non_null: bigint, numeric: bigint>>, "
                "table_name string")


def folder_digests(spark: SparkSession, table: str) -> DataFrame:
    """(folder, digest) of the folders that hold a table's files, from their
    listing."""
    spark.catalog.refreshTable(table)
    found = None
    for root in files.scan_roots(spark.table(table)):
        for place in (root, f"{root}/{VERSIONS}"):
            if files.exists(spark, place):
                own = list_files(spark, place).where(~F.col("name").startswith("_") & ~F.col("name").startswith("."))
                found = own if found is None else found.union(own)
    h = F.xxhash64("path", "size_bytes", "modified").cast("decimal(20,0)")
    return found.groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).agg(
        F.concat_ws(":", F.count(F.lit(1)), F.sum(h)).alias("digest"))


def _folder() -> Column:
    """The folder of a row's file, as a listing names it."""
    return F.url_decode(F.replace(F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/[^/]*$", 1),
                                  F.lit("+"), F.lit("%2B")))


def partition_states(rows: DataFrame) -> DataFrame:
    """(folder, n_rows, columns) of the rows of a table's scan: one
    aggregate, map-side to a row per partition and task."""
    fields = rows.schema.fields
    counts = [e for i, f in enumerate(fields) for e in (F.count(_q(f.name)).alias(f"c{i}"), _numeric_count(f).alias(f"m{i}"))]
    wide = rows.groupBy(_folder().alias("folder")).agg(F.count(F.lit(1)).alias("n_rows"), *counts)
    return wide.select("folder", "n_rows", F.array(*[F.struct(
        F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"),
        F.col(f"c{i}").alias("non_null"), F.col(f"m{i}").cast("bigint").alias("numeric"))
        for i, f in enumerate(fields)]).alias("columns"))


def refresh_profile(spark: SparkSession, table: str, state: str) -> int:
    """Bring a table's states up to date; how many partitions were read.

    A column that the table gained later has no values in the states of
    before; one whose type has changed makes the states with it stale."""
    with staged(folder_digests(spark, table), "profile-listing") as now:
        types = {f.name: f.dataType.simpleString() for f in spark.table(table).schema.fields}
        if spark.catalog.tableExists(state):
            spark.catalog.refreshTable(state)
            known = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
            kept = spark.table(state).where(F.col("table_name") == table).join(now, ["folder", "digest"], "left_semi") \
                .where(F.forall("columns", lambda c: F.coalesce(F.element_at(known, c["name"]) == c["type"], F.lit(True))))
        else:
            kept = spark.createDataFrame([], STATE_SCHEMA)
        new = now.join(kept, "folder", "left_anti")
        names = [r[0] for r in new.select("folder").collect()]        # a name per changed partition
        states = kept.drop("table_name")
        if names:
            # the filter on the folder is one on files: the others are not read
            rows = spark.table(table).where(_folder().isin(names))
            fresh = partition_states(rows).join(new, "folder").select("folder", "digest", "n_rows", "columns")
            states = states.unionByName(fresh)
        with staged(states.withColumn("table_name", F.lit(table)), "profile-states") as rows:
            if rows.isEmpty():
                if spark.catalog.tableExists(state):
                    spark.sql(f"ALTER TABLE {state} DROP IF EXISTS PARTITION (table_name = '{table}')")
            else:
                write_sink(rows, table=state, mode="overwrite", partition_by="table_name", partition_mode="dynamic")
    return len(names)


def merged_profile(spark: SparkSession, table: str, state: str) -> DataFrame:
    """(column_name, null_fraction, non_null, numeric) from the states, as
    ``clean.profile_frame`` gives it from the rows."""
    names = spark.table(table).columns
    states = spark.table(state).where(F.col("table_name") == table) if spark.catalog.tableExists(state) else \
        spark.createDataFrame([], STATE_SCHEMA)
    total = F.coalesce(F.sum(F.col("n_rows")), F.lit(0))

    def added(name: str, count: str) -> Column:
        own = F.filter("columns", lambda c: c["name"] == name)
        return F.coalesce(F.sum(F.aggregate(own, F.lit(0).cast("bigint"), lambda acc, c: acc + c[count])), F.lit(0))

    per_column = [added(n, k) for n in names for k in ("non_null", "numeric")]
    wide = states.agg(total.alias("rows"), *[e.alias(f"x{i}") for i, e in enumerate(per_column)])
    return wide.select(F.inline(F.array(*[F.struct(
        F.lit(n).alias("column_name"),
        F.when(F.col("rows") > 0, (F.col("rows") - F.col(f"x{2 * i}")) / F.col("rows")).alias("null_fraction"),
        F.col(f"x{2 * i}").alias("non_null"), F.col(f"x{2 * i + 1}").alias("numeric")) for i, n in enumerate(names)])))


def stored_profile(spark: SparkSession, table: str, state: str) -> list[ColumnProfile]:
    """Refresh, merge and collect: what ``clean.profile`` gives (a row per
    column), for ``preprocess`` and the drop of sparse columns."""
    refresh_profile(spark, table, state)
    types = {f.name: f.dataType.simpleString() for f in spark.table(table).schema.fields}
    return [ColumnProfile(r["column_name"], types[r["column_name"]], r["null_fraction"], r["non_null"], r["numeric"])
            for r in merged_profile(spark, table, state).collect()]
