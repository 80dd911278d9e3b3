"""Upsert (K7-K9, J2, K8) on plain Parquet tables and paths.

MERGE semantics reproduced: a target row matches an update row when all
keys are equal (NULL never matches) and the target's value of each
``partition_by`` column is among the update's values of it (K8).  Those
columns only narrow the match; the target need not be partitioned by them.
Matched rows take every column of the update; unmatched updates are
inserted; a target row matched by two update rows is an error.

Column names match without regard to case, as in SQL.

Plan: the batch is staged once.  The target's real partition columns come
from its own scan.  Only partitions that hold a matched row or receive an
update row are rewritten: their remaining rows (an anti join with the
update keys, the scan pruned by a typed IN list) and the updates are
written once, to a folder of their own.  A partition left without rows is
removed.  An unpartitioned target is one such partition.  The anti join
shuffles on the keys (or broadcasts them when AQE measures them small); a
hot key meets at most one update row, and AQE's skew handling splits the
large side.  A table that ``buckets.create_bucketed`` laid out by key hash
is rewritten bucket by bucket instead (see there).

A catalog table is switched to the new files by ``SET LOCATION`` (see
``versions``).  A plain folder, or a table whose partitions the catalog does
not keep, has its partition folders renamed one by one; if that breaks,
nothing is lost: both versions lie in the folder named by the error.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files, versions
from .writers import DEFAULT_FORMAT, _cols, create_table, staged, write_path


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def check_columns(target: DataFrame, updates: DataFrame) -> DataFrame:
    """The updates under the target's column names, in its order.  Both must
    have the same columns, but for case; nothing is dropped or made up."""
    sensitive = target.sparkSession.conf.get("spark.sql.caseSensitive") == "true"

    def key(name: str) -> str:
        return name if sensitive else name.lower()

    have: dict[str, list[str]] = {}
    for c in updates.columns:
        have.setdefault(key(c), []).append(c)
    missing = [c for c in target.columns if key(c) not in have]
    extra = [c for c in updates.columns if key(c) not in map(key, target.columns)]
    if missing or extra or any(len(v) > 1 for v in have.values()):
        raise ValueError(f"updates do not match the target: missing {missing}, extra {extra}")
    return updates.select(*[_quoted(have[key(c)][0]).alias(c) for c in target.columns])


def _own_names(target: DataFrame, names: list[str]) -> list[str]:
    """Column names as the target writes them."""
    own = {c.lower(): c for c in target.columns}
    return [n if n in target.columns else own.get(n.lower(), n) for n in names]


def partition_values(updates: DataFrame, p: str) -> list:
    """Distinct non-NULL values of a column in the batch, as typed Python
    values (F5).  For partition columns these name partitions of the target
    or ones the batch creates, a list that the write keeps anyway."""
    return [r[0] for r in updates.select(_quoted(p)).where(_quoted(p).isNotNull()).distinct().collect()]


def match_predicate(updates: DataFrame, parts: list[str]) -> Column:
    """K8: the target rows that may match, per column independently
    (``p1 IN (...) AND p2 IN (...)``); a NULL matches nothing (D18)."""
    inside = F.lit(True)
    for p in parts:
        inside = inside & F.coalesce(_quoted(p).isin(partition_values(updates, p)), F.lit(False))
    return inside


def check_single_match(target: DataFrame, updates: DataFrame, keys: list[str]) -> None:
    """Raise when one target row would match more than one update row.  The
    target is read only if the batch has repeated keys at all."""
    nonnull = F.lit(True)
    for k in keys:
        nonnull = nonnull & _quoted(k).isNotNull()
    dups = updates.where(nonnull).groupBy(*[_quoted(k) for k in keys]).count().where("`count` > 1").select(
        *[_quoted(k) for k in keys])
    if dups.isEmpty():
        return
    hit = dups.join(target.select(*[_quoted(k) for k in keys]), keys, "left_semi").limit(1).collect()
    if hit:
        raise ValueError(f"several update rows match one target row, e.g. keys {hit[0].asDict()}")


def _key_join(target: DataFrame, updates: DataFrame, keys: list[str], inside: Column, how: str) -> DataFrame:
    names = [f"__key{i}" for i in range(len(keys))]
    side = updates.select(*[_quoted(k).alias(n) for k, n in zip(keys, names)])
    on = inside
    for k, n in zip(keys, names):
        on = on & (_quoted(k) == F.col(n))
    return target.join(side, on, how)


def merge_frames(target: DataFrame, updates: DataFrame, keys: str | Sequence[str],
                 partition_by: str | Sequence[str] | None = None, check: bool = True) -> DataFrame:
    """The rows of ``target`` after the MERGE.  ``upsert`` calls it with the
    part of the target that it rewrites."""
    keys, parts = _cols(keys), _cols(partition_by)
    if not keys:
        raise ValueError("upsert needs merge keys (D7)")
    updates = check_columns(target, updates)
    inside = match_predicate(updates, parts)
    if check:
        check_single_match(target.where(inside), updates, keys)
    kept = _key_join(target, updates, keys, inside, "left_anti")
    return kept.unionByName(updates.select(*[_quoted(c) for c in target.columns]))


def _named(df: DataFrame, rows: list, parts: list[str]) -> DataFrame:
    """The rows of the partitions named by ``rows`` (NULL is a value): an IN
    list per column prunes the scan, a semi join on all of them is exact."""
    out = df
    for i, p in enumerate(parts):
        values = {r[i] for r in rows}
        named = _quoted(p).isin([v for v in values if v is not None])
        out = out.where(named | _quoted(p).isNull() if None in values else named)
    if len(parts) > 1:
        names = [f"__part{i}" for i in range(len(parts))]
        schema = ", ".join(f"{n} {df.schema[p].dataType.simpleString()}" for n, p in zip(names, parts))
        side = df.sparkSession.createDataFrame([tuple(r) for r in rows], schema)
        on = F.lit(True)
        for p, n in zip(parts, names):
            on = on & _quoted(p).eqNullSafe(F.col(n))
        out = out.join(side, on, "left_semi")
    return out


def _rewrite(spark: SparkSession, target: DataFrame, updates: DataFrame, keys: list[str],
             predicate: list[str], fmt: str, table: str | None) -> None:
    """Write the touched partitions of a table or folder anew and switch to
    them: by the catalog for a ``table``, by renaming folders else."""
    (root,) = files.scan_roots(target)
    parts = files.partition_columns(target)
    inside = match_predicate(updates, predicate)
    check_single_match(target.where(inside), updates, keys)
    side = f"{files.parent(root)}/.upsert-{uuid.uuid4().hex[:12]}"
    new = versions.new_folder(root, bool(parts)) if table else f"{side}/new"
    old: dict = {}
    try:
        if parts:
            cols = [_quoted(p) for p in parts]
            matched = _key_join(target, updates, keys, inside, "left_semi").select(*cols)
            touched = matched.union(updates.select(*cols)).distinct().collect()
            part = _named(target, touched, parts)
            old = versions.folders_now(part, parts)
        else:
            part = target
        kept = _key_join(part, updates, keys, inside, "left_anti")
        result = kept.unionByName(updates.select(*[_quoted(c) for c in target.columns]))
        writer = result
        if parts:
            # rows of one partition together, large partitions in several tasks
            writer = result.hint("rebalance", *[_quoted(p) for p in parts])
        writer.write.format(fmt).partitionBy(*parts).save(new)
        if table:
            if parts:
                versions.switch_partitions(spark, table, root, old, versions.folders_written(spark, new))
            else:
                versions.switch_table(spark, table, root, new)
    except BaseException:
        files.delete_path(spark, new if table else side)
        raise
    if table:
        return
    old_folders = sorted(f[len(root):].strip("/") for f in old.values()) if parts else [""]
    try:
        for rel in old_folders:
            files.move(spark, f"{root}/{rel}".rstrip("/"), f"{side}/old/{rel}".rstrip("/"))
        for rel in files.leaf_folders(spark, new) if parts else [""]:
            files.move(spark, f"{new}/{rel}".rstrip("/"), f"{root}/{rel}".rstrip("/"))
    except Exception as exc:
        raise OSError(f"the swap broke off; the old and new files are under {side}") from exc
    files.delete_path(spark, side)


def delta_upsert(updates: DataFrame, keys: list[str], parts: list[str], table: str | None,
                 path: str | None) -> bool:
    """K7-K9 with Delta's own MERGE, used when ``fmt="delta"`` and the
    delta-spark package is importable (not installed in this environment).
    Same match rule: keys equal, and the target's partition value among the
    batch's (a typed IN list)."""
    try:
        from delta.tables import DeltaTable
    except ImportError as exc:
        raise RuntimeError("format 'delta' needs the delta-spark package and its jar") from exc
    spark = updates.sparkSession
    if table and not spark.catalog.tableExists(table):
        create_table(updates, table, "delta", parts)
        return True
    if path and not files.has_entries(spark, path):
        write_path(updates, path, "append", "delta", parts, on_empty="write")
        return True
    target = DeltaTable.forName(spark, table) if table else DeltaTable.forPath(spark, path)
    cond = None
    for k in keys:
        c = F.col(f"existing.`{k}`") == F.col(f"updates.`{k}`")
        cond = c if cond is None else cond & c
    for p in parts:
        cond = cond & F.col(f"existing.`{p}`").isin(partition_values(updates, p))
    (target.alias("existing").merge(updates.alias("updates"), cond)
     .whenMatchedUpdateAll().whenNotMatchedInsertAll().execute())
    return True


def upsert(updates: DataFrame, keys: str | Sequence[str] | None, *, table: str | None = None,
           path: str | None = None, partition_by: str | Sequence[str] | None = None,
           fmt: str = DEFAULT_FORMAT, on_empty: str = "skip", n_buckets: int | None = None) -> bool:
    """K7 + K8 + K9 on a table (``table``) or a folder (``path``).

    ``partition_by`` narrows the match; for a target that this call creates
    it is the partitioning too.  ``n_buckets`` makes a table that this call
    creates a bucketed one (see ``buckets``).  A folder is created only when the file
    system says that it is absent or empty; one that cannot be read as
    ``fmt`` is an error and stays as it is."""
    from . import buckets

    spark: SparkSession = updates.sparkSession
    keys = _cols(keys)
    parts = _cols(partition_by)
    if not keys:
        raise ValueError("upsert needs merge keys (D7)")
    if not table and not path:
        raise ValueError("upsert needs a table or a path")
    if fmt == "delta":
        return False if on_empty == "skip" and updates.isEmpty() else \
            delta_upsert(updates, keys, parts, table, path)
    # The batch is read several times below (values, keys, the duplicate
    # check, the union).  Staging it once in the shared folder makes those
    # reads agree even for a non-deterministic source and cuts its lineage,
    # so a lost executor re-reads files instead of recomputing.
    with staged(updates, "upsert-batch") as updates:
        if on_empty == "skip" and updates.isEmpty():
            return False
        if table and not spark.catalog.tableExists(table):             # K9
            if n_buckets:
                if parts:
                    raise ValueError("a bucketed table is partitioned by its buckets only")
                buckets.create_bucketed(updates, table, keys, n_buckets, fmt)
            else:
                create_table(updates, table, fmt, parts)
            return True
        if path and not files.has_entries(spark, path):                # K9 for paths
            write_path(updates, path, "append", fmt, parts, on_empty="write")
            return True
        if table:
            spark.catalog.refreshTable(table)
        target = spark.table(table) if table else spark.read.format(fmt).load(path)
        keys, parts = _own_names(target, keys), _own_names(target, parts)
        if table and buckets.is_bucketed(spark, table):
            buckets.merge(spark, table, target, updates, keys, parts)
            return True
        updates = _typed(target, check_columns(target, updates))
        if not table:
            _rewrite(spark, target, updates, keys, parts, fmt, None)
            spark.catalog.refreshByPath(path)
            return True
        properties = versions.table_properties(spark, table)
        fmt = properties.get("Provider", fmt)
        known = versions.switchable(properties, bool(files.partition_columns(target)))
        _rewrite(spark, target, updates, keys, parts, fmt, table if known else None)
        spark.catalog.refreshTable(table)
    return True


def _typed(target: DataFrame, updates: DataFrame) -> DataFrame:
    return updates.select(*[_quoted(f.name).cast(f.dataType).alias(f.name) for f in target.schema.fields])
