"""Aggregation, imputation, top-k, semi-join and set operators.

All of these are plain DataFrame plans: grouped aggregates run as a
partial (map-side) + final ``HashAggregate`` pair, so a key holding a large
share of the rows is collapsed to one row per map task before the shuffle;
``orderBy().limit(k)`` plans as ``TakeOrderedAndProject`` (k rows per task).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import FEMALE_SHARE, MALE_SHARE, split_part


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def rollup(df: DataFrame, key: str | Sequence[str], sums: Sequence[str] = (),
           avgs: Sequence[str] = (), counts: Mapping[str, str] | None = None) -> DataFrame:
    """A1: detail rows to one row per entity: sums and averages keep the
    measure's name; ``counts`` maps an output name to ``*`` or a column."""
    keys = [key] if isinstance(key, str) else list(key)
    aggs = [F.sum(_q(c)).alias(c) for c in sums] + [F.avg(_q(c)).alias(c) for c in avgs]
    for out, c in (counts or {}).items():
        aggs.append((F.count(F.lit(1)) if c == "*" else F.count(_q(c))).alias(out))
    if not aggs:
        raise ValueError("rollup needs at least one measure")
    return df.groupBy(*[_q(k) for k in keys]).agg(*aggs)


def impute_split(df: DataFrame, total: str, parts: Mapping[str, float]) -> DataFrame:
    """Each zero part of a positive total becomes share x total; each
    part is imputed on its own (D19, kept)."""
    return df.withColumns({p: split_part(_q(total), _q(p), share) for p, share in parts.items()})


def impute_population(df: DataFrame, total: str = "SlumPopulationTotal",
                      male: str = "SlumPopulationMale",
                      female: str = "SlumPopulationFemale") -> DataFrame:
    return impute_split(df, total, {male: MALE_SHARE, female: FEMALE_SHARE})


def top_k(df: DataFrame, measure: str, k: int = 10, tie_break: Sequence[str] = (),
          cols: Sequence[str] | None = None) -> DataFrame:
    """The k largest rows by ``measure`` (NULLs last); ``tie_break``
    columns (ascending) make the cut repeatable."""
    out = df.orderBy(_q(measure).desc_nulls_last(), *[_q(c).asc() for c in tie_break]).limit(k)
    return out.select(*[_q(c) for c in cols]) if cols else out


def preview(df: DataFrame, n: int = 5, order_by: Sequence[str] = ()) -> DataFrame:
    """The first n rows; ordered first when a repeatable preview is needed."""
    return (df.orderBy(*[_q(c) for c in order_by]) if order_by else df).limit(n)


def group_means(df: DataFrame, key: str, measures: Sequence[str],
                suffix: str = "") -> DataFrame:
    """A3: mean of each measure per group."""
    return df.groupBy(_q(key)).agg(*[F.avg(_q(m)).alias(m + suffix) for m in measures])


def sorted_summary(df: DataFrame, key: str, measures: Sequence[str], sort_by: str) -> DataFrame:
    """A3 sorted by one of its means, descending."""
    return group_means(df, key, measures).orderBy(_q(sort_by).desc(), _q(key))


def group_counts(df: DataFrame, key: str, name: str = "City Count") -> DataFrame:
    """A2: rows per group."""
    return df.groupBy(_q(key)).agg(F.count(F.lit(1)).alias(name))


def semi_join_distinct(left: DataFrame, left_key: str, right: DataFrame,
                       right_key: str) -> DataFrame:
    """The distinct values of ``left_key`` that also occur in
    ``right_key`` (exact match; NULL never matches).

    Both sides are made distinct before the join, so each shuffles at most
    one row per key and map task: a key holding a third of the rows costs
    no more than any other."""
    lk = left.select(_q(left_key).alias(left_key)).where(_q(left_key).isNotNull()).distinct()
    rk = right.select(_q(right_key).alias("__k")).where(F.col("__k").isNotNull()).distinct()
    return lk.join(rk, _q(left_key) == F.col("__k"), "left_semi")


def union_distinct_counts(frames: Sequence[DataFrame], name: str = "count") -> DataFrame:
    """UNION (distinct) of the row counts of several frames, as the
    original does; equal counts collapse into one row (D11)."""
    parts = [f.agg(F.count(F.lit(1)).alias(name)) for f in frames]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def reconcile_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """One (table_name, row_count) row per table, by name (D11 fixed)."""
    parts = [f.agg(F.count(F.lit(1)).alias("row_count"))
              .select(F.lit(n).alias("table_name"), "row_count")
             for n, f in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distinct_joined(df: DataFrame, col: str, sep: str = ",") -> DataFrame:
    """Distinct non-NULL values of a column joined into one string
    (empty set gives ''), sorted so the string is repeatable.  The string is
    one row in one task: for partition columns only, whose values a table
    lists anyway.  The values are made distinct before they meet."""
    values = df.select(_q(col).cast("string").alias("__value")).distinct()
    return values.agg(F.concat_ws(sep, F.array_sort(F.collect_list("__value"))).alias(f"{col}_values"))
