"""Cleaning operators: sentinel handling, profiling, sparse-column drop,
type coercion, zero fill, and the whole preprocessing pipeline (P15).

The original notebooks profile a frame with 2 + N jobs (a count, a null-fraction
collect, and one distinct-collect per column).  Here one aggregate job
computes, for every column at once, the null fraction and how many
non-null values look numeric; only that single row reaches the driver.
Partial aggregation keeps the job map-side heavy, so it scales with the
table and is indifferent to skew.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import nice_case, nice_case_names
from ..functions.values import (NA_PATTERN, NA_SENTINEL, is_numeric_text,
                                na_to_null, pattern_to_null)

_NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                  T.FloatType, T.DoubleType, T.DecimalType)


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def is_string(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.StringType, T.VarcharType, T.CharType))


# --------------------------------------------------------------------- P6

def drop_columns(df: DataFrame, cols: Iterable[str], also_nice_case: bool = True) -> DataFrame:
    """Drop named columns; unknown names are ignored.  With
    ``also_nice_case`` the NiceCase form of each name is dropped as well, so
    a raw name such as ``WardNo.`` still removes ``WardNo`` (D15)."""
    names = set(cols)
    if also_nice_case:
        names |= {nice_case(c) for c in cols}
    return df.drop(*[c for c in df.columns if c in names])


# ------------------------------------------------------------- P9 / P10

def replace_sentinel(df: DataFrame, sentinel: str = NA_SENTINEL) -> DataFrame:
    """The whole cell ``sentinel`` becomes NULL in every string column.
    Other types are left alone (comparing them to a string fails under ANSI, D16)."""
    return df.select([
        na_to_null(_q(f.name), sentinel).alias(f.name) if is_string(f) else _q(f.name)
        for f in df.schema.fields])


def replace_pattern(df: DataFrame, pattern: str = NA_PATTERN,
                    cols: Sequence[str] | None = None) -> DataFrame:
    """P10: cells matching a regex become NULL; non-matching cells keep their
    value (D9 fixed).  String columns only unless ``cols`` names others,
    which are compared as text."""
    targets = set(cols) if cols is not None else {f.name for f in df.schema.fields if is_string(f)}
    out = []
    for f in df.schema.fields:
        c = _q(f.name)
        if f.name in targets:
            if is_string(f):
                out.append(pattern_to_null(c, pattern).alias(f.name))
            else:
                out.append(F.when(c.cast("string").rlike(pattern), F.lit(None))
                           .otherwise(c).alias(f.name))
        else:
            out.append(c)
    return df.select(out)


# ------------------------------------------------------------- A4 / A5

@dataclass(frozen=True)
class ColumnProfile:
    name: str
    data_type: str
    null_fraction: float | None
    non_null: int
    numeric: int

    def is_numeric(self, fraction: float = 1.0) -> bool:
        return self.non_null > 0 and self.numeric >= fraction * self.non_null


def _numeric_count(f: T.StructField) -> Column:
    c = _q(f.name)
    if isinstance(f.dataType, _NUMERIC_TYPES + (T.BooleanType,)):
        return F.count(c)
    if is_string(f):
        return F.count_if(is_numeric_text(c))
    return F.lit(0).cast("long")


def profile_exprs(df: DataFrame) -> list[Column]:
    """Aggregate expressions for the one-pass profile: per column, its null
    fraction (A4, ``avg`` so zero rows give NULL, D17), its non-null count
    and its count of numeric-looking values (A5)."""
    exprs = []
    for i, f in enumerate(df.schema.fields):
        c = _q(f.name)
        exprs += [F.avg(c.isNull().cast("int")).alias(f"n{i}"),
                  F.count(c).alias(f"c{i}"),
                  _numeric_count(f).alias(f"m{i}")]
    return exprs


def profile_frame(df: DataFrame) -> DataFrame:
    """A4 + A5 as a distributed frame: one row per column of ``df``
    (column_name, null_fraction, non_null, numeric).  One scan; the wide
    one-row aggregate is turned into rows with ``stack``."""
    if not df.columns:
        raise ValueError("cannot profile a frame without columns")
    wide = df.agg(*profile_exprs(df))
    n = len(df.columns)
    args = ", ".join(
        f"{_sql_str(name)}, CAST(n{i} AS DOUBLE), CAST(c{i} AS BIGINT), CAST(m{i} AS BIGINT)"
        for i, name in enumerate(df.columns))
    return wide.selectExpr(
        f"stack({n}, {args}) AS (column_name, null_fraction, non_null, numeric)")


def _sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def profile(df: DataFrame) -> list[ColumnProfile]:
    """The one-row profile collected to the driver (size: 3 values per column)."""
    row = df.agg(*profile_exprs(df)).first()
    return [ColumnProfile(f.name, f.dataType.simpleString(), row[f"n{i}"],
                          int(row[f"c{i}"]), int(row[f"m{i}"]))
            for i, f in enumerate(df.schema.fields)]


def null_fractions(df: DataFrame) -> DataFrame:
    """A4 as a one-row frame: each column holds its null fraction."""
    return df.agg(*[F.avg(_q(c).isNull().cast("int")).alias(c) for c in df.columns])


# --------------------------------------------------------------- P7

def sparse_columns(profiles: Sequence[ColumnProfile], threshold: float) -> list[str]:
    return [p.name for p in profiles
            if p.null_fraction is not None and p.null_fraction > threshold]


def drop_sparse(df: DataFrame, threshold: float = 0.3,
                profiles: Sequence[ColumnProfile] | None = None) -> DataFrame:
    """Drop columns whose null fraction is strictly above ``threshold``."""
    profiles = profiles if profiles is not None else profile(df)
    return df.drop(*sparse_columns(profiles, threshold))


# -------------------------------------------------------------- P11

def numeric_columns(profiles: Sequence[ColumnProfile], fraction: float = 1.0) -> list[str]:
    return [p.name for p in profiles if p.is_numeric(fraction)]


def coerce_types(df: DataFrame, numeric: Iterable[str], numeric_type: str = "double",
                 keep_temporal: bool = True) -> DataFrame:
    """Numeric columns become ``numeric_type`` (``try_cast``, so a stray
    value under a fractional rule becomes NULL instead of failing); other
    columns become strings, except dates and timestamps, which keep their
    type (D2)."""
    numeric = set(numeric)
    out = []
    for f in df.schema.fields:
        c = _q(f.name)
        if f.name in numeric:
            out.append(c.try_cast(numeric_type).alias(f.name))
        elif keep_temporal and isinstance(f.dataType, (T.DateType, T.TimestampType,
                                                       T.TimestampNTZType)):
            out.append(c)
        elif is_string(f):
            out.append(c)
        else:
            out.append(c.cast("string").alias(f.name))
    return df.select(out)


# -------------------------------------------------------------- P12

def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULL (and NaN) become 0 in the given numeric columns."""
    return df.fillna(0, subset=list(cols)) if cols else df


# -------------------------------------------------------------- P15

@dataclass
class Preprocessed:
    frame: DataFrame
    numeric_cols: list[str]
    dropped: list[str]
    profiles: list[ColumnProfile]


def preprocess(df: DataFrame, null_threshold: float = 0.3, numeric_fraction: float = 1.0,
               numeric_type: str = "double", sentinel: str = NA_SENTINEL) -> Preprocessed:
    """NiceCase names -> sentinel to NULL -> drop sparse columns ->
    coerce types -> zero-fill numerics.  One profiling job in all."""
    df = replace_sentinel(nice_case_names(df), sentinel)
    profiles = profile(df)
    dropped = sparse_columns(profiles, null_threshold)
    kept = [p for p in profiles if p.name not in set(dropped)]
    numeric = numeric_columns(kept, numeric_fraction)
    out = coerce_types(df.drop(*dropped), numeric, numeric_type)
    return Preprocessed(fill_zero(out, numeric), numeric, dropped, profiles)


# --------------------------------------------------------------- F1

def exclude_values(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """drop rows whose ``col`` equals one of ``values`` (exact match).
    Rows with a NULL ``col`` drop too, as in the three-valued original."""
    return df.filter(~_q(col).isin(list(values)))
