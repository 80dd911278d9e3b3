"""Content reconciliation of two tables (W7): not only how many rows each
has, but whether they are the same rows, and where they differ.

Every row is hashed over its columns (as text, so layers that store a value
in another type agree); a key range's checksum is the sums of the two halves
of its rows' hashes.  Sums do not depend on the order of the rows and,
unlike exclusive or, notice a row that is there twice.  Both tables are
aggregated map-side to one row per range; only the ranges whose checksums
differ are read again, with the range pushed down to the scan, to find the
rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

N_RANGES = 64
_HALF = 1 << 32
_ORDERED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType)


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def row_hash(columns: Sequence[str]) -> Column:
    """XXH64 of the values as text; NULL is not the empty text."""
    parts = []
    for c in columns:
        parts += [_q(c).isNull(), _q(c).cast("string")]
    return F.xxhash64(*parts)


def range_bounds(df: DataFrame, key: str, n_ranges: int = N_RANGES) -> list:
    """Keys that cut the table into ranges of about as many rows: for
    numbers, approximate quantiles from one aggregate; for other types that
    can be ordered, the quantiles of a bounded sample of the distinct keys'
    hash order.  The list has fewer than ``n_ranges`` keys."""
    if not isinstance(df.schema[key].dataType, _ORDERED):
        raise ValueError(f"the key {key!r} cannot be ordered")
    if isinstance(df.schema[key].dataType, T.NumericType):
        cuts = df.agg(F.percentile_approx(_q(key), [i / n_ranges for i in range(1, n_ranges)], 100 * n_ranges)).first()[0]
        return sorted(set(cuts or []))
    sample = df.select(_q(key).alias("k")).where("k IS NOT NULL").distinct().orderBy(F.xxhash64("k"), "k").limit(
        50 * n_ranges)
    keys = sorted(r["k"] for r in sample.collect())
    return sorted({keys[i * len(keys) // n_ranges] for i in range(1, n_ranges)}) if keys else []


def in_range(key: str, bounds: list, number: int) -> Column:
    """Whether a key lies in range ``number``: from bound number - 1 up to
    but not with bound number; NULL keys are range -1."""
    if number < 0:
        return _q(key).isNull()
    inside = _q(key).isNotNull()
    if number > 0:
        inside = inside & (_q(key) >= F.lit(bounds[number - 1]))
    if number < len(bounds):
        inside = inside & (_q(key) < F.lit(bounds[number]))
    return inside


def checksums(df: DataFrame, key: str, bounds: list, columns: Sequence[str]) -> DataFrame:
    """(range, n_rows, low, high): rows and checksum of every key range."""
    cuts = F.array(*[F.lit(b) for b in bounds]).cast(T.ArrayType(df.schema[key].dataType)) if bounds else None
    place = F.size(F.filter(cuts, lambda b: b <= _q(key))) if bounds else F.lit(0)
    h = row_hash(columns)
    rows = df.select(F.when(_q(key).isNull(), -1).otherwise(place).alias("range"), h.alias("h"))
    # a sum of halves of 2^31 rows stays below 2^63; decimals go on from there
    return rows.groupBy("range").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col("h").bitwiseAND(_HALF - 1).cast("decimal(20,0)")).alias("low"),
        F.sum(F.shiftrightunsigned("h", 32).cast("decimal(20,0)")).alias("high"))


def reconcile_content(left: DataFrame, right: DataFrame, key: str, n_ranges: int = N_RANGES,
                      columns: Sequence[str] | None = None, bounds: list | None = None) -> DataFrame:
    """(range, first_key, end_key, left_rows, right_rows, same): one row per
    key range that either table has rows in; ``end_key`` is the first key
    after it.  ``columns`` are compared (all of ``left`` by default)."""
    columns = list(columns or left.columns)
    for side, df in (("left", left), ("right", right)):
        missing = [c for c in [key, *columns] if c not in df.columns]
        if missing:
            raise ValueError(f"the {side} table lacks the columns {missing}")
    bounds = range_bounds(left, key, n_ranges) if bounds is None else bounds
    a, b = checksums(left, key, bounds, columns), checksums(right, key, bounds, columns)
    both = a.alias("a").join(b.alias("b"), F.col("a.range") == F.col("b.range"), "full_outer")
    number = F.coalesce("a.range", "b.range")
    kind = left.schema[key].dataType
    keys = F.array(*[F.lit(x) for x in bounds]).cast(T.ArrayType(kind)) if bounds else \
        F.array().cast(T.ArrayType(kind))
    same = (F.col("a.n_rows").eqNullSafe(F.col("b.n_rows")) & F.col("a.low").eqNullSafe(F.col("b.low"))
            & F.col("a.high").eqNullSafe(F.col("b.high")))
    return both.select(
        number.alias("range"), F.when(number > 0, F.get(keys, (number - 1).cast("int"))).alias("first_key"),
        F.when(number >= 0, F.get(keys, number.cast("int"))).alias("end_key"),
        F.coalesce("a.n_rows", F.lit(0)).alias("left_rows"), F.coalesce("b.n_rows", F.lit(0)).alias("right_rows"),
        same.alias("same"))


def differing_rows(left: DataFrame, right: DataFrame, key: str, n_ranges: int = N_RANGES,
                   columns: Sequence[str] | None = None) -> DataFrame:
    """(side, copies, columns…): the rows that only one side has, or has more
    often (``copies`` times more), from the ranges that differ."""
    columns = list(columns or left.columns)
    bounds = range_bounds(left, key, n_ranges)
    found = reconcile_content(left, right, key, n_ranges, columns, bounds)
    numbers = [r["range"] for r in found.where("NOT same").select("range").collect()]       # n_ranges + 1 at most
    where = F.lit(False)
    for n in numbers:
        where = where | in_range(key, bounds, n)

    def counted(df: DataFrame) -> DataFrame:
        rows = df.where(where).select(*[_q(c).cast("string").alias(c) for c in columns])
        return rows.groupBy(*map(_q, columns)).agg(F.count(F.lit(1)).alias("__copies"))

    on = [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in columns]
    both = counted(left).alias("a").join(counted(right).alias("b"), on, "full_outer")
    more = F.coalesce("a.__copies", F.lit(0)) - F.coalesce("b.__copies", F.lit(0))
    return both.select(
        F.when(more > 0, "left").otherwise("right").alias("side"), F.abs(more).alias("copies"),
        *[F.when(F.col("a.__copies").isNotNull(), F.col(f"a.`{c}`")).otherwise(F.col(f"b.`{c}`")).alias(c)
          for c in columns]).where("copies > 0")
