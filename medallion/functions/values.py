"""Column expressions shared by the operators (all built-in, codegen-friendly)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
# The whole cell that marks a missing value in the raw files.
NA_SENTINEL = "NA"
# Default pattern for the loose "na" marker (any case, surrounding blanks).
NA_PATTERN = r"(?i)^\s*na\s*$"
# A number as text: optional sign, digits with optional fraction (or a bare
# fraction), optional exponent, blanks allowed around it.  Used both by
# Spark (rlike) and by the DuckDB oracle (regexp_full_match).
NUMERIC_PATTERN = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
# Shares used to split a known total into two parts.
MALE_SHARE = 0.52
FEMALE_SHARE = 0.48
# Literal cluster-id labels: 0 -> Medium, 1 -> Small, anything else -> Large.
CLUSTER_LABELS = {0: "Medium", 1: "Small"}
CLUSTER_LABEL_OTHER = "Large"
# Rank labels, smallest mean first.
RANK_LABELS = ("Small", "Medium", "Large")


def na_to_null(c: Column, sentinel: str = NA_SENTINEL) -> Column:
    """The exact cell ``sentinel`` becomes NULL (string columns only)."""
    return F.nullif(c, F.lit(sentinel))


def pattern_to_null(c: Column, pattern: str = NA_PATTERN) -> Column:
    """P10: cells matching ``pattern`` become NULL, others keep their value."""
    return F.when(c.rlike(pattern), F.lit(None)).otherwise(c)


def is_numeric_text(c: Column) -> Column:
    return c.rlike(NUMERIC_PATTERN)


def split_part(total: Column, part: Column, share: float) -> Column:
    """A zero part of a positive total becomes ``share * total``."""
    return F.when((total > 0) & (part == 0), F.lit(share) * total).otherwise(part)


def label_by_map(c: Column, mapping: Mapping[int, str] = CLUSTER_LABELS,
                 other: str = CLUSTER_LABEL_OTHER) -> Column:
    """Chained CASE over a dict of id -> label."""
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == k, v) if expr is None else expr.when(c == k, v)
    return F.lit(other) if expr is None else expr.otherwise(other)
