"""Column-name rules (P1, P2, P3) and the rename helper with clash checks.

These run on the driver over the list of column names only; no row data
is touched, and the rename is a single ``toDF`` projection that Catalyst
collapses into the scan.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

# Characters removed from a header on the way to silver, and
# the one character replaced there ("-" becomes "_").
SILVER_DELETE = (" ", "(", ")")
SILVER_REPLACE = {"-": "_"}

_NON_ALNUM = re.compile(r"[^A-Za-z0-9]+")
_SPECIAL = re.compile(r"[^a-zA-Z0-9\s]")


def silver_name(name: str) -> str:
    """Delete spaces and round brackets, turn dashes into underscores."""
    for ch in SILVER_DELETE:
        name = name.replace(ch, "")
    for src, dst in SILVER_REPLACE.items():
        name = name.replace(src, dst)
    return name


def nice_case(name: str, sep: str = "") -> str:
    """Runs of non-alphanumerics split words; each word gets an upper-case
    first letter (the rest is kept) and the words are joined with ``sep``.

    Returns "" for an all-symbol header; ``rename_columns`` substitutes
    ``Col<n>`` there (D15).
    """
    words = _NON_ALNUM.sub(" ", name).split()
    return sep.join(w[0].upper() + w[1:] for w in words)


def normalize_field(name: str) -> str:
    """Collapse whitespace, fold accents to ASCII, drop special
    characters, lower-case.  The steps are chained (D10 fixed)."""
    s = " ".join(name.split())
    s = unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii")
    s = _SPECIAL.sub("", s)
    return " ".join(s.split()).lower()


def renamed(columns: Iterable[str], rule: Callable[[str], str]) -> list[str]:
    """Apply a name rule; fall back to ``Col<n>`` for empty results and raise
    if two different source names land on the same target (D14)."""
    cols = list(columns)
    out = []
    for i, c in enumerate(cols):
        new = rule(c)
        out.append(new if new else f"Col{i}")
    counts = Counter(n.lower() for n in out)
    clashes = {n for n, k in counts.items() if k > 1}
    if clashes:
        detail = "; ".join(
            f"{', '.join(repr(c) for c, n in zip(cols, out) if n.lower() == k)} -> {k!r}"
            for k in sorted(clashes))
        raise ValueError(f"column names collide after renaming: {detail}")
    return out


def rename_columns(df: DataFrame, rule: Callable[[str], str]) -> DataFrame:
    """One projection that renames every column by ``rule``."""
    return df.toDF(*renamed(df.columns, rule))


def clean_silver_names(df: DataFrame) -> DataFrame:
    return rename_columns(df, silver_name)


def nice_case_names(df: DataFrame, sep: str = "") -> DataFrame:
    return rename_columns(df, lambda c: nice_case(c, sep))


def normalize_names(df: DataFrame) -> DataFrame:
    return rename_columns(df, normalize_field)
