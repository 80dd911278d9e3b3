"""Types of CSV columns from the pass that copies the file.

Schema inference reads a whole CSV once more.  The bronze copy has every cell
in hand anyway, so it counts, per column, the cells that are surely a whole
number, a decimal, a truth value or text: partial aggregates, observed while
the copy is written.  Where these settle a column's type it is the one that
inference finds; a column with any cell that they do not settle (a date, an
exponent, a padded number, 19 digits) leaves the file to inference.

Inference widens: whole numbers that fit 32 bits, 64 bits, then double;
anything that mixes kinds is text, and so is a column without values.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..sinks import files

TYPES_FILE = "_column_types"
# What inference reads as these kinds under its default options,
# and words that begin with a letter and are no text to it.
WHOLE = "^[+-]?[0-9]{1,18}$"
DECIMAL = "^[+-]?[0-9]{0,200}[.][0-9]{1,200}$"
TRUTH = "^(?i:true|false)$"
LETTER_FIRST = "^\\s*\\p{L}"
NOT_TEXT = "^\\s*(?i:nan|inf|infinity|true|false|epoch|now|today|tomorrow|yesterday|t[0-9].*)\\s*[dDfF]?\\s*$"
# Reading options under which inference means the same.
NEUTRAL = {"header", "inferschema", "sep", "delimiter", "quote", "escape", "chartoescapequoteescaping",
           "unescapedquotehandling", "multiline", "linesep", "encoding", "charset", "comment", "maxcolumns",
           "maxcharspercolumn", "nullvalue"}


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def settles(options: Mapping[str, str]) -> bool:
    """Whether types are wanted and the options leave inference at its
    defaults."""
    low = {k.lower(): v for k, v in options.items()}
    return low.get("inferschema", "false").lower() == "true" and set(low) <= NEUTRAL


def counts(columns: list[str], null_value: str) -> list[Column]:
    """The aggregates to observe, six for each column."""
    out = []
    for i, name in enumerate(columns):
        c = _q(name)
        there = c.isNotNull() & (c != "") & (c != F.lit(null_value))
        whole = c.rlike(WHOLE)
        value = F.when(whole, c).try_cast("bigint")
        out += [F.count_if(there).alias(f"n{i}"),
                F.count_if(there & value.between(-(1 << 31), (1 << 31) - 1)).alias(f"i{i}"),
                F.count_if(there & whole).alias(f"l{i}"),
                F.count_if(there & c.rlike(DECIMAL)).alias(f"d{i}"),
                F.count_if(there & c.rlike(TRUTH)).alias(f"b{i}"),
                F.count_if(there & c.rlike(LETTER_FIRST) & ~c.rlike(NOT_TEXT)).alias(f"t{i}")]
    return out


def settled(columns: list[str], seen: Mapping[str, int]) -> list[tuple[str, str]] | None:
    """(column, type) of all columns, None if one of them is open."""
    out = []
    for i, name in enumerate(columns):
        n, ints, whole, decimal, truth, text = (seen[f"{k}{i}"] for k in "nildbt")
        if text or not n:
            kind = "string"
        elif ints == n:
            kind = "int"
        elif whole == n:
            kind = "bigint"
        elif whole + decimal == n:
            kind = "double"
        elif truth == n:
            kind = "boolean"
        else:
            return None
        out.append((name, kind))
    return out


def keep(spark: SparkSession, bronze_path: str, types: list[tuple[str, str]], null_value: str) -> None:
    files.write_text(spark, f"{bronze_path.rstrip('/')}/{TYPES_FILE}", json.dumps({"null": null_value, "types": types}))


def kept(spark: SparkSession, bronze_path: str, options: Mapping[str, str]) -> str | None:
    """The columns of a bronze copy as DDL, if the copy settled them and the
    file is read by the same rules."""
    if not settles(options):
        return None
    text = files.read_text(spark, f"{bronze_path.rstrip('/')}/{TYPES_FILE}")
    if text is None:
        return None
    found = json.loads(text)
    if found["null"] != null_value_of(options):
        return None
    return ", ".join("`" + n.replace("`", "``") + f"` {t}" for n, t in found["types"])


def null_value_of(options: Mapping[str, str]) -> str:
    return next((v for k, v in options.items() if k.lower() == "nullvalue"), "")

