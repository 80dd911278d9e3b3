"""S8 with P3-P5: landed JSON documents to one flat table.

Each document may hold its records under a key (``{"count": n, "entries":
[...]}``).  Documents are read by Spark (JSON Lines by default, so large
folders split; ``multi_line=True`` for one pretty-printed document per
file), the record list is exploded, nested objects are flattened (``a_b``,
or dotted on request), headers are normalised and only the allowed fields are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import normalize_field

# The default allowed field list (already normalised).
DEFAULT_FIELDS = ("ward name", "city", "api")


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """P5: nested structs become top-level columns named ``a<sep>b``; arrays
    stay arrays.  ``_`` by default, so no name needs backticks later; ``.``
    gives the dotted names of a JSON normaliser (the normalised headers are
    the same either way, since P3 drops both characters)."""
    cols: list[Column] = []

    def walk(dtype: T.StructType, path: list[str]):
        for f in dtype.fields:
            p = path + [f.name]
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, p)
            else:
                ref = F.col(".".join(f"`{x}`" for x in p))
                cols.append(ref.alias(sep.join(p)))

    walk(df.schema, [])
    return df.select(cols)


def select_fields(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Keep columns whose normalised header is allowed, renamed to it;
    when two headers normalise alike the last one wins (D21: raise when
    nothing matches, listing what is there)."""
    allowed = [normalize_field(a) for a in allowed]
    chosen: dict[str, str] = {}
    for c in df.columns:
        n = normalize_field(c)
        if n in allowed:
            chosen[n] = c
    if not chosen:
        raise ValueError(f"no allowed field found; available: {[normalize_field(c) for c in df.columns]}")
    return df.select([F.col(f"`{src}`").alias(norm) for norm, src in chosen.items()])


def read_json_records(spark: SparkSession, path: str, key: str | None = None,
                      fields: Sequence[str] | None = DEFAULT_FIELDS,
                      multi_line: bool = False, sep: str = "_",
                      schema=None) -> DataFrame:
    """Documents -> records -> flat, normalised, filtered table.  A
    document ``schema`` (DDL or StructType) skips the inference pass."""
    reader = spark.read.option("multiLine", str(multi_line).lower())
    if schema is not None:
        reader = reader.schema(schema)
    docs = reader.json(path)
    if key:
        recs = docs.select(F.explode(F.col(f"`{key}`")).alias("__r")).select("__r.*")
    else:
        recs = docs
    flat = flatten(recs, sep)
    return select_fields(flat, fields) if fields else flat
