"""Line dedup: repeated long lines stay in one document only.

Lines are exploded and normalised, hashed (MD5, 128 bits), and the distinct
documents of each hash counted.  A line at or over the threshold is dropped
from every document but the one with the largest id.  The places of dropped
lines are gathered per row, known by the MD5 of its id and text, and the
documents put together again by position, in time that grows with their
lines.  Hashes, ids and places are shuffled to count, the texts once to drop.

Defined cases: a null or empty text is one empty line and comes back as an
empty text; rows of one id count as one document; rows without an id are one
document below all others, or with ``null_rows_apart`` each a document of its
own (equal ones are one); lines shorter than ``min_chars`` code points are
never counted; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, staged

MIN_CHARS = 40
MIN_DOCS = 5
_SPACES = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_SPACES)), _UPPER, _UPPER.lower())


def _hash(key: Column) -> Column:
    return F.unhex(F.md5(key.cast("binary")))


def _keyed(docs: DataFrame, apart: bool) -> DataFrame:
    """With ``key`` (the row, by id and text) and ``own`` (what tells rows
    without an id apart, else null)."""
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"),
                                 F.coalesce("text", F.lit(""))).cast("binary")))
    own = F.when(F.col("doc_id").isNull(), F.col("key")) if apart else F.lit(None).cast("binary")
    return docs.withColumn("key", key).withColumn("own", own)


def long_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, doc_id, own, pos, hash) of every long line.  The keys are made
    inside the arrays, so that no filter makes them a second time."""
    def line(x: Column, i: Column) -> Column:
        k = F.when(F.char_length(x) >= min_chars, line_key(x))
        return F.struct(i.alias("pos"), F.when(F.char_length(k) >= min_chars, _hash(k)).alias("hash"))
    found = F.filter(F.transform(split_lines(F.col("text")), line), lambda s: s["hash"].isNotNull())
    return docs.select("key", "doc_id", "own", F.explode(found).alias("line")).select(
        "key", "doc_id", "own", "line.pos", "line.hash")


def repeated_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(hash, keeper, n_docs) of hashes in at least ``min_docs`` documents."""
    return lines.select("hash", "doc_id", "own").distinct().groupBy("hash").agg(
        F.count(F.lit(1)).alias("n_docs"), F.max(F.struct("doc_id", "own")).alias("keeper")).where(
        F.col("n_docs") >= min_docs)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                min_docs: int = MIN_DOCS, carry: bool = False, null_rows_apart: bool = False) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): one row per input row; with
    ``carry`` also ``row``, a struct of the input's columns but the text."""
    rows = [F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("row")] if carry else []
    lines = long_lines(_keyed(id_text(docs, id_col, text_col), null_rows_apart), min_chars)
    keeper = F.col("keeper.doc_id").eqNullSafe(F.col("doc_id")) & F.col("keeper.own").eqNullSafe(F.col("own"))
    # written first: the join then sees how many there are, and can split a line that very many rows hold
    repeated = staged(repeated_lines(lines, min_docs), "repeated-lines")
    drops = lines.join(repeated, "hash").where(~keeper).groupBy("key").agg(F.collect_set("pos").alias("drops"))
    docs = _keyed(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"),
                              *rows), False).drop("own")
    also = ["row"] if carry else []
    joined = docs.join(drops, "key", "left").withColumn("lines", split_lines(F.col("text")))
    # by sets: no search of the dropped places for every line
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    kept = F.when(F.col("drops").isNull(), F.col("lines")).otherwise(
        F.transform(places, lambda i: F.get(F.col("lines"), i)))
    return joined.select("doc_id", F.array_join(kept, "\n").alias("text"),
                         F.size("lines").cast("long").alias("n_lines"),
                         F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long").alias("n_dropped"), *also)
