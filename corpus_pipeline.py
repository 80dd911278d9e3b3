"""Corpus pipeline: from raw documents to token ids.

Each stage takes what the one before kept, calls one operator of
``medallion.llm`` and returns a DataFrame, which is written as Parquet and
read again for the next.  All but the last return the columns of documents.
Decisions are applied to the rows themselves, which are known by a hash of
their id and text: rows without an id, and rows that share one, are judged
each by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medallion.llm import decontaminate, line_dedup, simhash_tiles, toxicity
from medallion.llm.common import read_table, staged
from medallion.llm.queries import bpe_digests

#: The toxicity scores come from a fitted model, which SQL cannot express.
ORACLE_SQL = None


ROW = "__medallion_row"


def _keyed(docs: DataFrame) -> DataFrame:
    """With a number of each distinct (doc_id, text); nulls count."""
    return docs.withColumn(ROW, F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))


def _rows(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of whole rows on their number."""
    return _keyed(docs).join(keys.distinct(), ROW, how).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go."""
    scored = toxicity.classify(_keyed(docs), read_table(spark, sf_dir, "labels"), row_col=ROW)
    return _rows(docs, scored.where("predicted = 1").select(F.col("row").alias(ROW)), "left_anti")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated long lines stay in one document; ``n_chars`` follows the text."""
    found = line_dedup.dedup_lines(docs, carry=True, null_rows_apart=True)
    own = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return found.select(*[(own[c] if c in own else F.col("row")[c]).alias(c) for c in docs.columns])


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays, the one of the lowest id
    (null ids come last); exact repeats of it go too."""
    keyed = _keyed(docs)
    found = simhash_tiles.near_duplicates(keyed, id_col=ROW).select(F.col("doc_id").alias(ROW), "component_id")
    ids = keyed.select(ROW, F.col("doc_id").isNull().alias("no_id"), "doc_id").distinct()
    first = found.distinct().join(ids, ROW).groupBy("component_id").agg(
        F.min(F.struct("no_id", "doc_id", ROW))[ROW].alias(ROW))
    return _rows(docs, first.select(ROW), "left_semi").dropDuplicates(["doc_id", "text"])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go."""
    found = decontaminate.find_contamination(_keyed(docs), read_table(spark, sf_dir, "benchmark"), id_col=ROW)
    return _rows(docs, found.select(F.col("doc_id").alias(ROW)), "left_anti")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and the digests of their round trip."""
    return bpe_digests(docs, with_ids=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("byte_level_bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
