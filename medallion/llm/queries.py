"""Queries of the training-data operators and their DuckDB SQL.

Each query calls its operator on the whole table and derives the columns of
its contract from what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from ..session import scratch_path
from . import bpe, cross_tokenizer, decontaminate, fingerprints, hard_negatives, langid, licenses, line_dedup, \
    secret_scan, simhash_tiles, token_store, topk_search, toxicity
from .common import fold_remainder, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@query("op1_toxicity")
def op1_toxicity(spark, sf):
    scored = toxicity.classify(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))
    return scored.select("doc_id", (fold_remainder(F.col("doc_id")) == 1).alias("held_out"),
                         "score", "predicted", "evidence")


@query("op2_simhash_dedup")
def op2_simhash_dedup(spark, sf):
    found = simhash_tiles.near_duplicates(read_table(spark, sf, "documents"))
    return found.select("doc_id", simhash_tiles.hex_fingerprint(F.col("fp")).alias("fingerprint"),
                        "component_id")


@query("op3_token_store")
def op3_token_store(spark, sf):
    folder = scratch_path(spark, "token-store")
    token_store.write(read_table(spark, sf, "documents"), folder,
                      public_tokenizers.path("byte_bpe_50k.json"), n_vocabulary=50257)
    return token_store.digests(spark, folder)


def bpe_digests(docs, with_ids: bool = False):
    """Digest columns of a byte-level BPE round trip."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    trip = bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)
    return trip.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), *(["ids"] if with_ids else []))


@query("op4_bpe")
def op4_bpe(spark, sf):
    return bpe_digests(read_table(spark, sf, "documents"))


@query("op5_line_dedup", """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed
  WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, (r.key IS NOT NULL AND k.doc_id <> r.keeper) AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op5_line_dedup(spark, sf):
    return line_dedup.dedup_lines(read_table(spark, sf, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op6_fingerprints")
def op6_fingerprints(spark, sf):
    """``n_near``: other rows within the radius, for every 50th id."""
    rows = fingerprints.document_fingerprints(read_table(spark, sf, "documents"))
    asked = rows.where("doc_id % 50 = 0")
    near = fingerprints.near_counts(rows, asked)
    asks = F.col("doc_id") % 50 == 0
    return rows.join(near, (F.col("fp") == F.col("query")) & asks, "left").select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.hex_fingerprint(F.col("fp")).alias("fingerprint"),
        fingerprints.hex_fingerprint(F.col("edited_fp")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        fingerprints.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        (F.col("n_near") - 1).alias("n_near"))


@query("op7_licenses")
def op7_licenses(spark, sf):
    return licenses.scan_licenses(read_table(spark, sf, "documents"))


@query("op8_language")
def op8_language(spark, sf):
    docs = read_table(spark, sf, "documents")
    return langid.identify(docs, langid.fit(docs)).select(
        "doc_id", (fold_remainder(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")


@query("op9_decontaminate")
def op9_decontaminate(spark, sf):
    return decontaminate.find_contamination(read_table(spark, sf, "documents"),
                                            read_table(spark, sf, "benchmark"))


def _scan_sql() -> str:
    """DuckDB SQL of the secret scan: pattern by pattern, without an index."""
    parts, length = [], "length"
    for i, r in enumerate(secret_scan.RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""
  SELECT doc_id, {i} AS kind_no, '{r.kind}' AS kind,
         unnest([{{
           'start': list_sum([{length}(x) for x in gaps[1:k]])
                    + coalesce(list_sum([{length}(x) for x in whole[1:k - 1]]), 0),
           'size': {length}(whole[k]), 'tested': {length}(tested[k])}} for k in range(1, len(whole) + 1)]) AS span, {r.min_length} AS least
  FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '{p}') AS gaps,
               regexp_extract_all(coalesce(text, ''), '{p}', 0) AS whole,
               regexp_extract_all(coalesce(text, ''), '{p}', {r.group}) AS tested FROM documents)""")
    return f"""
WITH spans AS ({" UNION ALL ".join(parts)}),
kept AS (
  SELECT doc_id, kind_no, kind, span.start::BIGINT AS s, (span.start + span.size)::BIGINT AS e
  FROM spans WHERE span.tested >= least),
per_doc AS (
  SELECT doc_id, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access,
         count(*) FILTER (kind_no = 2) AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no) FILTER (kind_no < 3) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no) AS spans
  FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per_doc p ON d.doc_id = p.doc_id"""


@query("op10_secret_scan", _scan_sql())
def op10_secret_scan(spark, sf):
    rules = secret_scan.RULES
    found = secret_scan.scan(read_table(spark, sf, "documents"))

    def of(kind):
        return F.filter("found", lambda s: s["kind"] == kind)

    base = F.filter("found", lambda s: s["kind"] < len(secret_scan.BASE_RULES))
    return found.select(
        "doc_id", *[F.size(of(i)).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(secret_scan.BASE_RULES)],
        F.sha2(secret_scan.span_text(base, rules).cast("binary"), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("found"), rules).alias("spans"))


VECTORS_SQL = """
  SELECT DISTINCT vec_id, label, [floor(256 * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0"""


@query("op11_hard_negatives", f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v
           FROM ({VECTORS_SQL}) WHERE label IS NOT NULL),
scored AS (
  SELECT DISTINCT a.vec_id AS anchor_id, a.label AS own, a.v AS av, c.vec_id, a.label = c.label AS same,
         list_inner_product(a.v, c.v)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, own, av, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id, own, av ORDER BY score DESC, vec_id) <= 5),
negatives AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.own, p.av, p.positive_id, p.positive_score
                            ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.own = p.own AND s.av = p.av AND NOT s.same
   AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 10""")
def op11_hard_negatives(spark, sf):
    rows = read_table(spark, sf, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


@query("op12_cross_tokenizer")
def op12_cross_tokenizer(spark, sf):
    return cross_tokenizer.link_scores(read_table(spark, sf, "documents"),
                                       public_tokenizers.path("byte_bpe_50k.json"),
                                       public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_topk_search", f"""
WITH v AS (SELECT DISTINCT vec_id, v FROM ({VECTORS_SQL})),
pairs AS (
  SELECT DISTINCT q.vec_id AS query_id, q.v AS qv, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, qv ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 5""")
def op13_topk_search(spark, sf):
    return topk_search.top_k(read_table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)
