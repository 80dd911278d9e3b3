"""One query per operator of the inventory, each run over the driver's
tables (whole tables, no id subsets), plus the DuckDB SQL that must give
the same rows.  ``__spark_entry__`` exposes both.

Queries that write (sources, sinks, upserts, ingest) do so under the
shared checkpoint folder and return a lazy read of what they wrote.
Columns are named identically on both sides; sums and averages run over
whole numbers (or integer cents) so the order of addition cannot show.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import standins as S
from .functions.names import clean_silver_names, nice_case_names
from .functions.values import NUMERIC_PATTERN, RANK_LABELS
from .operators import cluster as C
from .operators import clean as K
from .operators import profile_state as PS
from .operators import reconcile as RC
from .operators import rollup as R
from .plans import catalog as CAT
from .plans import reports as REP
from .plans.ingest import ingest
from .session import scratch_path, unique_name
from .sinks import buckets as B
from .sinks import upsert as U
from .sinks import writers as Wr
from .sources import json_docs as J
from .sources import readers as Rd
from .streaming.landing import append_once, create_streamed, stream_ingest, streamed_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def T(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return S.table(spark, sf, name)


def layer_db(spark: SparkSession, prefix: str) -> str:
    """A fresh database whose tables live under the shared folder."""
    db = unique_name(prefix)
    CAT.create_layers(spark, [db], root=scratch_path(spark, "warehouse"))
    return db


def source_db(spark: SparkSession, sf: str, names=("customer", "orders", "nation",
                                                   "region", "lineitem", "part")) -> str:
    """External catalog tables over the driver's parquet files (no copy)."""
    db = "src_" + hashlib.sha1(sf.encode()).hexdigest()[:10]
    CAT.create_layers(spark, [db], root=scratch_path(spark, "warehouse"))
    for n in names:
        if not spark.catalog.tableExists(f"{db}.{n}"):
            spark.catalog.createTable(f"{db}.{n}", path=f"{sf.rstrip('/')}/{n}.parquet",
                                      source="parquet")
    return db


# ============================================================ roll-up slice

def cleaned_wards(spark, sf):
    return K.preprocess(S.wards_raw(spark, sf), REP.NULL_THRESHOLD).frame


CITY_SUMS = ", ".join(f"sum({c}) AS {c}" for c in REP.SLUM_SUMS)


@query("rollup_city", f"""
WITH wards AS ({S.WARDS_SQL})
SELECT City, {CITY_SUMS}, avg(LiteracyRatePercentage) AS LiteracyRatePercentage
FROM wards GROUP BY City""")
def q_rollup_city(spark, sf):
    """A1 + P6 + P15: wards cleaned, dropped and rolled up per city."""
    df = K.drop_columns(cleaned_wards(spark, sf), REP.SLUM_DROP)
    return R.rollup(df, REP.SLUM_KEY, REP.SLUM_SUMS, REP.SLUM_AVGS)


@query("impute_split", S.CITIES_SQL)
def q_impute_split(spark, sf):
    """P13 after A1."""
    return REP.slum_entities(S.wards_raw(spark, sf))


@query("group_means", f"""
WITH wards AS ({S.WARDS_SQL})
SELECT Zone, avg(SlumPopulationTotal) AS SlumPopulationTotal,
       avg(LiteracyRatePercentage) AS LiteracyRatePercentage
FROM wards GROUP BY Zone""")
def q_group_means(spark, sf):
    """A3: mean measures per group (zone)."""
    return R.group_means(cleaned_wards(spark, sf), "Zone",
                         ["SlumPopulationTotal", "LiteracyRatePercentage"])


@query("sorted_summary", f"""
WITH wards AS ({S.WARDS_SQL})
SELECT Zone, avg(NoNotifiedSlums) AS NoNotifiedSlums, avg(PopulationSCCategory) AS PopulationSCCategory
FROM wards GROUP BY Zone ORDER BY NoNotifiedSlums DESC, Zone""")
def q_sorted_summary(spark, sf):
    """A per-group summary sorted descending by one mean."""
    return R.sorted_summary(cleaned_wards(spark, sf), "Zone",
                            ["NoNotifiedSlums", "PopulationSCCategory"], "NoNotifiedSlums")


@query("top_k", f"""
WITH c AS ({S.CITIES_SQL})
SELECT City, SlumPopulationMale, SlumPopulationFemale FROM c
ORDER BY SlumPopulationTotal DESC NULLS LAST, City LIMIT 10""")
def q_top_k(spark, sf):
    """Ten cities with the largest slum population."""
    return R.top_k(REP.slum_entities(S.wards_raw(spark, sf)), "SlumPopulationTotal", 10,
                   tie_break=["City"], cols=["City", "SlumPopulationMale", "SlumPopulationFemale"])


@query("top_k_rate", f"""
WITH c AS ({S.CITIES_SQL})
SELECT City, LiteracyRatePercentage FROM c
ORDER BY LiteracyRatePercentage DESC NULLS LAST, City LIMIT 10""")
def q_top_k_rate(spark, sf):
    """T4: ten cities with the highest literacy rate."""
    return R.top_k(REP.slum_entities(S.wards_raw(spark, sf)), "LiteracyRatePercentage", 10,
                   tie_break=["City"], cols=["City", "LiteracyRatePercentage"])


@query("top_k_wards", f"""
WITH wards AS ({S.WARDS_SQL})
SELECT City, WardName, SlumPopulationTotal FROM wards
ORDER BY SlumPopulationTotal DESC NULLS LAST, WardName LIMIT 10""")
def q_top_k_wards(spark, sf):
    """T1 on the detail rows (grows with the customer table)."""
    return R.top_k(cleaned_wards(spark, sf), "SlumPopulationTotal", 10,
                   tie_break=["WardName"], cols=["City", "WardName", "SlumPopulationTotal"])


@query("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def q_preview(spark, sf):
    """Five-row preview, ordered so it repeats."""
    return R.preview(T(spark, sf, "orders"), 5, order_by=["o_orderkey"])


# ============================================================ names

AWKWARD = [("c_custkey", "Cust Key"), ("c_name", "Customer (Name)"),
           ("c_nationkey", "Nation-Key"), ("c_acctbal", "Acct Bal (USD)"),
           ("c_mktsegment", "mkt_segment")]


def awkward_customer(spark, sf):
    return T(spark, sf, "customer").select(*[F.col(a).alias(b) for a, b in AWKWARD])


@query("clean_names", """
SELECT c_custkey AS CustKey, c_name AS CustomerName, c_nationkey AS Nation_Key,
       c_acctbal AS AcctBalUSD, c_mktsegment AS mkt_segment FROM customer""")
def q_clean_names(spark, sf):
    """Silver header cleaning."""
    return clean_silver_names(awkward_customer(spark, sf))


@query("nice_case", """
SELECT c_custkey AS CustKey, c_name AS CustomerName, c_nationkey AS NationKey,
       c_acctbal AS AcctBalUSD, c_mktsegment AS MktSegment FROM customer""")
def q_nice_case(spark, sf):
    """NiceCase headers."""
    return nice_case_names(awkward_customer(spark, sf))


# ============================================================ NA handling

def na_customer(spark, sf):
    """Customer with text cells holding the NA marker and look-alikes."""
    k = F.col("c_custkey")
    return T(spark, sf, "customer").select(
        k.alias("c_custkey"),
        F.when(k % 7 == 0, F.lit("NA")).otherwise(F.col("c_name")).alias("c_name"),
        F.when(k % 4 == 0, F.lit("NA")).when(k % 4 == 1, F.lit("na"))
         .otherwise(F.col("c_nationkey").cast("string")).alias("c_nationkey"),
        F.when(k % 5 == 0, F.lit(" Na ")).when(k % 5 == 1, F.lit("NA"))
         .when(k % 5 == 2, F.lit("nation")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        F.when(k % 3 == 0, F.lit("NA")).when(k % 3 == 1, F.lit("NA"))
         .otherwise(F.col("c_mktsegment")).alias("c_segment2"))


NA_CUSTOMER_SQL = """
SELECT c_custkey,
       CASE WHEN c_custkey % 7 = 0 THEN 'NA' ELSE c_name END AS c_name,
       CASE WHEN c_custkey % 4 = 0 THEN 'NA' WHEN c_custkey % 4 = 1 THEN 'na'
            ELSE CAST(c_nationkey AS VARCHAR) END AS c_nationkey,
       CASE WHEN c_custkey % 5 = 0 THEN ' Na ' WHEN c_custkey % 5 = 1 THEN 'NA'
            WHEN c_custkey % 5 = 2 THEN 'nation' ELSE c_mktsegment END AS c_mktsegment,
       CASE WHEN c_custkey % 3 = 0 THEN 'NA' WHEN c_custkey % 3 = 1 THEN 'NA'
            ELSE c_mktsegment END AS c_segment2
FROM customer"""

NA_NULL_SQL = f"""
SELECT c_custkey, NULLIF(c_name, 'NA') AS c_name, NULLIF(c_nationkey, 'NA') AS c_nationkey,
       NULLIF(c_mktsegment, 'NA') AS c_mktsegment, NULLIF(c_segment2, 'NA') AS c_segment2
FROM ({NA_CUSTOMER_SQL})"""


@query("na_to_null", NA_NULL_SQL)
def q_na_to_null(spark, sf):
    """Exact 'NA' cells become NULL in text columns."""
    return K.replace_sentinel(na_customer(spark, sf))


@query("regex_na_to_null", f"""
SELECT c_custkey,
       CASE WHEN regexp_matches(c_name, '(?i)^\\s*na\\s*$') THEN NULL ELSE c_name END AS c_name,
       CASE WHEN regexp_matches(c_nationkey, '(?i)^\\s*na\\s*$') THEN NULL ELSE c_nationkey END
            AS c_nationkey,
       CASE WHEN regexp_matches(c_mktsegment, '(?i)^\\s*na\\s*$') THEN NULL ELSE c_mktsegment END
            AS c_mktsegment,
       CASE WHEN regexp_matches(c_segment2, '(?i)^\\s*na\\s*$') THEN NULL ELSE c_segment2 END
            AS c_segment2
FROM ({NA_CUSTOMER_SQL})""")
def q_regex_na_to_null(spark, sf):
    """P10: loose 'na' markers (any case, blanks) become NULL; others stay."""
    return K.replace_pattern(na_customer(spark, sf))


def _profile_sql(src: str, cols: list[str], numeric_typed: set[str] = frozenset()) -> str:
    parts = []
    for c in cols:
        num = f"count({c})" if c in numeric_typed else \
            f"count_if(regexp_full_match({c}, '{NUMERIC_PATTERN}'))"
        parts.append(
            f"SELECT '{c}' AS column_name, avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) "
            f"AS null_fraction, count({c}) AS non_null, CAST({num} AS BIGINT) AS numeric FROM src")
    return f"WITH src AS ({src})\n" + "\nUNION ALL\n".join(parts)


NA_COLS = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_segment2"]


@query("null_profile", _profile_sql(NA_NULL_SQL, NA_COLS, {"c_custkey"}))
def q_null_profile(spark, sf):
    """A4 (+A5 counts) in one pass: per column null fraction, non-null and
    numeric-looking counts."""
    return K.profile_frame(K.replace_sentinel(na_customer(spark, sf)))


PROFILED_ORDERS_SQL = """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
       CASE WHEN o_orderkey % 3 = 0 THEN 'NA' ELSE CAST(o_custkey AS VARCHAR) END AS cust, o_orderstatus FROM orders"""


@query("profile_merged", f"""
SELECT *, 1 AS partitions_read FROM ({_profile_sql(
    PROFILED_ORDERS_SQL, ["o_orderkey", "o_orderpriority", "cust", "o_orderstatus"], {"o_orderkey"})})""")
def q_profile_merged(spark, sf):
    """A4 + A5 merged: two partitions are profiled, a third is appended and
    only it is read; the merged profile is that of all rows."""
    db = layer_db(spark, "silver")
    t, state = f"{db}.orders", f"{db}.profile_states"
    k = F.col("o_orderkey")
    rows = T(spark, sf, "orders").select(
        "o_orderkey", F.when(k % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(k % 3 == 0, "NA").otherwise(F.col("o_custkey").cast("string")).alias("cust"), "o_orderstatus")
    late = F.col("o_orderstatus") == "P"
    Wr.insert_table(rows.where(~late), t, partition_by="o_orderstatus")
    PS.refresh_profile(spark, t, state)
    Wr.insert_table(rows.where(late), t, partition_by="o_orderstatus")
    n_read = PS.refresh_profile(spark, t, state)
    return PS.merged_profile(spark, t, state).withColumn("partitions_read", F.lit(n_read))


@query("drop_sparse", f"""
SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM ({NA_NULL_SQL})""")
def q_drop_sparse(spark, sf):
    """Columns over 30% NULL are dropped (c_segment2 is 2/3 NULL)."""
    return K.drop_sparse(K.replace_sentinel(na_customer(spark, sf)), 0.3)


# ============================================================ type profiling

def mixed_part(spark, sf):
    """Part as raw text: a clean numeric, a numeric with NA cells, integer
    cents with blank-padded decimals, a code with one bad value, text."""
    k = F.col("p_partkey")
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint").cast("string")
    return T(spark, sf, "part").select(
        k.cast("string").alias("part_key"),
        F.when(k % 9 == 0, F.lit("NA")).otherwise(F.col("p_size").cast("string")).alias("size"),
        F.when(k % 13 == 0, F.lit(" 12.5 ")).when(k % 13 == 1, F.lit("1e2"))
         .otherwise(cents).alias("price_cents"),
        F.when(k % 50 == 7, F.lit("3f")).otherwise(F.col("p_size").cast("string")).alias("size_code"),
        F.col("p_brand").alias("brand"))


MIXED_PART_SQL = """
SELECT CAST(p_partkey AS VARCHAR) AS part_key,
       CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS size,
       CASE WHEN p_partkey % 13 = 0 THEN ' 12.5 ' WHEN p_partkey % 13 = 1 THEN '1e2'
            ELSE CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS VARCHAR) END AS price_cents,
       CASE WHEN p_partkey % 50 = 7 THEN '3f' ELSE CAST(p_size AS VARCHAR) END AS size_code,
       p_brand AS brand
FROM part"""

COERCED_PART_SQL = """
SELECT CAST(p_partkey AS DOUBLE) AS part_key,
       CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS size,
       CASE WHEN p_partkey % 13 = 0 THEN 12.5 WHEN p_partkey % 13 = 1 THEN 100.0
            ELSE CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS DOUBLE) END AS price_cents,
       CASE WHEN p_partkey % 50 = 7 THEN '3f' ELSE CAST(p_size AS VARCHAR) END AS size_code,
       p_brand AS brand
FROM part"""

PART_COLS = ["part_key", "size", "price_cents", "size_code", "brand"]


@query("numeric_profile", _profile_sql(MIXED_PART_SQL, PART_COLS))
def q_numeric_profile(spark, sf):
    """A5: how many non-null values of each column look numeric (one job)."""
    return K.profile_frame(K.replace_sentinel(mixed_part(spark, sf)))


def _coerced(spark, sf):
    df = K.replace_sentinel(mixed_part(spark, sf))
    num = K.numeric_columns(K.profile(df))
    return K.coerce_types(df, num), num


@query("coerce_types", COERCED_PART_SQL)
def q_coerce_types(spark, sf):
    """All-numeric text columns become double, others stay text."""
    return _coerced(spark, sf)[0]


@query("fill_zero", f"""
SELECT part_key, coalesce(size, 0) AS size, coalesce(price_cents, 0) AS price_cents,
       size_code, brand FROM ({COERCED_PART_SQL})""")
def q_fill_zero(spark, sf):
    """NULL numerics become 0."""
    df, num = _coerced(spark, sf)
    return K.fill_zero(df, num)


@query("preprocess", S.WARDS_SQL)
def q_preprocess(spark, sf):
    """The whole cleaning pipeline on the raw wards (threshold 0.5)."""
    return cleaned_wards(spark, sf)


@query("drop_columns", f"""
WITH wards AS ({S.WARDS_SQL})
SELECT * EXCLUDE (Zone, WardName, WardNo) FROM wards""")
def q_drop_columns(spark, sf):
    """Named columns dropped; 'WardNo.' also removes its cleaned form."""
    return K.drop_columns(cleaned_wards(spark, sf), REP.SLUM_DROP + ("NoSuchColumn",))


# ============================================================ filters / joins / sets

@query("exclude_entities", """
SELECT c_custkey, City, c_acctbal FROM (
  SELECT c_custkey, c_acctbal,
         CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE n_name END AS City
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
WHERE City NOT IN ('NATION_3', 'NATION_7') AND c_acctbal > 0""")
def q_exclude_entities(spark, sf):
    """F1 + F3: named entities (and NULL names) excluded, then a numeric AND."""
    c, n = T(spark, sf, "customer"), T(spark, sf, "nation")
    df = c.join(n, c.c_nationkey == n.n_nationkey).select(
        "c_custkey", "c_acctbal",
        F.when(F.col("c_custkey") % 23 == 0, F.lit(None)).otherwise(F.col("n_name")).alias("City"))
    return K.exclude_values(df, "City", ["NATION_3", "NATION_7"]).where(F.col("c_acctbal") > 0) \
        .select("c_custkey", "City", "c_acctbal")


@query("semi_join_distinct", """
SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS City FROM orders
WHERE CAST(o_custkey AS VARCHAR) IN (SELECT CAST(user_id AS VARCHAR) FROM events)""")
def q_semi_join_distinct(spark, sf):
    """Distinct cities of one table that occur in another."""
    a = T(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("City"))
    b = T(spark, sf, "events").select(F.col("user_id").cast("string").alias("CityName"))
    return R.semi_join_distinct(a, "City", b, "CityName")


COUNT_TABLES = ("region", "nation", "customer", "orders", "lineitem")


@query("union_counts", "\nUNION\n".join(
    f"SELECT count(*) AS count FROM {t}" for t in COUNT_TABLES))
def q_union_counts(spark, sf):
    """UNION (distinct) of row counts."""
    return R.union_distinct_counts([T(spark, sf, t) for t in COUNT_TABLES])


@query("reconcile_counts", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in COUNT_TABLES))
def q_reconcile_counts(spark, sf):
    """Row count per table through the catalog."""
    db = source_db(spark, sf)
    return CAT.reconcile(spark, [f"{db}.{t}" for t in COUNT_TABLES]).withColumn(
        "table_name", F.regexp_extract("table_name", r"\.([^.]+)$", 1))


@query("reconcile_content", """
WITH planted AS (SELECT max(o_orderkey) AS k FROM orders)
SELECT 'left' AS side, CAST(o_orderkey AS VARCHAR) AS o_orderkey, 1 AS copies, 1 AS n_ranges, o_orderstatus
FROM orders, planted WHERE o_orderkey = k
UNION ALL SELECT 'right', CAST(o_orderkey AS VARCHAR), 1, 1, 'changed' FROM orders, planted WHERE o_orderkey = k""")
def q_reconcile_content(spark, sf):
    """W7 by content: a copy of the orders in which one row differs; the one
    key range whose checksums disagree and the two versions of the row."""
    db = layer_db(spark, "silver")
    o = T(spark, sf, "orders")
    last = o.agg(F.max("o_orderkey").alias("o_orderkey")).withColumn("last", F.lit(True))      # one row
    changed = o.join(last, "o_orderkey", "left").withColumn(
        "o_orderstatus", F.when(F.col("last"), "changed").otherwise(F.col("o_orderstatus")))
    Wr.insert_table(changed.drop("last").repartition(5, "o_custkey"), f"{db}.orders")
    copy = spark.table(f"{db}.orders")
    ranges = RC.reconcile_content(o, copy, "o_orderkey").groupBy("same").agg(
        F.count(F.lit(1)).cast("int").alias("n_ranges")).where("NOT same")
    found = RC.differing_rows(o, copy, "o_orderkey").withColumn("same", F.lit(False))
    return found.join(ranges, "same").select(
        "side", "o_orderkey", F.col("copies").cast("int").alias("copies"), "n_ranges", "o_orderstatus")


@query("partition_values", """
SELECT string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS o_orderstatus_values
FROM orders""")
def q_partition_values(spark, sf):
    """A8 (+F5 input): distinct partition values joined into one string."""
    return R.distinct_joined(T(spark, sf, "orders"), "o_orderstatus")


# ============================================================ sources

@query("table_scan", "SELECT * FROM customer")
def q_table_scan(spark, sf):
    """S3: catalog table by schema and name."""
    return Rd.read_table(spark, "customer", source_db(spark, sf))


@query("query_source", """
SELECT o_orderstatus, count(*) AS n_orders,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total_cents
FROM orders GROUP BY o_orderstatus""")
def q_query_source(spark, sf):
    """A non-blank query wins over the table name."""
    db = source_db(spark, sf)
    return Rd.read_source(spark, "table", table="ignored", schema=db, query=f"""
        SELECT o_orderstatus, count(*) AS n_orders,
               sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS total_cents
        FROM {db}.orders GROUP BY o_orderstatus""")


@query("format_scan", "SELECT * FROM lineitem")
def q_format_scan(spark, sf):
    """Any format by path."""
    return Rd.read_source(spark, "parquet", path=f"{sf.rstrip('/')}/lineitem.parquet")


def as_bigint(df: DataFrame, *cols: str) -> DataFrame:
    """Inferred whole numbers as BIGINT: which width inference picks depends
    on the largest key, and so on the scale."""
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})


@query("csv_scan", """
SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey,
       c_acctbal, c_mktsegment
FROM customer""")
def q_csv_scan(spark, sf):
    """Header CSV with inferred types."""
    path = scratch_path(spark, "csv_scan")
    T(spark, sf, "customer").write.option("header", "true").csv(path)
    return as_bigint(Rd.read_csv(spark, path), "c_custkey", "c_nationkey")


@query("csv_dir_scan", """
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey,
       o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
       'timestamp' AS date_type, o_orderpriority
FROM orders""")
def q_csv_dir_scan(spark, sf):
    """A folder of ';' CSV files merged in one scan; the inferred type of
    the time column is a result column, its value shown as text."""
    path = scratch_path(spark, "csv_dir")
    o = T(spark, sf, "orders").withColumn(
        "o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    # two writes into one folder: at least two files, each with its header
    for part, mode in ((o.where(F.col("o_orderstatus") == "F"), "overwrite"),
                       (o.where(F.col("o_orderstatus") != "F"), "append")):
        part.write.mode(mode).option("header", "true").option("delimiter", ";").csv(path)
    df = Rd.read_csv_dir(spark, path)
    return as_bigint(df, "o_orderkey", "o_custkey").withColumn(
        "date_type", F.typeof("o_orderdate")).withColumn(
        "o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


@query("ext_read", """
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type,
       CAST(p_size AS VARCHAR) AS p_size, CAST(p_retailprice AS VARCHAR) AS p_retailprice
FROM part""")
def q_ext_read(spark, sf):
    """Format taken from the extension; header on, all text."""
    path = scratch_path(spark, "ext") + "/part.csv"
    T(spark, sf, "part").write.option("header", "true").csv(path)
    return Rd.read_by_extension(spark, path)


CUSTOMER_TEXT_SQL = """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
       CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer"""


BRONZE_OPTIONS = {"plain.csv": {"header": "true"},
                  "semi.csv": {"header": "true", "sep": ";", "multiLine": "true", "escape": '"'},
                  "bare.csv": {"header": "false"}}


@query("bronze_refresh", """
WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS k, c_name || ',;' || chr(34) || chr(10) || ' x ' AS odd,
                  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '  ' || c_mktsegment || ' ' END AS padded
           FROM customer)
SELECT 'plain.csv' AS file, k AS a, replace(replace(odd, chr(10), ' '), chr(34), '') AS b, padded AS c FROM c
UNION ALL SELECT 'semi.csv', k, odd, padded FROM c
UNION ALL SELECT 'bare.csv', k, replace(replace(odd, chr(10), ' '), chr(34), ''), padded FROM c""")
def q_bronze_refresh(spark, sf):
    """Landing -> bronze full refresh of a comma file, a ';' file with
    quotes and line breaks in its cells, and one without a header; every cell
    as it was, padding included."""
    root = scratch_path(spark, "layers")
    odd = F.concat("c_name", F.lit(',;"\n x '))
    rows = T(spark, sf, "customer").repartition(3, "c_custkey").select(
        F.col("c_custkey").cast("string").alias("a"), odd.alias("b"),
        F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).alias("c"))
    tame = rows.withColumn("b", F.translate("b", '\n"', " "))
    for name, options in BRONZE_OPTIONS.items():
        (rows if name == "semi.csv" else tame).write.options(**{**Wr.CSV_AS_IS, **options}).csv(
            f"{root}/landing/{name}")
    out = Rd.refresh_bronze(spark, f"{root}/landing", f"{root}/bronze", list(BRONZE_OPTIONS), BRONZE_OPTIONS)
    parts = [spark.read.options(**Rd.bronze_read_options(BRONZE_OPTIONS[n])).csv(p).toDF("a", "b", "c").withColumn(
        "file", F.lit(n)) for n, p in out.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def customer_docs(spark, sf, path):
    """Landed API documents: {"count": n, "entries": [...]} per line, at
    most 1000 entries each (grouped by key range, so no group is unbounded)."""
    c, n, r = T(spark, sf, "customer"), T(spark, sf, "nation"), T(spark, sf, "region")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
    entry = F.struct(F.col("c_custkey").alias("Customer Key"),
                     F.col("c_name").alias("Customer  Name"),
                     F.col("c_acctbal").alias("Balance"),
                     F.struct(F.col("n_name").alias("Name"), F.col("n_nationkey").alias("Key"))
                      .alias("Nation"),
                     F.struct(F.col("r_name").alias("Name")).alias("Région"))
    docs = rows.groupBy(F.floor(F.col("c_custkey") / 1000).alias("doc")).agg(
        F.count(F.lit(1)).alias("count"), F.collect_list(entry).alias("entries"))
    docs.select("count", "entries").write.json(path)


API_FIELDS = ["customer key", "customer name", "balance", "nationname", "regionname"]
API_SQL = """
SELECT c_custkey AS "customer key", c_name AS "customer name", c_acctbal AS balance,
       n_name AS nationname, r_name AS regionname
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


@query("json_flatten", API_SQL)
def q_json_flatten(spark, sf):
    """S8 + P3-P5: documents -> records -> flat, normalised, allowed fields."""
    path = scratch_path(spark, "api_docs")
    customer_docs(spark, sf, path)
    return J.read_json_records(spark, path, key="entries", fields=API_FIELDS)


@query("api_table", """
SELECT CAST(c_custkey AS VARCHAR) AS "customer key", c_name AS "customer name",
       CAST(c_acctbal AS VARCHAR) AS balance, n_name AS nationname, r_name AS regionname
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def q_api_table(spark, sf):
    """API documents -> table -> CSV export, read back as text."""
    path = scratch_path(spark, "api_docs")
    customer_docs(spark, sf, path)
    return REP.api_table(spark, path, scratch_path(spark, "api_csv"), "entries", API_FIELDS)


@query("file_listing", """
SELECT 'l_returnflag=' || l_returnflag AS folder, true AS same_files, true AS same_bytes, count(*) AS row_count
FROM lineitem GROUP BY l_returnflag""")
def q_file_listing(spark, sf):
    """The files of a written, partitioned folder, listed with name, path
    and size, against what a scan of the folder says of the files it read."""
    path = scratch_path(spark, "listing")
    T(spark, sf, "lineitem").write.partitionBy("l_returnflag").parquet(path)
    folder = F.element_at(F.split(F.col("path"), "/"), -2).alias("folder")
    listed = Rd.list_files(spark, path).groupBy(folder).agg(
        F.count(F.lit(1)).alias("n_listed"), F.sum("size_bytes").alias("listed"))
    read = spark.read.parquet(path).groupBy(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).count()
    held = read.groupBy(folder).agg(F.count(F.lit(1)).alias("n_read"), F.sum("size").alias("held"),
                                    F.sum("count").alias("row_count"))
    return held.join(listed, "folder").select(
        "folder", (F.col("n_listed") == F.col("n_read")).alias("same_files"),
        (F.col("listed") == F.col("held")).alias("same_bytes"), "row_count")


# ============================================================ sinks

def _orders_changed(o):
    return o.withColumn("o_totalprice", F.col("o_totalprice") + 1)


@query("insert_append", "SELECT * FROM orders")
def q_insert_append(spark, sf):
    """K1 then K3: create from one status, append the rest by name."""
    db = layer_db(spark, "silver")
    o = T(spark, sf, "orders")
    t = f"{db}.orders"
    Wr.insert_table(o.where(F.col("o_orderstatus") == "F"), t)
    rest = o.where(F.col("o_orderstatus") != "F")
    Wr.insert_table(rest.select(*reversed(rest.columns)), t)          # by name, not position
    return spark.table(t)


@query("insert_overwrite", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate,
       o_orderpriority FROM orders""")
def q_insert_overwrite(spark, sf):
    """K4: overwrite a table."""
    db = layer_db(spark, "silver")
    o = T(spark, sf, "orders")
    t = f"{db}.orders"
    Wr.insert_table(o, t)
    Wr.insert_table(_orders_changed(o), t, overwrite=True)
    return spark.table(t)


@query("insert_partition_static", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate,
       o_orderpriority FROM orders WHERE o_orderstatus = 'F'""")
def q_insert_partition_static(spark, sf):
    """K2 + K5 static: overwriting one status empties all other partitions."""
    db = layer_db(spark, "silver")
    o = T(spark, sf, "orders")
    t = f"{db}.orders_p"
    Wr.insert_table(o, t, partition_by="o_orderstatus")
    Wr.insert_table(_orders_changed(o.where(F.col("o_orderstatus") == "F")), t, overwrite=True,
                    partition_by="o_orderstatus", partition_mode="static")
    return spark.table(t)


@query("insert_partition_dynamic", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate,
       o_orderpriority FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT * FROM orders WHERE o_orderstatus <> 'F'""")
def q_insert_partition_dynamic(spark, sf):
    """K5 dynamic: only the written partition is replaced."""
    db = layer_db(spark, "silver")
    o = T(spark, sf, "orders")
    t = f"{db}.orders_p"
    Wr.insert_table(o, t, partition_by="o_orderstatus")
    Wr.insert_table(_orders_changed(o.where(F.col("o_orderstatus") == "F")), t, overwrite=True,
                    partition_by="o_orderstatus", partition_mode="dynamic")
    return spark.table(t)


@query("path_write", "SELECT * FROM orders UNION ALL SELECT * FROM orders")
def q_path_write(spark, sf):
    """K6: partitioned path, appended twice."""
    path = scratch_path(spark, "path_write")
    o = T(spark, sf, "orders")
    Wr.write_path(o, path, "append", partition_by="o_orderstatus")
    Wr.write_path(o, path, "append", partition_by="o_orderstatus")
    return spark.read.parquet(path)


@query("skip_empty", "SELECT * FROM orders")
def q_skip_empty(spark, sf):
    """Overwriting with an empty frame is skipped; the rows stay."""
    db = layer_db(spark, "silver")
    o = T(spark, sf, "orders")
    t = f"{db}.orders"
    Wr.insert_table(o, t)
    Wr.write_sink(o.where(F.lit(False)), table=t, mode="insert overwrite")
    return spark.table(t)


@query("csv_export", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
       CAST(o_totalprice AS VARCHAR) AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
       o_orderpriority, '  ' || o_orderpriority || ' ' AS padded
FROM orders""")
def q_csv_export(spark, sf):
    """Header CSV export written by the executors, cells as they are."""
    path = scratch_path(spark, "export")
    o = T(spark, sf, "orders").withColumn(
        "o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).withColumn(
        "padded", F.concat(F.lit("  "), "o_orderpriority", F.lit(" ")))
    Wr.export_csv(o, path)
    return spark.read.option("header", "true").csv(path)


# ============================================================ upsert

def upsert_batch(o: DataFrame) -> DataFrame:
    """Changed urgent orders, plus new keys made from pending orders."""
    changed = o.where(F.col("o_orderpriority") == "1-URGENT").withColumn(
        "o_totalprice", F.col("o_totalprice") + 1000)
    new = o.where(F.col("o_orderstatus") == "P").withColumn(
        "o_orderkey", -F.col("o_orderkey") - 1)
    return changed.unionByName(new)


UPSERT_BATCH_SQL = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1000 AS o_totalprice, o_orderdate,
       o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL
SELECT -o_orderkey - 1 AS o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
       o_orderpriority FROM orders WHERE o_orderstatus = 'P'"""


@query("upsert_keys", f"""
WITH u AS ({UPSERT_BATCH_SQL})
SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM u)
UNION ALL SELECT * FROM u""")
def q_upsert_keys(spark, sf):
    """MERGE on the key into an unpartitioned table."""
    db = layer_db(spark, "silver")
    o = T(spark, sf, "orders")
    t = f"{db}.orders"
    Wr.insert_table(o, t)
    U.upsert(upsert_batch(o), "o_orderkey", table=t)
    return spark.table(t)


def bucket_batch(o: DataFrame) -> DataFrame:
    """The first order of each customer at price 0, also under a new key,
    and pending orders without a key."""
    first = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey")).select("o_orderkey")
    changed = o.join(first, "o_orderkey").select(*o.columns).withColumn("o_totalprice", F.lit(0.0))
    new = changed.withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    without = o.where(F.col("o_orderstatus") == "P").withColumn("o_orderkey", F.lit(None).cast("long"))
    return changed.unionByName(new).unionByName(without)


BUCKET_BATCH_SQL = """
WITH changed AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, 0.0::DOUBLE AS o_totalprice, o_orderdate, o_orderpriority FROM orders
  WHERE o_orderkey IN (SELECT min(o_orderkey) FROM orders GROUP BY o_custkey))
SELECT * FROM changed
UNION ALL SELECT -o_orderkey - 1, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM changed
UNION ALL SELECT NULL, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE o_orderstatus = 'P'"""


@query("upsert_bucketed", f"""
WITH u AS ({BUCKET_BATCH_SQL})
SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM u WHERE o_orderkey IS NOT NULL)
UNION ALL SELECT * FROM u""")
def q_upsert_bucketed(spark, sf):
    """MERGE on the key into a table bucketed by it; the first order
    of every customer changes, in some buckets or all, and NULL keys come in."""
    db = layer_db(spark, "silver")
    o = T(spark, sf, "orders")
    t = f"{db}.orders_b"
    U.upsert(o, "o_orderkey", table=t, n_buckets=16)
    U.upsert(bucket_batch(o), "o_orderkey", table=t)
    return B.read_bucketed(spark, t)


@query("upsert_one_bucket", """
SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN -1.0 ELSE o_totalprice END AS o_totalprice,
       o_orderdate, o_orderpriority, o_orderkey = (SELECT max(o_orderkey) FROM orders) AS rewritten
FROM orders ORDER BY o_orderkey""")
def q_upsert_one_bucket(spark, sf):
    """A batch of one key rewrites its bucket only: every row, and
    whether it is the changed one; a row of an untouched bucket that lies in
    a new file would show."""
    db = layer_db(spark, "silver")
    o = T(spark, sf, "orders")
    t = f"{db}.orders_b"
    U.upsert(o, "o_orderkey", table=t, n_buckets=16)
    last = o.agg(F.max("o_orderkey").alias("o_orderkey"))
    U.upsert(o.join(last, "o_orderkey").select(*o.columns).withColumn("o_totalprice", F.lit(-1.0)),
             "o_orderkey", table=t)
    rows = spark.table(t).withColumn("new_file", F.col("_metadata.file_path").contains("/_versions/"))
    bucket = rows.join(last, "o_orderkey").select(B.BUCKET).distinct()
    inside = rows.join(bucket.withColumn("touched", F.lit(True)), B.BUCKET, "left")
    # a new file holds the touched bucket, all of it and nothing else
    return inside.where(F.col("new_file") == F.coalesce("touched", F.lit(False))).select(
        *o.columns, (F.col("o_totalprice") == -1.0).alias("rewritten"))


def moved_batch(o: DataFrame) -> DataFrame:
    """Updates in partitions F and O only: urgent F/O orders repriced, high
    F orders moved to O, and high P orders moved to O (their partition P is
    not named by the update, so they are not matched: inserted again)."""
    fo = F.col("o_orderstatus").isin("F", "O")
    repriced = o.where((F.col("o_orderpriority") == "1-URGENT") & fo).withColumn(
        "o_totalprice", F.col("o_totalprice") + 1000)
    moved = o.where((F.col("o_orderpriority") == "2-HIGH") & (F.col("o_orderstatus") != "O")) \
        .withColumn("o_orderstatus", F.lit("O"))
    return repriced.unionByName(moved)


MOVED_BATCH_SQL = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1000 AS o_totalprice, o_orderdate,
       o_orderpriority FROM orders
WHERE o_orderpriority = '1-URGENT' AND o_orderstatus IN ('F', 'O')
UNION ALL
SELECT o_orderkey, o_custkey, 'O' AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus <> 'O'"""


@query("upsert_partitioned", f"""
WITH u AS ({MOVED_BATCH_SQL})
SELECT * FROM orders o
WHERE NOT (o.o_orderstatus IN (SELECT DISTINCT o_orderstatus FROM u)
           AND o.o_orderkey IN (SELECT o_orderkey FROM u))
UNION ALL SELECT * FROM u""")
def q_upsert_partitioned(spark, sf):
    """K7 + K8: partition-pruned MERGE with dynamic partition overwrite."""
    db = layer_db(spark, "silver")
    o = T(spark, sf, "orders")
    t = f"{db}.orders_p"
    Wr.insert_table(o, t, partition_by="o_orderstatus")
    U.upsert(moved_batch(o), "o_orderkey", table=t, partition_by="o_orderstatus")
    return spark.table(t)


@query("upsert_partition_predicate", f"""
WITH u AS ({MOVED_BATCH_SQL})
SELECT * FROM orders o
WHERE NOT (o.o_orderstatus IN (SELECT DISTINCT o_orderstatus FROM u)
           AND o.o_orderkey IN (SELECT o_orderkey FROM u))
UNION ALL SELECT * FROM u""")
def q_upsert_partition_predicate(spark, sf):
    """K8: the partition predicate on a table that is not partitioned."""
    db = layer_db(spark, "silver")
    o = T(spark, sf, "orders")
    t = f"{db}.orders_flat"
    Wr.insert_table(o, t)
    U.upsert(moved_batch(o), "o_orderkey", table=t, partition_by="o_orderstatus")
    return spark.table(t)


def two_part_batch(o: DataFrame) -> DataFrame:
    """Urgent orders move to another priority, so to another sub-partition."""
    return o.where(F.col("o_orderpriority") == "1-URGENT").withColumn("o_orderpriority", F.lit("9-MOVED"))


@query("upsert_two_partitions", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
       CASE WHEN o_orderpriority = '1-URGENT' THEN '9-MOVED' ELSE o_orderpriority END AS o_orderpriority
FROM orders""")
def q_upsert_two_partitions(spark, sf):
    """K8: a table partitioned by two columns, the predicate on the first;
    keys move between sub-partitions and leave nothing behind."""
    db = layer_db(spark, "silver")
    o = T(spark, sf, "orders")
    t = f"{db}.orders_pp"
    Wr.insert_table(o, t, partition_by=["o_orderstatus", "o_orderpriority"])
    U.upsert(two_part_batch(o), "o_orderkey", table=t, partition_by="o_orderstatus")
    return spark.table(t)


@query("upsert_create", UPSERT_BATCH_SQL)
def q_upsert_create(spark, sf):
    """K9: upsert into a missing target creates it (table and path)."""
    db = layer_db(spark, "silver")
    o = T(spark, sf, "orders")
    U.upsert(upsert_batch(o), "o_orderkey", table=f"{db}.fresh")
    return spark.table(f"{db}.fresh")


@query("upsert_path", f"""
WITH u AS ({UPSERT_BATCH_SQL})
SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM u)
UNION ALL SELECT * FROM u""")
def q_upsert_path(spark, sf):
    """K7 + K9 on a folder: first call creates it, second merges."""
    path = scratch_path(spark, "upsert_path")
    o = T(spark, sf, "orders")
    U.upsert(o, "o_orderkey", path=path)
    U.upsert(upsert_batch(o), "o_orderkey", path=path)
    return spark.read.parquet(path)


# ============================================================ ML

def part_features(spark, sf):
    k = F.col("p_partkey")
    return T(spark, sf, "part").select(
        "p_partkey", F.when(k % 13 == 0, F.lit(None)).otherwise(F.col("p_size")).alias("p_size"),
        "p_retailprice")


@query("minmax_scale", """
WITH src AS (SELECT p_partkey,
                    CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END
                      AS p_size, p_retailprice FROM part),
     -- the assembler skips rows with a NULL feature
     p AS (SELECT * FROM src WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL)
SELECT p_partkey,
       (p_size - min(p_size) OVER ()) * (1.0 / (max(p_size) OVER () - min(p_size) OVER ()))
         + 0.0 AS f0,
       (p_retailprice - min(p_retailprice) OVER ())
         * (1.0 / (max(p_retailprice) OVER () - min(p_retailprice) OVER ())) + 0.0 AS f1
FROM p""")
def q_minmax_scale(spark, sf):
    """M1 + M2: rows with a NULL feature skipped, then scaled to [0, 1]."""
    out = C.minmax_scale(part_features(spark, sf), ["p_size", "p_retailprice"])
    arr = C.vector_to_array(F.col(C.FEATURES))
    return out.select("p_partkey", arr[0].alias("f0"), arr[1].alias("f1"))


GROUP_FEATURES = ["f0", "f1"]
#: Three groups far apart, by the label of each embedding.
GROUPS_SQL = """
SELECT vec_id, label % 3 AS g, CAST(1000 * (label % 3) + vec_id % 7 AS DOUBLE) AS f0,
       CAST(CASE WHEN label % 3 = 1 THEN 500 ELSE 0 END + vec_id % 5 AS DOUBLE) AS f1
FROM embeddings"""
#: The same, scaled to [0, 1] (M2).
SCALED_SQL = f"""
SELECT vec_id, g, (f0 - min(f0) OVER ()) / (max(f0) OVER () - min(f0) OVER ()) AS s0,
       (f1 - min(f1) OVER ()) / (max(f1) OVER () - min(f1) OVER ()) AS s1
FROM ({GROUPS_SQL})"""
#: Projections on the two principal components, in closed form.
PCA_SQL = f"""
WITH s AS ({SCALED_SQL}),
m AS (SELECT var_samp(s0) AS a, covar_samp(s0, s1) AS b, var_samp(s1) AS c FROM s),
e AS (SELECT a, b, (a + c) / 2 + sqrt(power((a - c) / 2, 2) + b * b) AS top FROM m),
v AS (SELECT b / sqrt(b * b + power(top - a, 2)) AS x, (top - a) / sqrt(b * b + power(top - a, 2)) AS y FROM e)
SELECT vec_id, min(vec_id) OVER (PARTITION BY g) AS first_key,
       CAST(round(1e6 * abs(s0 * x + s1 * y)) AS BIGINT) AS pc1,
       CAST(round(1e6 * abs(s1 * x - s0 * y)) AS BIGINT) AS pc2
FROM s, v"""


def grouped_embeddings(spark, sf):
    """One row per embedding, in three well-separated groups by its label."""
    g, k = F.col("label") % 3, F.col("vec_id")
    return T(spark, sf, "embeddings").select(
        "vec_id", (1000 * g + k % 7).cast("double").alias("f0"),
        (F.when(g == 1, 500).otherwise(0) + k % 5).cast("double").alias("f1"))


def _groups(spark, sf):
    return C.kmeans_clusters(grouped_embeddings(spark, sf), GROUP_FEATURES, k=3, seed=1, layout_key="vec_id")


def _first_keys(df: DataFrame) -> DataFrame:
    """Clusters named by their lowest key: the ids K-means gives are arbitrary."""
    return df.groupBy(C.CLUSTER).agg(F.min("vec_id").alias("first_key"))


def _micro(c):
    return F.round(F.abs(c) * 1e6).cast("bigint")


@query("kmeans_clusters", f"""
SELECT vec_id, min(vec_id) OVER (PARTITION BY g) AS first_key FROM ({GROUPS_SQL})""")
def q_kmeans_clusters(spark, sf):
    """M3 + M4: K-means on scaled features; one row per vector, its cluster
    named by the lowest key in it."""
    frame = _groups(spark, sf).frame
    return frame.join(_first_keys(frame), C.CLUSTER).select("vec_id", "first_key")


@query("cluster_sizes", f"""
SELECT min(vec_id) AS first_key, count(*) AS "City Count" FROM ({GROUPS_SQL}) GROUP BY g""")
def q_cluster_sizes(spark, sf):
    """A2: vectors per cluster."""
    frame = _groups(spark, sf).frame
    return R.group_counts(frame, C.CLUSTER, "City Count").join(_first_keys(frame), C.CLUSTER).select(
        "first_key", "City Count")


@query("silhouette", f"""
WITH s AS ({SCALED_SQL}),
c AS (SELECT g, count(*) AS n, sum(s0) AS y0, sum(s1) AS y1, sum(s0 * s0 + s1 * s1) AS q FROM s GROUP BY g),
d AS (SELECT s.vec_id, s.g = c.g AS own, c.n,
             c.n * (s0 * s0 + s1 * s1) + c.q - 2 * (s0 * c.y0 + s1 * c.y1) AS total FROM s, c),
p AS (SELECT vec_id, max(CASE WHEN own THEN total / (n - 1) END) AS a,
             min(CASE WHEN NOT own THEN total / n END) AS b FROM d GROUP BY vec_id)
SELECT CAST(round(1e6 * avg((b - a) / greatest(a, b))) AS BIGINT) AS silhouette FROM p""")
def q_silhouette(spark, sf):
    """M5: silhouette (squared euclidean), in millionths.  The evaluator
    gives one number, which becomes a one-row frame."""
    score = C.silhouette(_groups(spark, sf))
    return spark.range(1).select(_micro(F.lit(score).cast("double")).alias("silhouette"))


@query("pca_2d", f"SELECT vec_id, pc1, pc2 FROM ({PCA_SQL})")
def q_pca_2d(spark, sf):
    """M6: two principal components of the scaled features, in millionths
    without sign (a component's direction is arbitrary)."""
    pca, _ = C.pca_2d(_groups(spark, sf).frame)
    arr = C.vector_to_array(F.col(C.PCA_OUT))
    return pca.select("vec_id", _micro(arr[0]).alias("pc1"), _micro(arr[1]).alias("pc2"))


@query("cluster_scatter", f"SELECT vec_id, first_key, pc1 AS x, pc2 AS y FROM ({PCA_SQL})")
def q_cluster_scatter(spark, sf):
    """M8 (+X9): x, y, cluster per vector."""
    pca, _ = C.pca_2d(_groups(spark, sf).frame)
    points = C.scatter_points(pca, ["vec_id"])
    return points.join(_first_keys(points), C.CLUSTER).select(
        "vec_id", "first_key", _micro(F.col("x")).alias("x"), _micro(F.col("y")).alias("y"))


@query("label_map", """
SELECT c_custkey, c_nationkey % 3 AS Clusters,
       CASE WHEN c_nationkey % 3 = 0 THEN 'Medium' WHEN c_nationkey % 3 = 1 THEN 'Small'
            ELSE 'Large' END AS Cluster_Type
FROM customer""")
def q_label_map(spark, sf):
    """Literal id -> label map."""
    df = T(spark, sf, "customer").select("c_custkey",
                                         (F.col("c_nationkey") % 3).alias(C.CLUSTER))
    return C.label_clusters(df, "Cluster_Type")


@query("rank_labels", """
WITH c AS (SELECT c_custkey, c_acctbal, c_nationkey % 3 AS Clusters FROM customer),
m AS (SELECT Clusters, row_number() OVER (ORDER BY avg(c_acctbal), Clusters) AS rk
      FROM c GROUP BY Clusters)
SELECT c.Clusters, c.c_custkey,
       CASE rk WHEN 1 THEN 'Small' WHEN 2 THEN 'Medium' WHEN 3 THEN 'Large'
               ELSE 'Rank' || CAST(rk AS VARCHAR) END AS Cluster_Type
FROM c JOIN m USING (Clusters)""")
def q_rank_labels(spark, sf):
    """M7: clusters named by the rank of their mean measure."""
    df = T(spark, sf, "customer").select("c_custkey", "c_acctbal",
                                         (F.col("c_nationkey") % 3).alias(C.CLUSTER))
    return C.rank_labels(df, "c_acctbal", "Cluster_Type").select(C.CLUSTER, "c_custkey",
                                                                  "Cluster_Type")


SLUM_RESULT_SQL = f"""
WITH c AS ({S.CITIES_SQL})
SELECT 'slums' AS job, 'report' AS output, City AS name, round(SlumPopulationMale, 3) AS value FROM c
UNION ALL SELECT 'slums', 'top10', City, round(SlumPopulationMale, 3) FROM (
  SELECT * FROM c ORDER BY SlumPopulationTotal DESC NULLS LAST, City LIMIT 10)
UNION ALL SELECT 'slums', 'sizes', 'all', CAST(count(*) AS DOUBLE) FROM c
UNION ALL SELECT 'slums', 'scatter', 'all', CAST(count(*) AS DOUBLE) FROM c
UNION ALL SELECT 'slums', 'means', 'all', round(sum(SlumPopulationMale), 3) FROM c
UNION ALL SELECT 'slums', 'label_means', 'out of order', CAST(0 AS DOUBLE)
UNION ALL SELECT 'slums', 'silhouette', 'positive', CAST(1 AS DOUBLE)"""


def electricity_sql(exclude: str) -> str:
    return f"""
WITH e AS (SELECT 'City' || user_id AS CityName,
                  CAST(floor(sum(CAST(round(value * 100) AS BIGINT)) / 100) AS DOUBLE) AS total
           FROM events GROUP BY user_id),
c AS (SELECT * FROM e WHERE {exclude})
SELECT 'electricity' AS job, 'report' AS output, CityName AS name, total AS value FROM c
UNION ALL SELECT 'electricity', 'sizes', 'all', CAST(count(*) AS DOUBLE) FROM c
UNION ALL SELECT 'electricity', 'scatter', 'all', CAST(count(*) AS DOUBLE) FROM c
UNION ALL SELECT 'electricity', 'means', 'all', round(sum(total), 3) FROM c
UNION ALL SELECT 'electricity', 'label_means', 'out of order', CAST(0 AS DOUBLE)
UNION ALL SELECT 'electricity', 'silhouette', 'positive', CAST(1 AS DOUBLE)"""


def published_rows(spark, job: str, table: str, key: str, measure: str, mean: str, label: str,
                   top: bool = False) -> DataFrame:
    """All gold tables of a report as (job, output, name, value): its rows,
    the top ten, the sizes, the means weighted with them, the points of the
    scatter, how many labels break the order of their means, and whether the
    silhouette is positive.  Cluster ids are arbitrary, so none appears."""
    def rows(output, frame, name, value):
        return frame.select(F.lit(job).alias("job"), F.lit(output).alias("output"), name.alias("name"),
                            value.cast("double").alias("value"))

    every = F.lit("all")
    sizes, means = spark.table(f"{table}_sizes"), spark.table(f"{table}_means")
    ranks = F.array_position(F.array(*[F.lit(x) for x in RANK_LABELS]), F.col(label))
    ordered = spark.table(f"{table}_label_means").withColumn(
        "before", F.lag(mean).over(Window.orderBy(ranks)))           # one row per label
    parts = [
        rows("report", spark.table(table), F.col(key), F.round(measure, 3)),
        rows("sizes", sizes.agg(F.sum("City Count").alias("n")), every, F.col("n")),
        rows("scatter", spark.table(f"{table}_scatter").agg(F.count("x").alias("n")), every, F.col("n")),
        rows("means", sizes.join(means, C.CLUSTER).agg(
            F.round(F.sum(F.col("City Count") * F.col(mean)), 3).alias("n")), every, F.col("n")),
        rows("label_means", ordered.agg(F.count_if(F.col(mean) < F.col("before")).alias("n")),
             F.lit("out of order"), F.col("n")),
        rows("silhouette", spark.table(f"{table}_silhouette"), F.lit("positive"),
             (F.col("silhouette") > 0).cast("int")),
    ]
    if top:
        parts.append(rows("top10", spark.table(f"{table}_top10"), F.col(key), F.round(measure, 3)))
    return functools.reduce(DataFrame.unionByName, parts)


def slum_rows(spark, table):
    return published_rows(spark, "slums", table, REP.SLUM_KEY, REP.SLUM_MEASURE, REP.SLUM_MEASURE,
                          REP.SLUM_LABEL, top=True)


def electricity_rows(spark, table):
    return published_rows(spark, "electricity", table, REP.ELECTRICITY_KEY, REP.ELECTRICITY_MEASURE,
                          REP.ELECTRICITY_MEAN_NAME, REP.ELECTRICITY_LABEL)


def published_slums(spark, sf) -> str:
    """The slum job from raw wards to gold; the name of its main table."""
    table = f"{layer_db(spark, 'gold')}.household_slums_clusters"
    report, top = REP.slum_report(S.wards_raw(spark, sf))
    REP.publish(report, table, top)
    return table


@query("slum_report", SLUM_RESULT_SQL)
def q_slum_report(spark, sf):
    """W3 (with A2, A3, M5, M7, M8, T1): wards -> cities -> clusters -> all
    gold tables, read back."""
    return slum_rows(spark, published_slums(spark, sf))


@query("electricity_report", electricity_sql("CityName NOT IN ('City7', 'City42')"))
def q_electricity_report(spark, sf):
    """W4 (M9): electricity by city -> clusters on every numeric column -> gold."""
    table = f"{layer_db(spark, 'gold')}.electricity_clusters"
    REP.publish(REP.electricity_report(S.electricity_raw(spark, sf), exclude=["City7", "City42"]), table)
    return electricity_rows(spark, table)


def _label_sql(name: str, group: str, source: str) -> str:
    return f"""
SELECT {name}, CASE {group} % 3 WHEN 0 THEN 'Small' WHEN 1 THEN 'Medium' ELSE 'Large' END AS label
FROM {source}"""


@query("slum_labels", _label_sql(
    "n_name AS City", "n_nationkey", "(SELECT DISTINCT n_name, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"))
def q_slum_labels(spark, sf):
    """The label of every city, over wards whose cities form three
    groups far apart."""
    table = f"{layer_db(spark, 'gold')}.household_slums_clusters"
    found = REP.publish(*_slums(S.separable_wards(spark, sf), table))
    return found.select("City", F.col(REP.SLUM_LABEL).alias("label"))


def _slums(raw: DataFrame, table: str) -> tuple:
    report, top = REP.slum_report(raw)
    return report, table, top


@query("electricity_labels", _label_sql(
    "'City' || user_id AS CityName", "user_id", "(SELECT DISTINCT user_id FROM events)"))
def q_electricity_labels(spark, sf):
    """W4 (M9): the label of every city, over three groups far apart."""
    table = f"{layer_db(spark, 'gold')}.electricity_clusters"
    found = REP.publish(REP.electricity_report(S.separable_electricity(spark, sf), exclude=[]), table)
    return found.select("CityName", F.col(REP.ELECTRICITY_LABEL).alias("label"))


# ============================================================ ingest / catalog

def land_files(spark, sf, root):
    """Landing CSV files made from the driver's tables (raw headers)."""
    awkward_customer(spark, sf).write.option("header", "true").option("sep", ";").csv(
        f"{root}/landing/Customers.csv")
    T(spark, sf, "orders").write.option("header", "true").csv(f"{root}/landing/orders.csv")


def ingest_config(root: str, silver: str) -> dict:
    return {
        "landing": {"path": f"{root}/landing", "file_format": "csv",
                    "read_options": {"header": "true", "delimiter": ",", "inferSchema": "true"}},
        "bronze": {"path": f"{root}/bronze", "format": "csv", "write_command": "insert overwrite"},
        "silver": {"db": silver, "table_format": "parquet"},
        "bronze_silver_mapping": {"Customers.csv": {
            "table_name": "customer_wards",
            "read_options": {"header": "true", "delimiter": ";", "inferSchema": "true"}}},
        "audit": {"db": silver, "table": "ingestion_audit"},
    }


def _ingested(spark, sf):
    root = scratch_path(spark, "ingest")
    silver = layer_db(spark, "silver")
    land_files(spark, sf, root)
    audit = ingest(spark, ingest_config(root, silver))
    return silver, audit


@query("ingest_silver", """
SELECT CAST(c_custkey AS BIGINT) AS CustKey, c_name AS CustomerName,
       CAST(c_nationkey AS BIGINT) AS Nation_Key, c_acctbal AS AcctBalUSD, c_mktsegment AS mkt_segment
FROM customer""")
def q_ingest_silver(spark, sf):
    """Landing (a ';' file) -> bronze -> silver with cleaned names."""
    silver, _ = _ingested(spark, sf)
    return as_bigint(spark.table(f"{silver}.customer_wards"), "CustKey", "Nation_Key")


@query("ingest_audit", """
SELECT 'Customers.csv' AS file_name, 'customer_wards' AS table_name,
       'insert overwrite' AS write_command, count(*) AS rows_written, true AS timed FROM customer
UNION ALL
SELECT 'orders.csv', 'orders', 'insert overwrite', count(*), true FROM orders""")
def q_ingest_audit(spark, sf):
    """W2 (+X8): the audit rows; start, end and seconds vary from run to
    run, so the check keeps whether they are consistent."""
    silver, _ = _ingested(spark, sf)
    a = spark.table(f"{silver}.ingestion_audit")
    return a.select(
        "file_name", F.regexp_extract("table_name", r"\.([^.]+)$", 1).alias("table_name"),
        "write_command", "rows_written",
        ((F.col("seconds") >= 0) & (F.col("end_time") >= F.col("start_time"))
         & (F.col("size_kb") > 0)).alias("timed"))


@query("stream_ingest", CUSTOMER_TEXT_SQL)
def q_stream_ingest(spark, sf):
    """W1 as an incremental Structured Streaming job over the landing folder."""
    root = scratch_path(spark, "stream")
    T(spark, sf, "customer").write.option("header", "true").csv(f"{root}/landing/customer")
    silver = layer_db(spark, "silver")
    stream_ingest(spark, f"{root}/landing/customer", f"{silver}.customer",
                  checkpoint=f"{root}/_checkpoint")
    return streamed_rows(spark, f"{silver}.customer")


@query("stream_replay", f"""
SELECT * FROM ({CUSTOMER_TEXT_SQL}) UNION ALL SELECT * FROM ({CUSTOMER_TEXT_SQL}) WHERE c_mktsegment = 'BUILDING'""")
def q_stream_replay(spark, sf):
    """A streamed append whose checkpoint is lost is replayed under the
    same stream and batch (its rows count once); a batch append adds up."""
    silver = layer_db(spark, "silver")
    t = f"{silver}.customer"
    c = T(spark, sf, "customer")
    text = c.select(*[F.col(n).cast("string").alias(n) for n in c.columns])
    create_streamed(text.limit(0), t)
    for batch, rows in ((0, text.where("c_mktsegment <> 'BUILDING'")), (1, text.where("c_mktsegment = 'BUILDING'")),
                        (0, text.where("c_mktsegment <> 'BUILDING'"))):
        append_once(rows, batch, t, "customers")
    Wr.insert_table(text.where("c_mktsegment = 'BUILDING'"), t)
    return streamed_rows(spark, t)


STREAM_BASE_SQL = CUSTOMER_TEXT_SQL
STREAM_UPDATES_SQL = f"""
SELECT c_custkey, c_name || '-v2' AS c_name, c_nationkey, c_acctbal, c_mktsegment
FROM ({STREAM_BASE_SQL}) WHERE c_mktsegment = 'AUTOMOBILE'
UNION ALL
SELECT CAST(-CAST(c_custkey AS BIGINT) - 1 AS VARCHAR), c_name, c_nationkey, c_acctbal, c_mktsegment
FROM ({STREAM_BASE_SQL}) WHERE c_mktsegment = 'MACHINERY'"""


@query("stream_merge", f"""
WITH base AS ({STREAM_BASE_SQL}), u AS ({STREAM_UPDATES_SQL})
SELECT * FROM base WHERE c_custkey NOT IN (SELECT c_custkey FROM u)
UNION ALL SELECT * FROM u""")
def q_stream_merge(spark, sf):
    """W1 merge mode as a stream: customers land, then a file of changed and
    new customers lands; each micro-batch is upserted on the key."""
    root = scratch_path(spark, "stream_merge")
    landing, ck = f"{root}/landing", f"{root}/_checkpoint"
    c = T(spark, sf, "customer")
    c.write.option("header", "true").csv(landing)
    silver = layer_db(spark, "silver")
    t = f"{silver}.customer"
    stream_ingest(spark, landing, t, ck, mode="merge", keys=["c_custkey"])
    changed = c.where(F.col("c_mktsegment") == "AUTOMOBILE").withColumn(
        "c_name", F.concat("c_name", F.lit("-v2")))
    new = c.where(F.col("c_mktsegment") == "MACHINERY").withColumn(
        "c_custkey", -F.col("c_custkey") - 1)
    changed.unionByName(new).write.mode("append").option("header", "true").csv(landing)
    stream_ingest(spark, landing, t, ck, mode="merge", keys=["c_custkey"])
    return spark.table(t)


@query("workflow", f"""
SELECT * FROM ({SLUM_RESULT_SQL}) UNION ALL SELECT * FROM ({electricity_sql('true')})
UNION ALL SELECT 'audit', 'rows_written', 'House_Holds.csv', CAST(count(*) AS DOUBLE)
          FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'audit', 'rows_written', 'Electricity.csv', CAST(count(DISTINCT user_id) AS DOUBLE)
          FROM events""")
def q_workflow(spark, sf):
    """Ingest the raw city files, then both cluster jobs, in order; the
    rows of every gold table and of the audit."""
    root = scratch_path(spark, "workflow")
    S.wards_raw(spark, sf).write.option("header", "true").csv(f"{root}/landing/House_Holds.csv")
    S.electricity_raw(spark, sf).write.option("header", "true") \
        .csv(f"{root}/landing/Electricity.csv")
    silver, gold = layer_db(spark, "silver"), layer_db(spark, "gold")
    cfg = {
        "landing": {"path": f"{root}/landing",
                    "read_options": {"header": "true", "inferSchema": "true"}},
        "bronze": {"path": f"{root}/bronze"},
        "silver": {"db": silver}, "gold": {"db": gold},
        "bronze_silver_mapping": {"House_Holds.csv": {"table_name": "house_holds_slums"},
                                  "Electricity.csv": {"table_name": "electricity_consumption"}},
    }
    audit = REP.run_all(spark, cfg)["audit"]
    written = audit.select(F.lit("audit").alias("job"), F.lit("rows_written").alias("output"),
                           F.col("file_name").alias("name"), F.col("rows_written").cast("double").alias("value"))
    return slum_rows(spark, f"{gold}.household_slums_clusters").unionByName(
        electricity_rows(spark, f"{gold}.electricity_clusters")).unionByName(written)


@query("create_layers", """
SELECT 'silver' AS layer, CAST(1 AS BIGINT) AS tables, count(*) AS row_count FROM customer
UNION ALL SELECT 'gold', CAST(1 AS BIGINT), count(*) FROM orders""")
def q_create_layers(spark, sf):
    """C1 (+C4, A7): create the layer databases when missing (twice: the
    second call is a no-op), land one table in each, report per layer."""
    root = scratch_path(spark, "layers")
    names = {"silver": unique_name("silver"), "gold": unique_name("gold")}
    CAT.create_layers(spark, list(names.values()), root=root)
    CAT.create_layers(spark, list(names.values()), root=root)
    Wr.insert_table(T(spark, sf, "customer"), f"{names['silver']}.customer")
    Wr.insert_table(T(spark, sf, "orders"), f"{names['gold']}.orders")
    parts = []
    for layer, db in names.items():
        tables = [r.table_name for r in CAT.list_tables(spark, db).collect()]
        counts = R.reconcile_counts({t: spark.table(f"{db}.{t}") for t in tables})
        parts.append(counts.agg(F.count(F.lit(1)).alias("tables"),
                                F.sum("row_count").alias("row_count"))
                     .select(F.lit(layer).alias("layer"), "tables", "row_count"))
    return parts[0].unionByName(parts[1])


LAYER_COUNTS_SQL = """
SELECT 'customer' AS table_name, count(*) AS row_count FROM customer
UNION ALL SELECT 'orders', count(*) FROM orders"""


def _layer_with_tables(spark, sf, prefix: str) -> str:
    db = layer_db(spark, prefix)
    for t in ("customer", "orders"):
        Wr.insert_table(T(spark, sf, t), f"{db}.{t}")
    return db


@query("list_tables", LAYER_COUNTS_SQL)
def q_list_tables(spark, sf):
    """C4: permanent tables of a layer (a temp view does not count), with the
    rows that each holds."""
    db = _layer_with_tables(spark, sf, "silver")
    T(spark, sf, "nation").createOrReplaceTempView("df")
    listed = CAT.list_tables(spark, db).select("table_name")
    spark.catalog.dropTempView("df")
    names = [r["table_name"] for r in listed.collect()]
    return listed.join(R.reconcile_counts({n: spark.table(f"{db}.{n}") for n in names}), "table_name", "left")


@query("reset_layer", f"SELECT table_name AS dropped, row_count FROM ({LAYER_COUNTS_SQL})")
def q_reset_layer(spark, sf):
    """Every table of a layer dropped through the catalog: those that the
    layer no longer lists, with the rows that each had."""
    db = _layer_with_tables(spark, sf, "gold")
    before, path = CAT.list_tables(spark, db).collect(), scratch_path(spark, "layer-counts")
    R.reconcile_counts({r["table_name"]: spark.table(f"{db}.{r['table_name']}") for r in before}).write.parquet(path)
    CAT.reset_layer(spark, db)
    had = spark.read.parquet(path)
    return had.join(CAT.list_tables(spark, db), "table_name", "left_anti").withColumnRenamed("table_name", "dropped")


@query("table_exists", """
SELECT 'orders' AS table_name, count(*) AS row_count FROM orders
UNION ALL SELECT 'ORDERS', count(*) FROM orders""")
def q_table_exists(spark, sf):
    """Case-insensitive existence test; the rows of the tables that are
    there, none for an absent name."""
    db = layer_db(spark, "silver")
    Wr.insert_table(T(spark, sf, "orders"), f"{db}.orders")
    names = ["orders", "ORDERS", "missing"]
    return R.reconcile_counts({n: spark.table(f"{db}.{n}") for n in names if Wr.table_exists(spark, n, db)})


@query("describe_schema", """
SELECT column_name AS col_name,
       CASE WHEN column_type = 'BIGINT' THEN 'bigint' WHEN column_type = 'INTEGER' THEN 'int'
            WHEN column_type = 'DOUBLE' THEN 'double' WHEN column_type = 'VARCHAR' THEN 'string'
            WHEN column_type LIKE 'TIMESTAMP%' AND column_type NOT LIKE '%TIME ZONE%'
                 THEN 'timestamp_ntz'
            ELSE lower(column_type) END AS data_type
FROM (DESCRIBE lineitem)""")
def q_describe_schema(spark, sf):
    """A table's schema as rows."""
    return CAT.describe_schema(spark, f"{source_db(spark, sf)}.lineitem")


@query("describe_database", """
SELECT 'Namespace Name' AS info_name, 'silver' AS info_value, count(*) AS row_count FROM customer
UNION ALL SELECT 'Location', 'silver.db', count(*) FROM customer""")
def q_describe_database(spark, sf):
    """A database's name and location (without the part that each run
    makes up), with the rows of the table in it."""
    db = layer_db(spark, "silver")
    Wr.insert_table(T(spark, sf, "customer"), f"{db}.customer")
    info = CAT.describe_database(spark, db).where(F.col("info_name").isin("Namespace Name", "Location"))
    shown = F.replace(F.regexp_extract("info_value", "([^/]*)$", 1), F.lit(db), F.lit("silver"))
    counts = spark.table(f"{db}.customer").agg(F.count(F.lit(1)).alias("row_count"))
    return info.select("info_name", shown.alias("info_value")).join(counts)


@query("table_detail", """
SELECT 'lineitem' AS name, 'parquet' AS format, true AS has_files, true AS bytes_as_listed, count(*) AS row_count
FROM lineitem""")
def q_table_detail(spark, sf):
    """Format, files and bytes of a table, against a listing of its folder."""
    table = f"{source_db(spark, sf)}.lineitem"
    listed = Rd.list_files(spark, f"{sf.rstrip('/')}/lineitem.parquet").agg(F.sum("size_bytes").alias("listed"))
    counts = spark.table(table).agg(F.count(F.lit(1)).alias("row_count"))
    return CAT.table_detail(spark, table).join(listed).join(counts).select(
        F.substring_index("name", ".", -1).alias("name"), "format", (F.col("num_files") > 0).alias("has_files"),
        (F.col("size_in_bytes") == F.col("listed")).alias("bytes_as_listed"), "row_count")
