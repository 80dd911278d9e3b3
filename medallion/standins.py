"""Raw stand-ins for the original city tables, derived by Spark from the
driver's tables so that they grow with them.

* wards (one row per customer): City = nation name, counts from the
  customer key, slum population from the account balance, ``NA`` cells
  and a mostly-``NA`` column injected; every cell is text, as in a raw CSV.
* electricity (one row per user of ``events``): per event type the count and
  the rounded value sum, plus the rounded total; text cells again.

The SQL twins (``WARDS_SQL`` for the cleaned wards, ``CITIES_SQL`` for the
rolled-up, imputed cities) give DuckDB the same rows for the oracle checks.
``separable_wards`` and ``separable_electricity`` are the same tables with
three groups of cities far apart, so that the cluster, and the label, of every
city is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Nations whose male / female ward counts are zero (to be
# imputed), and the event types pivoted into electricity measures.
MALE_ZERO_NATIONS = (1, 5, 9, 13)
FEMALE_ZERO_NATIONS = (2, 9)
EVENT_TYPES = ("click", "view", "purchase", "signup", "error")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _txt(c):
    return c.cast("string")


def _na_when(cond, value):
    return F.when(cond, F.lit("NA")).otherwise(_txt(value))


def wards_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    key = F.col("c_custkey")
    total = F.round(F.abs(F.col("c_acctbal"))).cast("bigint")
    male = F.when(F.col("n_nationkey").isin(*MALE_ZERO_NATIONS), F.lit(0).cast("bigint")) \
        .otherwise(F.floor(total / 2).cast("bigint"))
    female = F.when(F.col("n_nationkey").isin(*FEMALE_ZERO_NATIONS), F.lit(0).cast("bigint")) \
        .otherwise(total - F.floor(total / 2).cast("bigint"))
    return j.select(
        F.col("n_name").alias("City"),
        _txt(F.col("n_regionkey")).alias("Zone"),
        F.col("c_name").alias("Ward Name"),
        _txt(key).alias("Ward No."),
        _txt(key % 7).alias("No. Notified Slums"),
        _txt(key % 5).alias("No Of Recognised Slums"),
        _txt(key % 3).alias("No Of Identfied Slums"),
        _txt(total).alias("Slum Population - Total"),
        _txt(male).alias("Slum Population - Male"),
        _txt(female).alias("Slum Population - Female"),
        _txt(key % 11).alias("Population (SC Category)"),
        _na_when(key % 19 == 0, key % 13).alias("Population (ST Category)"),
        _na_when(key % 17 == 0, F.lit(40) + key % 60).alias("Literacy Rate (Percentage)"),
        F.when(key % 3 == 0, F.lit("ok")).otherwise(F.lit("NA")).alias("Remarks"),
    )


# DuckDB twin of wards_raw after cleaning (P15 with threshold 0.5): NiceCase
# names, NA -> NULL -> 0 in numeric columns, numerics as DOUBLE, Remarks
# dropped as sparse.
WARDS_SQL = """
SELECT n_name AS City,
       CAST(n_regionkey AS DOUBLE) AS Zone,
       c_name AS WardName,
       CAST(c_custkey AS DOUBLE) AS WardNo,
       CAST(c_custkey % 7 AS DOUBLE) AS NoNotifiedSlums,
       CAST(c_custkey % 5 AS DOUBLE) AS NoOfRecognisedSlums,
       CAST(c_custkey % 3 AS DOUBLE) AS NoOfIdentfiedSlums,
       CAST(CAST(round(abs(c_acctbal)) AS BIGINT) AS DOUBLE) AS SlumPopulationTotal,
       CAST(CASE WHEN n_nationkey IN (1, 5, 9, 13) THEN 0
                 ELSE CAST(floor(CAST(round(abs(c_acctbal)) AS BIGINT) / 2) AS BIGINT) END
            AS DOUBLE) AS SlumPopulationMale,
       CAST(CASE WHEN n_nationkey IN (2, 9) THEN 0
                 ELSE CAST(round(abs(c_acctbal)) AS BIGINT)
                      - CAST(floor(CAST(round(abs(c_acctbal)) AS BIGINT) / 2) AS BIGINT) END
            AS DOUBLE) AS SlumPopulationFemale,
       CAST(c_custkey % 11 AS DOUBLE) AS PopulationSCCategory,
       CAST(CASE WHEN c_custkey % 19 = 0 THEN 0 ELSE c_custkey % 13 END AS DOUBLE)
            AS PopulationSTCategory,
       CAST(CASE WHEN c_custkey % 17 = 0 THEN 0 ELSE 40 + c_custkey % 60 END AS DOUBLE)
            AS LiteracyRatePercentage
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

# DuckDB twin of the roll-up + imputation (A1 + P13) over WARDS_SQL.
CITIES_SQL = f"""
WITH wards AS ({WARDS_SQL}),
r AS (
  SELECT City,
         sum(NoNotifiedSlums) AS NoNotifiedSlums,
         sum(NoOfRecognisedSlums) AS NoOfRecognisedSlums,
         sum(NoOfIdentfiedSlums) AS NoOfIdentfiedSlums,
         sum(SlumPopulationTotal) AS SlumPopulationTotal,
         sum(SlumPopulationMale) AS SlumPopulationMale,
         sum(SlumPopulationFemale) AS SlumPopulationFemale,
         sum(PopulationSCCategory) AS PopulationSCCategory,
         sum(PopulationSTCategory) AS PopulationSTCategory,
         avg(LiteracyRatePercentage) AS LiteracyRatePercentage
  FROM wards GROUP BY City)
SELECT City, NoNotifiedSlums, NoOfRecognisedSlums, NoOfIdentfiedSlums, SlumPopulationTotal,
       CASE WHEN SlumPopulationTotal > 0 AND SlumPopulationMale = 0
            THEN 0.52 * SlumPopulationTotal ELSE SlumPopulationMale END AS SlumPopulationMale,
       CASE WHEN SlumPopulationTotal > 0 AND SlumPopulationFemale = 0
            THEN 0.48 * SlumPopulationTotal ELSE SlumPopulationFemale END AS SlumPopulationFemale,
       PopulationSCCategory, PopulationSTCategory, LiteracyRatePercentage
FROM r
"""


def electricity_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: event counts and rounded value sums per type, and the
    rounded total (the consumption measure).  Headers are the silver names
    (spaces already removed at ingest)."""
    e = table(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("bigint")
    aggs = []
    for t in EVENT_TYPES:
        is_t = F.col("event_type") == t
        aggs.append(_txt(F.count_if(is_t)).alias(f"Number of {t} events"))
        aggs.append(_txt(F.floor(F.sum(F.when(is_t, cents).otherwise(F.lit(0))) / 100)
                         .cast("bigint")).alias(f"Units_{t}"))
    aggs.append(_txt(F.floor(F.sum(cents) / 100).cast("bigint"))
                .alias("ConsumptionofElectricityinlakhunits_TotalConsumption"))
    aggs.append(F.lit("NA").alias("Remarks"))
    city = F.concat(F.lit("City"), _txt(F.col("user_id")))
    return e.groupBy(city.alias("CityName")).agg(*aggs)


#: What lifts a group of cities above the one below it: more than all wards
#: of a city, or all events of a user, come to.
LIFT = 10 ** 12


def separable_wards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wards with three groups of cities (nation key modulo 3): the
    first ward of a city carries its group's lift, and literacy follows it."""
    raw = wards_raw(spark, sf_dir)
    number = F.col("`Ward No.`").cast("bigint")
    first = raw.groupBy("City").agg(F.min(number).alias("first"))
    group = table(spark, sf_dir, "nation").select(F.col("n_name").alias("City"), (F.col("n_nationkey") % 3).alias("g"))
    lift = F.when(number == F.col("first"), F.col("g") * LIFT).otherwise(F.lit(0).cast("bigint"))
    rows = raw.join(first.join(group, "City"), "City")

    def lifted(name: str, share: int) -> Column:
        value = F.col(f"`{name}`").cast("bigint")
        return _txt(F.when(value == 0, value).otherwise(value + F.floor(lift / share).cast("bigint")))
    own = {"Slum Population - Total": lifted("Slum Population - Total", 1),
           "Slum Population - Male": lifted("Slum Population - Male", 2),
           "Slum Population - Female": lifted("Slum Population - Female", 2),
           "Population (SC Category)": _txt(F.col("`Population (SC Category)`").cast("bigint") + lift),
           "Literacy Rate (Percentage)": _txt(40 + 20 * F.col("g"))}
    return rows.select(*[own.get(c, F.col(f"`{c}`")).alias(c) for c in raw.columns])


def separable_electricity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users with three groups (id modulo 3), every measure lifted."""
    raw = electricity_raw(spark, sf_dir)
    g = F.regexp_extract("CityName", "([0-9]+)$", 1).cast("bigint") % 3
    return raw.select(*[c if c in ("CityName", "Remarks") else _txt(F.col(c).cast("bigint") + g * LIFT).alias(c)
                        for c in raw.columns])
