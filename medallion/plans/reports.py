"""Silver -> gold jobs: the entity cluster report shared by the slum job
(W3) and the electricity job (W4), the API table job (W5) and the
sequential workflow (W6).
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster as C
from ..operators.clean import drop_columns, exclude_values, preprocess
from ..operators.rollup import group_counts, group_means, impute_population, rollup, top_k
from ..sinks.writers import DEFAULT_FORMAT, export_csv, write_sink
from ..sources.json_docs import DEFAULT_FIELDS, read_json_records

# Fixed values of the slum job: columns dropped before the roll-up, the
# summed counts, the averaged rate, the clustering features, the label
# column and the K-means settings.
SLUM_DROP = ("Zone", "WardName", "WardNo.")
SLUM_KEY = "City"
SLUM_SUMS = ("NoNotifiedSlums", "NoOfRecognisedSlums", "NoOfIdentfiedSlums",
             "SlumPopulationTotal", "SlumPopulationMale", "SlumPopulationFemale",
             "PopulationSCCategory", "PopulationSTCategory")
SLUM_AVGS = ("LiteracyRatePercentage",)
SLUM_FEATURES = ("SlumPopulationTotal", "SlumPopulationMale", "PopulationSCCategory",
                 "PopulationSTCategory", "LiteracyRatePercentage")
SLUM_LABEL = "Slum_Cluster_Type"
SLUM_MEASURE = "SlumPopulationMale"
# Fixed values of the electricity job: the excluded cities, the key, the
# measure averaged per cluster and the label column.
ELECTRICITY_EXCLUDE = ("Port Blair", "DHARAMSHALA")
ELECTRICITY_KEY = "CityName"
ELECTRICITY_MEASURE = "ConsumptionofElectricityinlakhunitsTotalConsumption"
ELECTRICITY_MEAN_NAME = "AverageElectricityConsumption"
ELECTRICITY_LABEL = "Electricity_consumption_cluster_Type"
NULL_THRESHOLD = 0.5
K = 3
SEED = 1


@dataclass
class ClusterReport:
    report: DataFrame        # gold rows: entity columns, vectors as arrays, Clusters, label
    sizes: DataFrame         # A2: Clusters, City Count
    means: DataFrame         # A3: per cluster
    label_means: DataFrame   # A3: per label
    scatter: DataFrame       # M8: key, x, y, Clusters
    silhouette: float | None
    result: C.ClusterResult
    cached: tuple = ()       # further frames this report cached

    def release(self) -> None:
        self.result.unpersist()
        for df in self.cached:
            df.unpersist()


def cluster_report(df: DataFrame, key: str, features: Sequence[str], measures: Sequence[str],
                   label_col: str, rank_measure: str, labeling: str = "rank",
                   k: int = K, seed: int = SEED, mean_names: Mapping[str, str] | None = None
                   ) -> ClusterReport:
    """M1-M8 + A2/A3 + P14/M7 for one entity table."""
    res = C.kmeans_clusters(df, features, k=k, seed=seed, layout_key=key)
    score = C.silhouette(res)
    pca_frame, _ = C.pca_2d(res.frame)
    scatter = C.scatter_points(pca_frame, [key])
    if labeling == "rank":
        labelled = C.rank_labels(res.frame, rank_measure, label_col)
    elif labeling == "map":
        labelled = C.label_clusters(res.frame, label_col)
    else:
        raise ValueError(f"unknown labeling {labeling!r}")
    names = dict(mean_names or {})
    means = group_means(res.frame, C.CLUSTER, measures)
    label_means = group_means(labelled, label_col, measures)
    if names:
        means = means.withColumnsRenamed(names)
        label_means = label_means.withColumnsRenamed(names)
    return ClusterReport(C.portable(labelled), group_counts(res.frame, C.CLUSTER), means,
                         label_means, scatter, score, res)


def _require(df: DataFrame, cols: Sequence[str], job: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{job}: columns {missing} are missing after cleaning "
                         f"(dropped as sparse or absent); have {df.columns}")


def slum_entities(raw: DataFrame, null_threshold: float = NULL_THRESHOLD) -> DataFrame:
    """W3 up to the clustering input: P15 -> P6 -> A1 -> P13."""
    clean = preprocess(raw, null_threshold).frame
    _require(clean, (SLUM_KEY,) + SLUM_SUMS + SLUM_AVGS, "slum job")
    clean = drop_columns(clean, SLUM_DROP)
    rolled = rollup(clean, SLUM_KEY, SLUM_SUMS, SLUM_AVGS)
    return impute_population(rolled)


def slum_report(raw: DataFrame, labeling: str = "rank", k: int = K, seed: int = SEED
                ) -> tuple[ClusterReport, DataFrame]:
    """Silver wards -> gold city clusters; also returns the top-10
    cities by slum population (T1, the data behind the bar chart)."""
    # one row per city: cached so the top-10 list and the clustering do not
    # each re-read the ward rows
    cities = slum_entities(raw).persist(StorageLevel.MEMORY_AND_DISK)
    top = top_k(cities, "SlumPopulationTotal", 10, tie_break=[SLUM_KEY],
                cols=[SLUM_KEY, "SlumPopulationMale", "SlumPopulationFemale"])
    rep = cluster_report(cities, SLUM_KEY, SLUM_FEATURES,
                         ["SlumPopulationMale", "SlumPopulationFemale"], SLUM_LABEL,
                         SLUM_MEASURE, labeling, k, seed)
    rep.cached = (cities,)
    return rep, top


def electricity_report(raw: DataFrame, exclude: Sequence[str] = ELECTRICITY_EXCLUDE,
                       labeling: str = "rank", k: int = K, seed: int = SEED) -> ClusterReport:
    """Silver electricity -> gold clusters on every numeric column."""
    pre = preprocess(raw, NULL_THRESHOLD)
    df = pre.frame
    _require(df, (ELECTRICITY_KEY, ELECTRICITY_MEASURE), "electricity job")
    df = exclude_values(df, ELECTRICITY_KEY, list(exclude))
    return cluster_report(df, ELECTRICITY_KEY, pre.numeric_cols, [ELECTRICITY_MEASURE],
                          ELECTRICITY_LABEL, ELECTRICITY_MEASURE, labeling, k, seed,
                          mean_names={ELECTRICITY_MEASURE: ELECTRICITY_MEAN_NAME})


def report_outputs(report: ClusterReport, top: DataFrame | None = None) -> dict[str, DataFrame]:
    """Everything a report holds, by the suffix of its gold table."""
    spark = report.report.sparkSession
    out = {"": report.report, "_sizes": report.sizes, "_means": report.means, "_label_means": report.label_means,
           "_scatter": report.scatter,
           "_silhouette": spark.range(1).select(F.lit(report.silhouette).cast("double").alias("silhouette"))}
    return out if top is None else {**out, "_top10": top}


def publish(report: ClusterReport, table: str, top: DataFrame | None = None,
            fmt: str = DEFAULT_FORMAT) -> DataFrame:
    """K4 into gold, every output of the report in a table of its own
    (``table`` and, with a suffix, sizes, means, scatter points, silhouette
    and the top ten), then the main one read back (the job's last step).  The
    small tables are written side by side, after the rows they come from."""
    spark = report.report.sparkSession

    def write(output: tuple[str, DataFrame]) -> None:
        suffix, frame = output
        write_sink(frame, table=f"{table}{suffix}", mode="overwrite", fmt=fmt, on_empty="write")

    main, *small = report_outputs(report, top).items()
    write(main)
    with ThreadPoolExecutor(max_workers=len(small)) as pool:
        list(pool.map(write, small))
    report.release()
    return spark.table(table)


def api_table(spark: SparkSession, json_path: str, out_path: str, key: str | None = "entries",
              fields: Sequence[str] | None = DEFAULT_FIELDS) -> DataFrame:
    """Landed API documents -> flat table -> CSV export; returns the
    exported rows read back."""
    df = read_json_records(spark, json_path, key, fields)
    export_csv(df, out_path)
    return spark.read.option("header", "true").option("escape", '"').csv(out_path)


# The silver table each job reads and the gold table it writes.
JOBS = {"slums": {"source": "house_holds_slums", "target": "household_slums_clusters"},
        "electricity": {"source": "electricity_consumption", "target": "electricity_clusters"}}


#: What the state of a step is kept as: the log of all tries, newest last.
STEP_TABLE = "workflow_steps"
STEP_SCHEMA = ("run string, step string, input string, status string, started timestamp, ended timestamp, "
               "detail string")


class Steps:
    """The steps of one run, and which of them are done.

    Each try of a step appends a row to the state table: the run, the step, a
    digest of what it reads, ``done`` or ``failed``.  A step is skipped if its
    last row in this run says that it was done with the same input; so a rerun
    under the same name begins at the step that failed, and one whose input
    has changed meanwhile is done again, as is what comes after it."""

    def __init__(self, spark: SparkSession, table: str, run: str):
        self.spark, self.table, self.run = spark, table, run
        if not spark.catalog.tableExists(table):
            spark.sql(f"CREATE TABLE {table} ({STEP_SCHEMA}) USING parquet")
        spark.catalog.refreshTable(table)
        last = spark.table(table).where(F.col("run") == run).groupBy("step").agg(
            F.max(F.struct("ended", "input", "status")).alias("last")).select("step", "last.*")
        self.state = {r["step"]: r for r in last.collect()}           # a row per step

    def todo(self, step: str, given: str) -> bool:
        last = self.state.get(step)
        return last is None or last["status"] != "done" or last["input"] != given

    def note(self, step: str, given: str, status: str, started: dt.datetime, detail: str = "") -> None:
        row = (self.run, step, given, status, started, _now(), detail)
        self.spark.createDataFrame([row], STEP_SCHEMA).coalesce(1).write.insertInto(self.table)

    def do(self, step: str, given: Callable[[], str], work: Callable[[], object]) -> bool:
        """Run a step unless it is done; whether it was run.  The digest is
        taken before the step, so an input that changes while it runs makes
        the next run do it again."""
        digest, started = given(), _now()
        if not self.todo(step, digest):
            return False
        try:
            work()
        except BaseException as exc:
            self.note(step, digest, "failed", started, f"{type(exc).__name__}: {exc}"[:500])
            raise
        self.note(step, digest, "done", started)
        return True


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def files_digest(listing: DataFrame) -> str:
    """One value for a listing of files (path, size_bytes, modified), in any
    order; made on the executors."""
    h = F.xxhash64("path", "size_bytes", "modified").cast("decimal(20,0)")
    r = listing.agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("s")).first()
    return f"{r['n']}:{r['s']}"


def table_digest(spark: SparkSession, table: str) -> str:
    """The files a table's rows lie in, by path, size and time."""
    spark.catalog.refreshTable(table)
    m = F.col("_metadata")
    return files_digest(spark.table(table).select(
        m["file_path"].alias("path"), m["file_size"].alias("size_bytes"),
        m["file_modification_time"].alias("modified")).distinct())


def run_all(spark: SparkSession, cfg: Mapping, run: str | None = None) -> dict[str, DataFrame]:
    """Ingest, then the slum and electricity jobs, in order.

    Both jobs run unless the configuration has a ``jobs`` key, which then
    names the ones to run (``{"slums": {}}``) and may rename their ``source``
    and ``target``.  A source table that is not there is an error.

    With a name for the ``run`` (or ``"run"`` in the configuration) the state
    of every step is kept (``Steps``, table ``workflow_steps`` in the gold
    database), and a rerun under that name begins at the step that failed."""
    from .ingest import ingest, landing_manifest, normalise_config

    cfg = normalise_config(cfg)
    run = run or cfg.get("run")
    silver = cfg.get("silver", {}).get("db", "silver")
    gold = cfg.get("gold", {}).get("db", "gold")
    fmt = cfg.get("gold", {}).get("table_format") or DEFAULT_FORMAT
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{gold}`")
    jobs = cfg.get("jobs", JOBS)
    unknown = set(jobs) - set(JOBS)
    if unknown:
        raise ValueError(f"unknown jobs {sorted(unknown)}; known are {sorted(JOBS)}")
    steps = Steps(spark, f"{gold}.{STEP_TABLE}", run) if run else None
    out: dict[str, DataFrame] = {}
    plain = hashlib.sha1(json.dumps(cfg, sort_keys=True, default=str).encode()).hexdigest()

    def do(step: str, given: Callable[[], str], work: Callable[[], DataFrame]) -> bool:
        def keep() -> None:
            out[step] = work()
        if steps is None:
            keep()
            return True
        return steps.do(step, given, keep)

    def landed() -> str:
        landing = cfg.get("landing", {}).get("path")
        return f"{plain}:{files_digest(landing_manifest(spark, cfg, landing)) if landing else ''}"

    if not do("audit", landed, lambda: ingest(spark, cfg)):
        out["audit"] = _audit_of(spark, cfg, steps.state["audit"]["ended"])
    for name in JOBS:
        if name not in jobs:
            continue
        names = {**JOBS[name], **(jobs[name] or {})}
        source, target = f"{silver}.{names['source']}", f"{gold}.{names['target']}"

        def report() -> DataFrame:
            raw = spark.table(source)
            rep, top = slum_report(raw) if name == "slums" else (electricity_report(raw), None)
            return publish(rep, target, top, fmt)

        if not do(name, lambda: f"{json.dumps(names, sort_keys=True)}:{fmt}:{table_digest(spark, source)}", report):
            out[name] = spark.table(target)
    return out


def _audit_of(spark: SparkSession, cfg: Mapping, ended: dt.datetime) -> DataFrame:
    """The audit rows of the ingest that a rerun skips: of each file the
    last one up to its end; no rows if no audit table is kept."""
    from .ingest import AUDIT_SCHEMA

    audit = cfg.get("audit")
    if not audit or not spark.catalog.tableExists(f"{audit['db']}.{audit['table']}"):
        return spark.createDataFrame([], AUDIT_SCHEMA).withColumn("seconds", F.lit(None).cast("bigint"))
    rows = spark.table(f"{audit['db']}.{audit['table']}").where(F.col("end_time") <= F.lit(ended))
    last = F.max_by(F.struct(*rows.columns), "end_time").alias("row")
    return rows.groupBy(F.col("file_name").alias("__file")).agg(last).select("row.*")
