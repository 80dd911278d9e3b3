"""Run the workflow (W6) from a JSON configuration file:

    python -m medallion config.json [--master local[4]] [--run NAME]

On a cluster, ship the package (``--py-files``) and call ``main`` from the
submitted script; the master then comes from ``spark-submit``.

The configuration is the dict documented in ``medallion.plans.ingest`` and
``medallion.plans.reports.run_all``.  Prints the audit rows as JSON lines.
"""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None, spark=None) -> int:
    ap = argparse.ArgumentParser(prog="medallion")
    ap.add_argument("config", help="JSON file with the layer configuration")
    ap.add_argument("--master", default=None, help="Spark master (default: from spark-submit)")
    ap.add_argument("--run", default=None, help="name of the run: a rerun under it begins at the step that failed")
    args = ap.parse_args(argv)
    with open(args.config, encoding="utf-8") as fh:
        cfg = json.load(fh)
    if spark is None:
        from pyspark.sql import SparkSession
        b = SparkSession.builder.appName("medallion")
        if args.master:
            b = b.master(args.master)
        spark = b.getOrCreate()
    from .plans.reports import run_all
    out = run_all(spark, cfg, args.run)
    for row in out["audit"].toJSON().collect():      # one row per ingested file
        print(row)
    return 0


if __name__ == "__main__":
    sys.exit(main())
