"""Write PLANS.md: the formatted physical plan (tree + scan details) of the
headline queries, for review of pushdown, pruning, shuffles and broadcasts.

    python tools/plan_report.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEYS = ["rollup_city", "top_k_wards", "semi_join_distinct", "exclude_entities",
        "null_profile", "preprocess", "rank_labels", "minmax_scale", "upsert_partitioned_merge",
        "json_flatten"]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from medallion import queries as Q
    from medallion.session import build_session
    from medallion.sinks import upsert as U
    from medallion.sinks import writers as W

    spark = build_session("local[8]", shuffle_partitions=8)

    def merge_plan(spark, sf):
        db = Q.layer_db(spark, "silver")
        o = Q.T(spark, sf, "orders")
        W.insert_table(o, f"{db}.orders_p", partition_by="o_orderstatus")
        batch = Q.moved_batch(o)
        return U.merge_frames(spark.table(f"{db}.orders_p"), batch, "o_orderkey",
                              "o_orderstatus", check=False)

    out = ["# Physical plans of the headline queries", "",
           f"Generated by `tools/plan_report.py` at `{sf}` on local[8] (AQE initial plans).",
           "Scratch paths are shortened to `<scratch>`.", ""]
    for k in KEYS:
        df = merge_plan(spark, sf) if k == "upsert_partitioned_merge" else Q.QUERIES[k](spark, sf)
        text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        tree, _, details = text.partition("\n\n\n")
        keep = [ln for ln in details.splitlines()
                if ln.startswith(("(", "PushedFilters", "PartitionFilters", "ReadSchema",
                                  "Location", "Keys", "Functions", "Join type", "Arguments"))]
        body = tree + "\n\n" + "\n".join(keep)
        body = re.sub(r"file:/\S*?medallion-scratch/", "<scratch>/", body)
        body = re.sub(r"#\d+L?", "", body)
        out += [f"## {k}", "", "```", body.strip(), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                           "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))


if __name__ == "__main__":
    main()
