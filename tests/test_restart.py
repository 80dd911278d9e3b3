"""Restart of the workflow."""

import pytest

from medallion import standins as S
from medallion.plans import ingest as I
from medallion.plans import reports as P
from medallion.session import unique_name
from tests.conftest import SF


@pytest.fixture()
def cfg(spark, tmp_path):
    root = str(tmp_path)
    S.wards_raw(spark, SF).write.option("header", "true").csv(f"{root}/landing/House_Holds.csv")
    S.electricity_raw(spark, SF).write.option("header", "true").csv(f"{root}/landing/Electricity.csv")
    silver, gold = unique_name("silver"), unique_name("gold")
    return {"landing": {"path": f"{root}/landing", "read_options": {"header": "true", "inferSchema": "true"}},
            "bronze": {"path": f"{root}/bronze"}, "silver": {"db": silver}, "gold": {"db": gold},
            "audit": {"db": silver, "table": "audit"},
            "bronze_silver_mapping": {"House_Holds.csv": {"table_name": "house_holds_slums"},
                                      "Electricity.csv": {"table_name": "electricity_consumption"}}}


def states(spark, cfg, run):
    t = spark.table(f"{cfg['gold']['db']}.{P.STEP_TABLE}").where(f"run = '{run}'")
    return [(r.step, r.status) for r in t.orderBy("started", "ended").collect()]


def test_rerun_begins_at_the_step_that_failed(spark, cfg, monkeypatch):
    done = []
    for where, name in ((P, "slum_report"), (P, "electricity_report"), (I, "ingest")):
        def noted(*a, right=getattr(where, name), name=name, **k):
            done.append(name)
            return right(*a, **k)
        monkeypatch.setattr(where, name, noted)

    def killed(*a, **k):
        raise RuntimeError("killed in step two")
    monkeypatch.setattr(P, "publish", killed)
    with pytest.raises(RuntimeError, match="killed"):
        P.run_all(spark, cfg, "monday")
    assert done == ["ingest", "slum_report"]
    assert states(spark, cfg, "monday") == [("audit", "done"), ("slums", "failed")]
    monkeypatch.undo()

    for where, name in ((P, "slum_report"), (P, "electricity_report"), (I, "ingest")):
        def noted(*a, right=getattr(where, name), name=name, **k):
            done.append(name)
            return right(*a, **k)
        monkeypatch.setattr(where, name, noted)
    done.clear()
    out = P.run_all(spark, cfg, "monday")
    assert done == ["slum_report", "electricity_report"]        # not the ingest again
    assert sorted(r.file_name for r in out["audit"].collect()) == ["Electricity.csv", "House_Holds.csv"]
    assert out["slums"].count() and out["electricity"].count()
    first = {r[0] for r in out["slums"].select("_metadata.file_path").distinct().collect()}

    done.clear()                                                # all done: nothing is
    out = P.run_all(spark, cfg, "monday")
    assert done == [] and {r[0] for r in out["slums"].select("_metadata.file_path").distinct().collect()} == first
    assert states(spark, cfg, "monday")[-2:] == [("slums", "done"), ("electricity", "done")]

    # a changed file is ingested again, and the report over it made anew
    S.wards_raw(spark, SF).limit(50).write.mode("overwrite").option("header", "true").csv(
        f"{cfg['landing']['path']}/House_Holds.csv")
    out = P.run_all(spark, cfg, "monday")
    assert done[:2] == ["ingest", "slum_report"]
    done.clear()                                                # another run, and none: all of it
    P.run_all(spark, cfg, "tuesday")
    P.run_all(spark, cfg)
    assert done == ["ingest", "slum_report", "electricity_report"] * 2
    assert {r.run for r in spark.table(f"{cfg['gold']['db']}.{P.STEP_TABLE}").collect()} == {"monday", "tuesday"}


def test_without_an_audit_table(spark, cfg):
    cfg = {k: v for k, v in cfg.items() if k != "audit"} | {"jobs": {}, "run": "r"}
    assert P.run_all(spark, cfg)["audit"].count() == 2
    again = P.run_all(spark, cfg)["audit"]
    assert again.count() == 0 and "rows_rejected" in again.columns
