from medallion import standins as S
from medallion.plans import reports as REP
from medallion.session import unique_name
from tests.conftest import SF


def test_slum_report_invariants_and_round_trip(spark):          # W3, A2, A3, T1
    raw = S.wards_raw(spark, SF)
    rep, top = REP.slum_report(raw)
    cities = REP.slum_entities(raw).count()
    sizes = {r.Clusters: r["City Count"] for r in rep.sizes.collect()}
    assert sum(sizes.values()) == cities
    labels = {r.Clusters: r.Slum_Cluster_Type for r in
              rep.report.select("Clusters", "Slum_Cluster_Type").distinct().collect()}
    assert set(labels.values()) <= {"Small", "Medium", "Large"}
    means = {r.Clusters: r.SlumPopulationMale for r in rep.means.collect()}
    order = sorted(means, key=means.get)
    assert [labels[c] for c in order] == ["Small", "Medium", "Large"][:len(order)]
    assert rep.silhouette is None or -1 <= rep.silhouette <= 1
    assert top.count() == min(10, cities)
    gold = unique_name("gold")
    spark.sql(f"CREATE DATABASE {gold}")
    back = REP.publish(rep, f"{gold}.household_slums_clusters")
    assert back.count() == cities
    assert dict(back.dtypes)["features"] == "array<double>"


def test_electricity_report_excludes_and_uses_all_numeric(spark):  # W4, F1, M9
    raw = S.electricity_raw(spark, SF)
    first = raw.select("CityName").first().CityName
    rep = REP.electricity_report(raw, exclude=[first])
    names = {r.CityName for r in rep.report.select("CityName").collect()}
    assert first not in names and len(names) == raw.count() - 1
    assert len(rep.result.feature_cols) == 11                   # every numeric column
    assert "AverageElectricityConsumption" in rep.means.columns
    rep.result.unpersist()


def test_api_table_job(spark, tmp_path):                        # W5
    import json
    docs = [{"count": 1, "entries": [{"API": "x", "City": "Pune", "Ward  Name": "W1"}]},
            {"count": 1, "entries": [{"API": "y", "City": "Agra", "Ward  Name": "W2"}]}]
    p = tmp_path / "docs.json"
    p.write_text("\n".join(json.dumps(d) for d in docs))
    out = REP.api_table(spark, str(p), str(tmp_path / "out"))
    assert sorted(out.columns) == ["api", "city", "ward name"]
    assert out.count() == 2
