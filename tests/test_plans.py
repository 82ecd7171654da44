"""Small fixtures with known results."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from territoria import sinks
from territoria.functions.numbers import scaled
from territoria.operators import aggregates, joins, ranks, reshape
from territoria.plans import governance, imports, quality, scoring
from territoria.sources import files

SPEC = "id long, level string, code string, period string, indicator string, value double, unit string, confidence double, updated string, created string"


@pytest.fixture(scope="module")
def cohort(spark):
    a, b = "2025-01-01", "2025-02-01"
    rows = [
        ("department", "59", "2025", "risk_a", 10.0, "%", 0.8, a), ("department", "59", "2025", "risk_a", 99.0, "%", 0.2, b), ("department", "59", "2025", "risk_b", 1000.0, "euros", 0.8, a), ("department", "59", "2025", "risk_c", 8.0, "count", 0.8, a),
        ("department", "2A", "2025", "risk_a", 20.0, "%", 0.8, a), ("department", "2A", "2025", "risk_b", 2000.0, "euros", 0.8, a), ("department", "2B", "2025", "risk_c", 4.0, "count", 0.8, a),
        ("region", "32", "2025", "risk_a", 15.0, "%", 0.8, a), ("region", "94", "2025", "risk_a", 25.0, "%", 0.8, a), ("department", "59", "2024", "risk_a", 5.0, "%", 0.8, a), ("department", "59", "2025", "risk_b", 9999.0, "dollars", 0.9, b),
    ]
    obs = spark.createDataFrame([(k, lv, c, p, i, v, u, conf, up, up) for k, (lv, c, p, i, v, u, conf, up) in enumerate(rows)], SPEC)
    conf = spark.createDataFrame([(0, "risk_a", 0.5, "positive", "%"), (1, "risk_b", 0.3, "negative", "euros"), (2, "risk_c", 0.2, "positive", "count")], "ord int, indicator string, weight double, direction string, expected_unit string")
    return obs, conf


def test_scores(cohort):
    obs, conf = cohort
    got = {(r["level"], r["period"], r["code"]): r for r in scoring.scores(obs, conf).collect()}
    assert got["department", "2025", "59"]["status"] == "valid"
    partial = got["department", "2025", "2A"]
    assert partial["status"] == "partial" and round(partial["coverage"], 9) == 0.8 and partial["missing"] == ["risk_c"]
    low = got["department", "2025", "2B"]
    assert low["status"] == "insufficient_data" and low["score"] is None
    assert {k[2] for k in got if k[0] == "region"} == {"32", "94"}


@pytest.mark.parametrize("names", ["abcd", "dcba"])
def test_coverage_does_not_depend_on_the_order_of_rows(spark, names):
    """Weights of 0.15, 0.2, 0.25 and 0.3 cover 0.9, whatever their sum in doubles is in the order of rows."""
    weights = [(k, n, w, "positive", "u") for k, (n, w) in enumerate(zip(names + "e", (0.15, 0.2, 0.25, 0.3, 0.1), strict=True))]
    conf = spark.createDataFrame(weights, "ord int, indicator string, weight double, direction string, expected_unit string")
    rows = [(k, "department", "1", f"p{k // 4}", names[k % 4], 1.0, "u", 1.0, "", "") for k in range(400)]
    scored = scoring.scores(spark.createDataFrame(rows, SPEC), conf, 0.9)
    assert {tuple(r) for r in scored.select("coverage", "status").collect()} == {(0.9, "partial")} and scored.where("score is not null").count() == 100


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_score_filters_on_either_plan(spark, adaptive):
    """20 of 25 departments cover 0.9 or all."""
    from territoria.catalogue import QUERIES

    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        assert QUERIES["score_filters"](spark, "/root/testdata/sf0.01").count() == 20
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_gates_come_before_the_pick(cohort):
    obs, conf = cohort
    picked = {(r["code"], r["indicator"]): r["value"] for r in scoring.picked(obs.where("period = '2025'"), conf).collect()}
    assert picked["59", "risk_a"] == 10.0 and picked["59", "risk_b"] == 1000.0
    warnings = [r["warning"] for r in scoring.gated(obs, conf).where("warning is not null").collect()]
    assert len(warnings) == 1 and warnings[0].startswith("incompatible_unit:risk_b")


def test_contributions_sum_to_the_score(cohort):
    obs, conf = cohort
    parts = scoring.details(scoring.picked(obs, conf), conf).groupBy("level", "period", "code").agg(F.sum("contribution").alias("s"), F.sum("effective_weight").alias("w"))
    for r in parts.join(scoring.scores(obs, conf).where("score is not null"), ["level", "period", "code"]).collect():
        assert abs(r["s"] - r["score"]) < 1e-9 and abs(r["w"] - 1) < 1e-9


def test_versions(spark):
    a = spark.createDataFrame([("01", "2024", 20.0), ("02", "2024", 80.0)], "code string, period string, score double")
    b = spark.createDataFrame([("01", "2024", 25.0), ("02", "2024", 75.0)], "code string, period string, score double")
    r = governance.comparison(governance.comparison_rows(a, b)).first()
    assert (r["compared"], r["spearman"], r["mean_abs_delta"]) == (2, 1.0, 5.0)
    with pytest.raises(Exception, match="repeat"):
        governance.comparison_rows(a.union(a), b).collect()
    named = lambda rows: spark.createDataFrame(rows, "code string, name string, v int")
    assert joins.matched(named([("1", None, 1), ("2", "x", 2)]), named([("1", None, 3)]).withColumnRenamed("v", "w"), ["code", "name"]).collect() == [("1", None, 1, 3)]


def test_ranks_and_percentiles(spark):
    r = np.random.default_rng(1)
    p = pd.DataFrame({"k": r.integers(0, 4, 3000), "v": np.round(r.standard_normal(3000), 2), "w": r.standard_normal(3000)})
    p.loc[p.k == 3, "v"] = 1.5  # a group of one value
    df = spark.createDataFrame(p)
    got = ranks.percentiles(df, ["k"], "v", {"lo": 0.05, "hi": 0.95}).toPandas().set_index("k").sort_index()
    want = p.groupby("k").v.quantile([0.05, 0.95]).unstack()
    assert np.allclose(got[["lo", "hi"]], want) and got.n.sum() == 3000
    for n in (1, 2, 3, 30):
        few = p.head(n)
        assert np.isclose(ranks.percentiles(spark.createDataFrame(few), [], "w", {"x": 0.05}).first()["x"], few.w.quantile(0.05))
    g = ranks.average_ranks(df, {"v": "r"}, ["k"]).toPandas()
    assert len(g) == 3000 and np.allclose(g.r, g.groupby("k").v.rank())
    assert (ranks.places(df.select("k", "w"), ["k"], "w").toPandas().sort_values(["k", "w"]).place.to_numpy() == np.arange(1, 3001)).all()
    assert ranks.percentiles(df.limit(0), ["k"], "v", {"x": 0.5}).count() == 0 and ranks.places(df.limit(0), ["k"], "w").count() == 0


def test_scenarios(spark):
    values = spark.createDataFrame([("x", "a", 10.0), ("x", "b", 0.0)], "code string, indicator string, value double")
    limits = spark.createDataFrame([("a", 0.0, 10.0), ("b", 0.0, 10.0)], "indicator string, lo double, hi double")
    weights = spark.createDataFrame([("s", "a", 0.6, "positive"), ("s", "b", 0.4, "negative")], "scenario string, indicator string, weight double, direction string")
    assert governance.scenario_scores(values, limits, weights, scaled).first()["score"] == 100.0


def test_communes(spark):
    wide = spark.createDataFrame([("01001", "01", 100.0, 5.0), ("01002", "01", 200.0, 7.0)], "CODGEO string, DEP string, P20_POP double, TX_CHOM double")
    from territoria.functions.rules import aggregation_rule

    rows = reshape.long_form(wide, ["CODGEO", "DEP"], ["P20_POP", "TX_CHOM"])
    assert rows.count() == 4
    got = {r["indicator_code"]: r["value"] for r in aggregates.by_rule(rows.withColumn("rule", aggregation_rule(F.col("indicator_code"))), ["DEP", "indicator_code"], "rule", "value").collect()}
    assert got == {"P20_POP": 300.0, "TX_CHOM": 6.0}


def test_unemployment_and_regions(spark):
    macro = spark.createDataFrame([("01", "r", 2022, 500.0, 50.0), ("03", "r", 2022, 1000.0, 200.0)], "dept string, region string, year int, ACT double, CHOM double")
    months = spark.createDataFrame([("2025-06",), ("2021-06",)], "period string")
    assert {r["dept"]: r["value"] for r in imports.unemployment(macro, months, ["dept"]).collect()} == {"01": 10.0, "03": 20.0}
    assert round(imports.unemployment(macro, months, ["region"]).first()["value"], 6) == round(250 / 1500 * 100, 6)


def test_inflation(spark):
    index = spark.createDataFrame([("2024-01", 100.0), ("2025-01", 102.5), ("2025-02", 103.0)], "period string, value double")
    got = {r["period"]: round(r["rate"], 6) for r in imports.inflation(index).collect()}
    assert got == {"2025-01": 2.5, "2025": 2.5}


def test_lexicographic_periods(spark):
    annual, keys = spark.createDataFrame([(2021, 1.0)], "year int, v double"), spark.createDataFrame([("2021",), ("2021-01",), ("2023",)], "period string")
    assert sorted(r["period"] for r in joins.propagated(annual, keys, "year", "period").collect()) == ["2021-01", "2023"]


def test_mean_debt_and_legacy(spark):
    assert imports.mean_debt(spark.createDataFrame([(68215.5, 1758.0), (1.0, 0.0)], "thousands double, cases double")).first()["value"] == 68215.5 * 1000 / 1758
    assert [r["code"] for r in imports.legacy(spark.createDataFrame([(2024, "2A", "x", 12.0), (2024, "Nom sans code", "x", 1.0)], "year int, region string, indicator_name string, value double")).collect()] == ["2A"]


def test_published(spark):
    rows = spark.createDataFrame([("01", "DEP", "PR_MD60", "F", 13.3), ("01", "COM", "PR_MD60", "F", 1.0), ("03", "REG", "MED_SL", "P", 1.0), ("03", "DEP", "MED_SL", "F", float("nan"))], "GEO string, GEO_OBJECT string, FILOSOFI_MEASURE string, CONF_STATUS string, OBS_VALUE double")
    assert imports.published(rows).count() == 1


def test_curated(spark):
    raw = spark.createDataFrame([(2025, "février", "2a", "Total", "5.2"), (2025, "2", "2b", "TOTAL ", "n.d.")], "reference_year int, reference_month string, departement_code string, indicator_name string, value string")
    dictionary = spark.createDataFrame([("TOTAL", "total", "total", "milliards_euros")], "name string, indicator_code string, indicator_group string, unit string")
    got = quality.curated(raw, dictionary).collect()
    assert [(r["departement_code"], r["reference_period"], r["indicator_code"], r["value"]) for r in got] == [("2A", "2025-02", "total", 5.2), ("2B", "2025-02", "total", None)]


def test_filings(spark):
    rows = spark.createDataFrame([(2025, 1, f"{k:02d}", "x", 1.0, "f") for k in range(8)], "year int, month int, code string, indicator string, value double, file string")
    empty, warnings = quality.filings(rows)
    assert empty.isEmpty() and warnings
    assert quality.filings(rows.union(rows), 8)[0].count() == 8
    with pytest.raises(ValueError):
        quality.filings(rows.withColumn("value", F.lit(-1.0)))


def test_idempotent_sink(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    path = f"{tmp_path}/t"
    assert sinks.insert_if_absent(rows, path, ["k"], dry_run=True) == {"inserted": 2, "unchanged": 0}
    assert sinks.insert_if_absent(rows, path, ["k"]) == {"inserted": 2, "unchanged": 0}
    assert sinks.insert_if_absent(rows, path, ["k"]) == {"inserted": 0, "unchanged": 2}


def test_expectations_and_overrides(spark):
    rows = spark.createDataFrame([(1, "a", 42.0, 1)], "id int, k string, value double, version int")
    with pytest.raises(ValueError, match="repeated"):
        sinks.expect(rows.union(rows), unique=["id"])
    with pytest.raises(ValueError, match="unknown"):
        sinks.expect(rows, known={"k": rows.where("k = 'z'").select("k")})
    with pytest.raises(ValueError, match="fails"):
        sinks.expect(rows, checks={"small": "value < 10"})
    assert {r["value"] for r in sinks.patched(rows, 1, {"value": 43.0}, 2).collect()} == {42.0, 43.0}
    with pytest.raises(ValueError):
        sinks.patched(rows, 1, {}, 2)
    with pytest.raises(LookupError):
        sinks.patched(rows, 9, {"value": 1.0}, 2)


def test_journal(spark, tmp_path):
    path = f"{tmp_path}/j"
    assert sinks.journalled(spark, path, "r1", {"a": lambda: True, "b": lambda: False}) == "quality_failed"
    with pytest.raises(ZeroDivisionError):
        sinks.journalled(spark, path, "r2", {"a": lambda: 1 / 0})
    assert {(r["run_id"], r["step"]): r["status"] for r in spark.read.parquet(path).collect()}["r2", "a"] == "failed"


def test_files(spark, tmp_path):
    import zipfile

    (tmp_path / "a.csv").write_text("﻿code;nom\n01;Ain\n2A;Corse\n", encoding="utf-8")
    df = files.delimited(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in df.collect()] == [("01", "Ain"), ("2A", "Corse")]
    with pytest.raises(ValueError, match="missing columns: x"):
        files.required(df, ["x"])
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("data.csv", "GEO;OBS\n01;5\n")
        z.writestr("metadata.csv", "a;b\n" + "1;2\n" * 99)
    got = files.archived(spark, str(tmp_path / "z.zip")).first()
    assert (got["GEO"], got["OBS"]) == ("01", "5")
    assert files.distinct_names(["Année", "x", "x"]) == ["annee", "x", "x_1"]
    xml = spark.createDataFrame([('<M><DataSet><Series><Obs TIME_PERIOD="2024-01" OBS_VALUE="100"/><Obs TIME_PERIOD="2024" OBS_VALUE="9"/></Series></DataSet></M>',)], "x string")
    assert [tuple(r) for r in files.monthly_index(xml, "x").collect()] == [("2024-01", 100.0)]


def test_pages(spark):
    from territoria.sources.pages import chosen_file, links

    html = '<a href="/f/dossier-2023.csv#x">a</a><a href="/f/dossier-2023.csv">b</a><a href="https://o.org/z.ZIP">c</a>'
    got = links(spark.createDataFrame([(1, "https://e.org/p?x=1", html)], "page_id long, url string, html string"))
    assert {(r["absolute"], r["extension"], r["year"]) for r in got.collect()} == {("https://e.org/f/dossier-2023.csv", "csv", 2023), ("https://o.org/z.ZIP", "zip", None)}
    assert chosen_file(got, 2023, 2026).first()["href"] == "/f/dossier-2023.csv#x"
    assert chosen_file(got, 2024, 2026).isEmpty()


def test_stream(spark, tmp_path):
    from territoria.streaming.ingest import events, written_once

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    rows.write.parquet(f"{tmp_path}/in")
    for n in range(2):
        written_once(events(spark, f"{tmp_path}/in", "k int, v string"), f"{tmp_path}/out", ["k"], f"{tmp_path}/c{n}").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
