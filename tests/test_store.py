"""Sinks, sources, reports and frames of any layout on small fixtures."""

import zipfile

import pytest
from pyspark.sql import functions as F

from territoria import serving, sinks
from territoria.functions import dates
from territoria.operators import reshape, roles
from territoria.plans import harmonise, reports, tables
from territoria.sources import files


def test_scores_replace_scores_and_their_parts(spark, tmp_path):
    score = lambda rows: spark.createDataFrame(rows, "code string, score double")
    part = lambda rows: spark.createDataFrame(rows, "code string, indicator string, c double")
    at = str(tmp_path / "s")
    assert sinks.scores_replaced(score([("01", 1.0), ("02", 2.0)]), part([("01", "a", 1.0), ("01", "b", 1.0), ("02", "a", 1.0)]), at, ["code"]) == 1
    assert sinks.scores_replaced(score([("01", 9.0)]), part([("01", "a", 5.0)]), at, ["code"]) == 2
    assert sorted(sinks.current(spark, at, "scores").collect()) == [("01", 9.0), ("02", 2.0)]
    assert sorted(sinks.current(spark, at, "details").collect()) == [("01", "a", 5.0), ("02", "a", 1.0)]


def test_migrations_run_once(spark, tmp_path):
    ran = []
    steps = [("1", "first", lambda s: ran.append(1)), ("2", "second", lambda s: ran.append(2))]
    at = str(tmp_path / "m")
    assert sinks.migrated(spark, at, steps[:1]) == {"applied": ["1"], "already_applied": []}
    assert sinks.migrated(spark, at, steps) == {"applied": ["2"], "already_applied": ["1"]} and ran == [1, 2]
    bad = [*steps, ("3", "third", lambda s: 1 / 0)]
    with pytest.raises(ZeroDivisionError):
        sinks.migrated(spark, at, bad)
    assert sinks.migrated(spark, at, steps)["already_applied"] == ["1", "2"]


def test_one_score_rewrites_one_bucket(spark, tmp_path):
    at, n = str(tmp_path / "s"), 400
    score = lambda rows: spark.createDataFrame(rows, "code string, score double")
    part = lambda rows: spark.createDataFrame(rows, "code string, indicator string, c double")
    sinks.scores_replaced(score([(str(k), 1.0) for k in range(n)]), part([(str(k), "a", 1.0) for k in range(n)]), at, ["code"], 16)
    sinks.scores_replaced(score([("7", 2.0)]), part([]), at, ["code"], 16)
    for name in ("scores", "details"):
        assert len(list((tmp_path / "s" / name / "1").glob("bucket=*"))) == 16 and len(list((tmp_path / "s" / name / "2").glob("bucket=*"))) == 1
    scores, details = sinks.current(spark, at, "scores"), sinks.current(spark, at, "details")
    assert scores.count() == n and [r["score"] for r in scores.where("code = '7'").collect()] == [2.0] and scores.where("score = 1").count() == n - 1
    assert details.count() == n - 1 and details.where("code = '7'").isEmpty()
    sinks.scores_replaced(score([("new", 3.0)]), part([("new", "b", 1.0)]), at, ["code"], 16)
    assert sinks.current(spark, at, "scores").count() == n + 1 and sinks.current(spark, at, "details").count() == n
    with pytest.raises(LookupError):
        sinks.current(spark, str(tmp_path / "none"), "scores")


def test_one_writer_at_a_time(spark, tmp_path):
    at, rows = str(tmp_path / "t"), spark.createDataFrame([(1, "a")], "k int, v string")
    with sinks.only_writer(spark, at, "first"), pytest.raises(RuntimeError, match="another writer, first"):
        sinks.insert_if_absent(rows, at, ["k"])
    assert sinks.insert_if_absent(rows, at, ["k"]) == {"inserted": 1, "unchanged": 0} and sinks.insert_if_absent(rows, at, ["k"])["unchanged"] == 1


def test_a_dead_writer_and_a_late_one(spark, tmp_path):
    """Who dies stops others until its lease expires; who comes back after that can't commit."""
    at, rows = str(tmp_path / "t"), spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    dead = sinks.Lease(spark, at, "dead", 3600)
    with pytest.raises(RuntimeError, match="dead"):
        sinks.insert_if_absent(rows, at, ["k"])
    dead.end()
    late = sinks.Lease(spark, at, "late", 0)
    assert sinks.insert_if_absent(rows.where("k = 1"), at, ["k"])["inserted"] == 1
    rows.write.parquet(f"{at}.staged/late")
    with pytest.raises(RuntimeError, match="expired"):
        late.moved(f"{at}.staged/late", at)
    late.end()  # changes nothing: the lease isn't its own
    assert sinks.insert_if_absent(rows, at, ["k"]) == {"inserted": 1, "unchanged": 1}
    assert sorted(tuple(r) for r in spark.read.parquet(at).collect()) == [(1, "a"), (2, "b")]
    ran = []
    late = sinks.Lease(spark, str(tmp_path / "m"), "late", 0)
    steps = [("1", "first", lambda s: ran.append(1))]
    assert sinks.migrated(spark, str(tmp_path / "m"), steps)["applied"] == ["1"] and ran == [1]
    with pytest.raises(RuntimeError):
        late.check()
    for _ in range(12):
        with sinks.only_writer(spark, at):
            pass
    assert len(list(tmp_path.glob("t.leases/*[0-9]"))) <= 3


def test_refresh_and_exchange(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, None)], "k int, v array<string>")
    for _ in range(2):
        sinks.refreshed(df, str(tmp_path / "r"), ["k"])
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2
    sinks.exchanged(df, str(tmp_path / "c"))
    assert sorted(r["v"] or "" for r in files.delimited(spark, str(tmp_path / "c"), ";").collect()) == ["", '["a","b"]']


def test_members_of_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.csv", "GEO;OBS\n01;5\n02;\"x\ny\"\n")
        z.writestr("two.csv", "﻿GEO;NOTE\n03;n\n")
        z.writestr("metadata.csv", "a;b\n1;2\n")
        z.writestr("note.txt", "GEO;OBS\n")
    got = sorted((r["member"], r["GEO"], r["OBS"], r["NOTE"]) for r in files.archived(spark, str(tmp_path / "a.zip"), every=True).collect())
    assert got == [("one.csv", "01", "5", None), ("one.csv", "02", "x\ny", None), ("two.csv", "03", None, "n")]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("note.txt", "nothing")
    assert files.archived(spark, str(tmp_path / "b.zip")).count() == 0


def test_profile_and_discovery(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "surendettement_2024.csv").write_text("departement;dossiers\n01;5\n02;6\n")
    (tmp_path / "p" / "odd.csv").write_text("hello\n")
    (tmp_path / "p" / "empty.csv").write_text("")
    got = {r["source_file"]: r for r in files.profiled(spark, str(tmp_path / "p"), ["surendettement", "departement", "income"]).collect()}
    full = got["surendettement_2024.csv"]
    assert (full["rows"], full["columns"], full["mentions_surendettement"], full["mentions_departement"], full["mentions_income"], full["error"]) == (2, "departement;dossiers", True, True, False, None)
    assert (got["odd.csv"]["rows"], got["odd.csv"]["error"]) == (0, "no separator") and (got["empty.csv"]["rows"], got["empty.csv"]["columns"], got["empty.csv"]["error"]) == (0, None, "empty")
    found = files.discovered(spark, str(tmp_path / "p"), "*.csv", ["surendettement"]).collect()
    assert len(found) == 1 and len(found[0]["sha256"]) == 64


def test_roles_of_columns():
    columns = ["annee", "code_dep", "valeur_totale"]
    assert roles.found_column(columns, ["Année", "year"]) == "annee" and roles.found_column(columns, ["valeur"]) is None
    assert roles.found_column(columns, ["valeur"], partly=True) == "valeur_totale" and roles.found_column(columns, ["x"], partly=True) is None
    assert roles.first_present(columns, "macro_value", "valeur_totale", "annee") == "valeur_totale" and roles.first_present(columns, "z") is None


def test_a_wide_frame(spark):
    wide = spark.createDataFrame([(2023, "01", "1 000", 5, None), (2024, "02", "12", 6, None)], "`Année` int, `Département` string, dossiers_deposes string, dossiers_recevables int, vide string")
    got = sorted((r["departement"], r["year"], r["indicator_name"], r["value"]) for r in roles.normalised(wide, "x.csv").collect())
    assert got == [("01", 2023, "dossiers_deposes", 1000.0), ("01", 2023, "dossiers_recevables", 5.0), ("02", 2024, "dossiers_deposes", 12.0), ("02", 2024, "dossiers_recevables", 6.0)]
    assert roles.normalised(wide.limit(0), "x.csv").count() == 0
    assert roles.standardised(wide, 2024, "s") is None


def test_lines_of_a_statement(spark):
    three = "1,5 2,0 1 234,5"
    lines = ["Régions", "Nouvelle-Aquitaine " + three, "16 Charente " + three, "17 Charente", "Maritime " + three, "Corse", three, "2a Corse-du-Sud " + three, "99 too few 1,0", "", "Total " + three]
    df = spark.createDataFrame([("p", k, x) for k, x in enumerate(lines)] + [("q", 0, "03 Allier " + three)], "page string, line_no int, line string")
    got = tables.statement_rows(df, ["page"], ["Nouvelle-Aquitaine", "Corse"], ["a", "b", "c"]).where("indicator_name = 'c'").collect()
    assert sorted((r["page"], r["region"] or "", r["departement_code"], r["departement_name"], r["value"]) for r in got) == [
        ("p", "Corse", "2A", "Corse-du-Sud", 1234.5), ("p", "Nouvelle-Aquitaine", "16", "Charente", 1234.5), ("p", "Nouvelle-Aquitaine", "17", "Charente Maritime", 1234.5), ("q", "", "03", "Allier", 1234.5)]


def test_incomplete_context_is_an_error(spark):
    known = spark.createDataFrame([("01", "Ain"), ("02", "Aisne")], "code string, name string")
    rows = spark.createDataFrame([(2023, "01", 5.0, 6.0)], "year int, code string, taux_chomage double, taux_pauvrete double")
    history = spark.createDataFrame([], "code string, period string, id long, indicator string, value double")
    with pytest.raises(Exception, match="incomplete context: 2023"):
        harmonise.harmonised(known, rows, history, spark.createDataFrame([], "key string"), [2023]).collect()


def test_dates_of_texts(spark):
    row = spark.createDataFrame([("Publié le 3 mai 2025. Situation à fin décembre 2025", "Mise en ligne le 5 août 2024", "https://x/a-fevrier-2024/", "PDF 1,5 Mo")], "a string, b string, c string, d string")
    got = row.select(dates.statement_period(F.col("a"), F.lit("x")), dates.iso_date(F.col("b"), "mise en ligne"), dates.period_of_slug(F.col("c")), dates.announced_size(F.col("d")), dates.announced_bytes(F.col("d")), dates.percent(F.lit(12.34)), dates.signed(F.lit(-1.25), 2)).first()
    assert tuple(got) == ("2025-12", "2024-08-05", "2024-02", "1,5 Mo", 1572864, "12.3 %", "-1.25")


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1.25, None), ("c", 2.0, 3)], "name string, x double, n int")
    text = reports.document("Report", {"Figures": reports.markdown(df.orderBy("name")), "Points": ["one"], "None": []})
    assert text == "# Report\n\n## Figures\n\n| name | x | n |\n| --- | --- | --- |\n| a\\|b | 1.2 | - |\n| c | 2.0 | 3 |\n\n## Points\n\n- one\n\n## None\n\n- none\n"
    reports.written(spark, text, str(tmp_path / "r"))
    assert "# Report" in "".join(p.read_text() for p in (tmp_path / "r").glob("part*"))
    with pytest.raises(ValueError, match="at most"):
        reports.markdown(spark.range(1001))


def test_a_matrix_has_one_row_a_cell(spark):
    rows = spark.createDataFrame([("r", "a", 1.0), ("r", "b", 2.0)], "region string, name string, v double")
    assert reshape.matrix(rows, ["region"], "name", "v", ["a", "b", "c"]).collect() == [("r", 1.0, 2.0, None)]
    with pytest.raises(Exception, match="several rows"):
        reshape.matrix(rows.union(rows), ["region"], "name", "v", ["a", "b"]).collect()


def test_serving_checks_what_is_asked(spark):
    df = spark.createDataFrame([("01", "a", "2024-01", 1.0)], "department_code string, indicator_code string, reference_period string, value double")
    assert serving.facts({"deposits": df}, "deposits", "01").first()["time"] == "2024-01"
    with pytest.raises(ValueError, match="kinds are"):
        serving.facts({}, "other")
    with pytest.raises(serving.Conflict):
        serving.facts({}, "macro")
    with pytest.raises(ValueError, match="limit"):
        serving.facts({"deposits": df}, "deposits", limit=5001)
    df.createOrReplaceTempView("some_view")
    assert ("some_view", "view") in {tuple(r) for r in serving.tables(spark).collect()}


def test_small_helpers(spark, tmp_path):
    from territoria.functions.text import contains_any, file_slug
    from territoria.operators import aggregates, windows
    from territoria.plans import imports

    assert file_slug("Dépôts-Régions 2024.PDF") == "d_p_ts_r_gions_2024_pdf"
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, version int, v string")
    assert sorted(windows.latest_wins(df, ["k"], "version").collect()) == [("a", 2, "y"), ("b", 1, None)]
    assert [r[0] for r in df.select(contains_any(F.col("v"), ["x", "z"])).collect()] == [True, False, False]
    assert sorted(aggregates.missing_by(df.select("k", "version"), "k", spark.createDataFrame([(1,), (2,)], "version int")).collect()) == [("b", 2)]
    files.nested_lines(reshape.nested(df, ["k"], ["version"], ["v"]), str(tmp_path / "j"))
    assert {r["k"]: len(r["details"]) for r in spark.read.json(str(tmp_path / "j")).collect()} == {"a": 2, "b": 1}
    xml = spark.createDataFrame([('<D><Cell code="01" v="5"/><Cell code="02" v="6"/></D>',)], "x string")
    assert [tuple(r) for r in files.xml_cells(xml, "x", "_code string, _v string", "Cell").collect()] == [("01", "5"), ("02", "6")]
    income = spark.createDataFrame([("01", "DEP", "MED_SL", "F", 2020, 9.0), ("99", "DEP", "MED_SL", "F", 2020, 9.0)], "GEO string, GEO_OBJECT string, FILOSOFI_MEASURE string, CONF_STATUS string, TIME_PERIOD int, OBS_VALUE double")
    months = spark.createDataFrame([("2019-12",), ("2020-01",), ("2021",)], "period string")
    assert sorted(r["period"] for r in imports.income(income, spark.createDataFrame([("01",)], "GEO string"), months).collect()) == ["2020-01", "2021"]


def test_the_store(spark, tmp_path):
    from territoria.plans import star

    deps = spark.createDataFrame([("75", "Paris", "11")], "department_code string, department_name string, region_code string")
    deposits = spark.createDataFrame([("2025-08", "75", "total", "TOTAL", 568.6), ("2025-08", "99", "total", "TOTAL", 1.0)], "reference_period string, department_code string, indicator_code string, indicator_name string, value double")
    annual = lambda code: spark.createDataFrame([(2022, "75", code, None, 2.0), (2022, "75", code, None, None)], "reference_year int, department_code string, indicator_code string, indicator_name string, value double")
    tables_ = star.store(deposits, annual("P22_POP"), annual("dossiers"), deps, spark.createDataFrame([("P22_POP", "Population 2022")], "code string, label string"))
    for name, df in tables_.items():
        sinks.refreshed(df, f"{tmp_path}/{name}")
    read = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in tables_}
    assert {n: df.count() for n, df in read.items()} == {"dim_department": 1, "dim_indicator": 3, "dim_period": 2, "fact_deposits": 1, "fact_macro": 1, "fact_filings": 1}
    assert read["dim_indicator"].where("indicator_key = 'macro:P22_POP'").first()["indicator_name"] == "Population 2022"


def test_windows_of_a_stream(spark, tmp_path):
    from territoria.streaming.ingest import events, windowed

    rows = spark.createDataFrame([("2024-01-01 10:00:00", "a", 1.0), ("2024-01-01 11:00:00", "a", 2.0), ("2024-01-02 10:00:00", "a", 5.0)], "ts string, k string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/in")
    out = windowed(events(spark, f"{tmp_path}/in", "ts timestamp, k string, v double"), "ts", ["k"], "v")
    q = out.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["n"], r["total"]) for r in spark.table("w").collect()) == [(1, 5.0), (2, 3.0)]
