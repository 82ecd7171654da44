"""Tables from placed words, documents of cells, gates, imports and migrations on small fixtures."""

import pytest
from pyspark.sql import functions as F

from territoria import sinks
from territoria.operators import aggregates, joins, roles
from territoria.plans import conformed, gates, imports, layout, tables
from territoria.sources import files

WORDS = "page int, x0 double, x1 double, top double, bottom double, text string"


def words(spark, rows):
    """Words (page, x, y, text): five points a letter, ten high."""
    return spark.createDataFrame([(p, float(x), float(x + 5 * len(t)), float(y), float(y + 10), t) for p, x, y, t in rows], WORDS)


def grid(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["page"], r["table_no"]), {})[r["row_no"]] = list(r["cells"])
    return {k: [v[n] for n in sorted(v)] for k, v in out.items()}


NO_RULES = "page int, x0 double, x1 double, top double, bottom double"


def test_tables_by_text(spark):
    rows = [(1, 20, 10, "Situation"), (1, 70, 10, "des"), (1, 90, 10, "comptes")]  # a line, no table
    rows += [(1, 100, 100, "Heading"), (1, 140, 100, "over"), (1, 165, 100, "two")]
    for k, (name, a, b) in enumerate([("Ain", "10", "7"), ("Aisne", "200", ""), ("Hautes Alpes", "3", "9"), ("Var", "1", "2"), ("Nord", "5", "6")]):
        for j, w in enumerate(name.split()):
            rows.append((1, 10 + j * 35, 114 + 14 * k + k % 3, w))
        rows += [(1, 120 - 5 * len(a), 114 + 14 * k, a)] + ([(1, 180 - 5 * len(b), 115 + 14 * k, b)] if b else [])
    rows += [(1, 10, 300, "x"), (1, 60, 300, "1"), (1, 10, 314, "y"), (1, 60, 314, "2")] + [(2, 10, 10, "alone")]
    got = grid(layout.rebuilt(words(spark, rows), spark.createDataFrame([], NO_RULES), ["page"], "text", "text"))
    big = got.pop((1, 1))
    assert [x[0] for x in big[1:]] == ["Ain", "Aisne", "Hautes Alpes", "Var", "Nord"]
    assert [x[1:] for x in big[1:]] == [["10", "7"], ["200", None], ["3", "9"], ["1", "2"], ["5", "6"]]
    assert " ".join(x for x in big[0] if x) == "Heading over two"
    assert list(got.values()) == [[["x", "1"], ["y", "2"]]]


def test_tables_by_rules(spark):
    inside = [(1, 12, 12, "a"), (1, 52, 12, "b"), (1, 58, 14, "c"), (1, 12, 42, "d"), (1, 500, 12, "outside"), (1, 12, 200, "below")]
    upright = [(1, x, x + 0.5, 5.0, 65.0) for x in (10.0, 50.0, 51.5, 90.0)]  # two of them are one rule, drawn twice
    flat = [(1, 10.0, 90.0, y, y) for y in (5.0, 35.0, 65.0)]
    rules = spark.createDataFrame(upright + flat, NO_RULES)
    assert grid(layout.rebuilt(words(spark, inside), rules, ["page"])) == {(1, 0): [["a", "b c"], ["d", None]]}
    half = spark.createDataFrame(upright, NO_RULES)
    assert grid(layout.rebuilt(words(spark, inside), half, ["page"])) == {}
    assert grid(layout.rebuilt(words(spark, inside), half, ["page"], "lines", "text")) == {(1, 0): [["a", "b c"], ["d", None]]}
    first = tables.first_tables(layout.page_tables(words(spark, inside), half, ["page"]), ["page"])
    assert {r["strategy"] for r in first.collect()} == {"1 lines text"}


def test_tables_of_pages_whose_files_have_changed(spark, tmp_path):
    """Another program puts other files at the same path: the next reading of the pages has what is there then. Words and
    rules are made once for all strategies."""
    at, made = str(tmp_path / "words.parquet"), spark.sparkContext.accumulator(0)
    upright = [(1, x, x + 0.5, 5.0, 65.0) for x in (10.0, 50.0, 90.0)]

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    def read(text):
        words(spark, [(1, 12, 12, text), (1, 52, 12, "b"), (1, 12, 42, "c"), (1, 52, 42, "d")]).toPandas().astype({"page": "int32"}).to_parquet(at)
        rules = spark.read.schema(NO_RULES).parquet(str(tmp_path / "rules.parquet"))
        return grid(tables.first_tables(layout.page_tables(spark.read.schema(WORDS).parquet(at), rules, ["page"]), ["page"]))

    spark.createDataFrame(upright, NO_RULES).toPandas().astype({"page": "int32"}).to_parquet(tmp_path / "rules.parquet")
    assert [read(x) for x in ("old", "new")] == [{(1, 0): [[x, "b"], ["c", "d"]]} for x in ("old", "new")]
    pages, rules = spark.read.parquet(at).mapInArrow(counted, WORDS), spark.read.parquet(str(tmp_path / "rules.parquet"))
    assert layout.page_tables(pages, rules, ["page"]).count() == 4 and made.value == 4


def test_department_codes(spark):
    line = lambda t: spark.createDataFrame([(1, 0, t)], "page int, line_no int, line string")
    read = lambda t: [(r["departement_code"], r["departement_name"], r["value"]) for r in tables.statement_rows(line(t), ["page"], [], ["v"]).collect()]
    assert read("971 Guadeloupe 1,5") == [("971", "Guadeloupe", 1.5)] and read("2A-Corse 1.5") == [("2A", "Corse", 1.5)] and read("2b – Haute-Corse 1 234,5") == [("2B", "Haute-Corse", 1234.5)]
    assert read("01 Ain 2.0") == [("01", "Ain", 2.0)] and read("100 km 2,0") == [] == read("75") == read("12345 Total 1,0") == read("75Paris 1,0")


def test_figures_beside_names_that_end_in_digits(spark):
    lines = ["01 NATION_1 420,0 1 000,5", "02 – NATION_12 100.0 200.0", "03-Lot-3 123,0 -1 234,5", "04 Var 4 123,0 -5,0"]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "page int, line_no int, line string")
    got = sorted((r["departement_code"], r["departement_name"], r["indicator_name"], r["value"]) for r in tables.statement_rows(df, ["page"], [], ["a", "b"]).collect())
    assert got == [("01", "NATION_1", "a", 420.0), ("01", "NATION_1", "b", 1000.5), ("02", "NATION_12", "a", 100.0), ("02", "NATION_12", "b", 200.0), ("03", "Lot-3", "a", 123.0), ("03", "Lot-3", "b", -1234.5), ("04", "Var", "a", 4123.0), ("04", "Var", "b", -5.0)]


def test_wide_tables_count_all_their_numbers(spark):
    n = 1200
    cells = ["01 Ain", *[None] * (n - 4), "1", "2", "3"]
    rows = spark.createDataFrame([(1, 0, ["", *[f"c{k}" for k in range(1, n)]]), (1, 1, cells)], "page int, row_no int, cells array<string>")
    got = tables.table_rows(rows, ["page"]).collect()
    assert sorted((r["indicator_name"], r["value"]) for r in got) == [(f"c{n - 3}", 1.0), (f"c{n - 2}", 2.0), (f"c{n - 1}", 3.0)]


@pytest.mark.parametrize("place,indicator,value", [("Territoire", "Libellé", "Nb"), ("Région", "Catégorie", "Taux"), ("Département", "Indicateur", "Nombre"), ("departement", "variable", "Montant")])
def test_every_alias_names_its_role(spark, place, indicator, value):
    df = spark.createDataFrame([("x", "Ain", "filed", "7", "2020")], f"`Code` string, `{place}` string, `{indicator}` string, `{value}` string, `Exercice` string")
    assert [tuple(r) for r in roles.normalised(df, "f.csv").collect()] == [("Ain", 2020, "filed", 7.0, "f.csv")]


def test_local_data_without_what_may_be_lacking(spark):
    docs = [("u1", "<D><Cellule><Valeur>1,5</Valeur></Cellule><Cellule><Zone codgeo='75'/><Valeur>2</Valeur><Modalite code='1' variable='A'/></Cellule></D>"), ("u2", "<D></D>"), ("u3", "no xml"), ("u4", None), ("u5", "<D><Variable code='A'><Libelle>é</Libelle></Variable><Cellule><Modalite variable='A'/></Cellule></D>")]
    got = sorted(files.local_data(spark.createDataFrame(docs, "url string, xml string"), "xml", "url").collect(), key=str)
    assert [(r["source_url"], r["departement_code"], r["value"]) for r in got] == [("u1", "75", 2.0), ("u1", None, None), ("u5", None, None)] or [(r["source_url"], r["departement_code"], r["value"]) for r in got] == [("u1", None, None), ("u1", "75", 2.0), ("u5", None, None)]
    of = {(r["source_url"], r["departement_code"]): r["modalities_json"] for r in got}
    assert of["u1", None] == "[]" and of["u1", "75"] == '[{"variable_code":"A","variable_label":null,"modality_code":"1","modality_label":null}]' and '"variable_label":"é","modality_code":null' in of["u5", None]


def test_a_common_word_makes_no_pairs(spark):
    n = 3000
    rows = [(f"n{k:05d}", ["all", "every" if k % 2 else "odd", f"own{k // 3}"]) for k in range(n)]
    sets, cands = spark.createDataFrame(rows[:500], "name string, w array<string>"), spark.createDataFrame(rows, "cand string, cw array<string>")
    pairs = joins.candidate_pairs(sets, cands, 3, 100)
    assert pairs.count() < 500 * 12  # the three of a word of their own, and three of each of two kinds
    got = {}
    for r in joins.best_matches(sets, cands, 3, 100).collect():
        got.setdefault(r["name"], {})[r["place"]] = (r["cand"], r["overlap"])
    for name, w in rows[:500:7]:
        wanted = sorted(((-len(set(w) & set(cw)), cand) for cand, cw in rows if set(w) & set(cw)))[:3]
        assert [got[name][k] for k in (1, 2, 3)] == [(c, -o) for o, c in wanted]
    odd = spark.createDataFrame([("x", None), ("y", []), ("z", ["none"])], "name string, w array<string>")
    assert joins.best_matches(odd, cands, 3).count() == 0


def test_no_products_are_planned(spark):
    rows = spark.createDataFrame([(k % 5, 1990 + k % 9, float(k)) for k in range(90)], "code int, year int, v double")
    months = spark.createDataFrame([(f"{y}-{m:02d}",) for y in range(1990, 1996) for m in (1, 7)] + [("1992",), ("abcd",)], "period string")
    out = joins.propagated(rows, months, "year", "period")
    wanted = sorted((r["code"], r["year"], r["v"], p["period"]) for r in rows.collect() for p in months.collect() if p["period"] >= f"{r['year']}-01")
    assert sorted((r["code"], r["year"], r["v"], r["period"]) for r in out.collect()) == wanted
    macro = spark.createDataFrame([(1, 1990, 10.0, 1.0), (1, 1993, 20.0, 4.0), (2, 1993, 8.0, None)], "code int, year int, ACT double, CHOM double")
    rate = imports.unemployment(macro, months.where("period like '199_-__'"), ["code"])
    for df in (out, rate):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert {(r["code"], r["period"], r["snapshot_year"], r["value"]) for r in rate.where("period >= '1992-07' and period < '1993-07'").collect()} == {(1, "1992-07", 1990, 10.0), (1, "1993-01", 1993, 20.0), (2, "1993-01", 1993, 0.0)}


def test_examples_hold_no_more_than_n(spark):
    df = spark.createDataFrame([(k % 2, f"v{k % 40:02d}") for k in range(400)] + [(7, None), (None, "x"), (None, "x")], "k int, v string")
    got = {r["k"]: r["examples"] for r in aggregates.examples(df, ["k"], "v", n=3).collect()}
    assert got == {0: "v00 | v02 | v04", 1: "v01 | v03 | v05", 7: "", None: "x"}


def test_gates(spark, tmp_path):
    rows = spark.createDataFrame([("2023", "a", "01"), ("2023", "a", "02"), ("2024", "a", "01")], "period string, indicator string, code string")
    wanted = spark.createDataFrame([("y23", "error", "2023", "a", 2), ("y24", "error", "2024", "a", 2), ("y25", "error", "2025", "a", 2), ("w", "warning", "2024", "a", 3)], "name string, severity string, period string, indicator string, expected int")
    one = gates.verdict(gates.coverage_checks(rows, wanted)).first()
    assert (one["passed"], one["checks"], one["failed"], one["missing"], one["warnings"]) == (False, 4, ["y24"], ["y25"], ["w"])
    assert gates.passes(gates.coverage_checks(rows, wanted.where("name in ('y23', 'w')"))) and not gates.passes(gates.coverage_checks(rows, wanted.limit(0)))
    none = spark.createDataFrame([], "severity string, name string, n long")
    assert gates.passes(gates.alert_checks(none)) and not gates.passes(gates.alert_checks(spark.createDataFrame([("error", "e", 1), ("warning", "w", 2)], none.schema)))
    ran, at = [], str(tmp_path / "j")
    steps = {"load": lambda: ran.append("load"), "score": lambda: ran.append("score"), "report": lambda: ran.append("report")}
    assert sinks.journalled(spark, at, "r", steps, {"score": lambda: gates.passes(gates.coverage_checks(rows, wanted))}) == "quality_failed"
    assert ran == ["load", "report"] and {(r["step"], r["status"]) for r in spark.read.parquet(at).where("status <> 'running'").collect()} == {("load", "success"), ("score", "skipped"), ("report", "quality_failed")}


def test_imports_run_once(spark):
    rates = spark.createDataFrame([(2024, "01", "Ain", 1.5), (2025, "01", "Ain", 2.5)], "year int, code string, name string, value double")
    months = spark.createDataFrame([("2024-01",), ("2024-02",)], "period string")
    rows = imports.replicated(rates, months, "department-rates-1", "rate", "u")
    first = imports.imported(rows, rows.limit(0))
    assert sorted((r["period"], r["observation_type"], r["status"]) for r in first.collect()) == [("2024-01", "annual_replicated_monthly", "inserted"), ("2024-02", "annual_replicated_monthly", "inserted"), ("2025", "annual", "inserted")]
    again = imports.import_report(imports.imported(rows, first)).first()
    assert (again["departments"], again["inserted"], again["unchanged"]) == (1, 0, 3)
    known = spark.createDataFrame([("01",), ("02",)], "code string")
    with pytest.raises(Exception, match="incomplete: 20"):
        imports.whole_years(rates, known).collect()
    assert imports.whole_years(rates, known.where("code = '01'")).count() == 2


def test_keys_are_migrated_once(spark):
    rows = spark.createDataFrame([("01", "2024", "a", 1.0), ("02", "2024", "a", 2.0)], "code string, period string, indicator string, value double")
    old = conformed.keyed(rows, "mean-debt-1").withColumn("version", F.lit("mean-debt-1"))
    new = conformed.rekeyed(old, "mean-debt-1", "historical-harmonisation-1")
    assert [r["moved"] for r in new.collect()] == [True, True] and sorted(r["key"] for r in new.collect()) == sorted(r["key"] for r in conformed.keyed(rows, "historical-harmonisation-1").collect())
    assert not any(r["moved"] for r in conformed.rekeyed(new.drop("moved"), "mean-debt-1", "historical-harmonisation-1").collect())
    both = old.unionByName(new.drop("moved").where("code = '01'"))  # the new key of one is there already
    assert sorted((r["code"], r["moved"]) for r in conformed.rekeyed(both, "mean-debt-1", "historical-harmonisation-1").collect()) == [("01", False), ("01", False), ("02", True)]
    with pytest.raises(ValueError, match="needs level"):
        conformed.keyed(rows, "bridge-1")
    registry = spark.createDataFrame([("t", "table", "x", "first")], "object_name string, object_type string, replacement string, reason string")
    assert sorted(r["reason"] for r in conformed.deprecated(registry, spark.createDataFrame([("t", "table", "x", "second"), ("v", "view", None, "new")], registry.schema)).collect()) == ["first", "new"]


def test_archives_of_any_headers(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for k in range(150):
            z.writestr(f"m{k}.csv", f"GEO;C{k}\n0{k % 9};{k}\n")
    (tmp_path / "plain.csv").write_text('GEO;NOTE\n01;"a\nb"\n02\n')
    got = files.archived(spark, str(tmp_path / "*"), every=True)
    assert len(got.columns) == 2 + 1 + 150 + 1 and got.count() == 152 and got.where("C7 = '7'").first()["member"] == "m7.csv"
    assert sorted((r["GEO"], r["NOTE"]) for r in got.where("member = 'plain.csv'").collect()) == [("01", "a\nb"), ("02", None)]
    assert files.archived(spark, str(tmp_path / "a.zip"), columns=["GEO", "C3", "none"]).columns == ["path", "member", "GEO", "C3", "none"]
