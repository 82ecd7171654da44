"""Literals of the functions' contracts."""

import pytest
from pyspark.sql import functions as F

from territoria.functions import numbers, periods, rules, text
from territoria.functions.keys import idempotence_key


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize("value, wanted", [("1 234,5 %", 1234.5), ("(12,3)", -12.3), ("n.d.", None), ("-", None), ("0", 0.0), ("abc", None)])
def test_french_numbers(spark, value, wanted):
    assert one(spark, numbers.parsed_french, value) == wanted


@pytest.mark.parametrize("value, wanted", [("12d", None), ("12", 12.0), (" 3.5 ", 3.5), ("1e3", 1000.0), ("", None)])
def test_plain_numbers(spark, value, wanted):
    assert one(spark, numbers.parsed, value) == wanted


def test_loose_number(spark):
    assert one(spark, numbers.parsed_loose, "12 dossiers") == 12.0


@pytest.mark.parametrize("value, wanted", [("2a", "2A"), ("1", "01"), ("971", None), ("Nom sans code", None)])
def test_strict_codes(spark, value, wanted):
    assert one(spark, text.code_strict, value) == wanted


def test_long_codes_keep_their_digits(spark):
    assert one(spark, text.code_upper, "971") == "971"


@pytest.mark.parametrize("value, wanted", [("février", 2), ("Août", 8), ("12", 12), ("nope", None)])
def test_months(spark, value, wanted):
    assert one(spark, periods.month_number, value) == wanted


def test_names():
    assert text.column_name(" Année ") == "ann_e"
    assert text.column_name(" Année ", fold=True) == "annee"


def test_unknown_level(spark):
    assert one(spark, text.level, "Département") == "department"
    with pytest.raises(Exception, match="unknown level"):
        one(spark, text.level, "galaxy")


@pytest.mark.parametrize("v, lo, hi, direction, wanted", [(15, 10, 20, "positive", 0.5), (15, 10, 20, "negative", 0.5), (5, 5, 5, "negative", 0.5), (-1, 0, 10, "positive", 0.0), (99, 0, 10, "positive", 1.0), (99, 0, 10, "negative", 0.0)])
def test_scaled(spark, v, lo, hi, direction, wanted):
    row = spark.createDataFrame([(float(v), float(lo), float(hi), direction)], "v double, lo double, hi double, d string")
    assert row.select(numbers.scaled(F.col("v"), F.col("lo"), F.col("hi"), F.col("d")).alias("x")).first()["x"] == wanted


@pytest.mark.parametrize("score, wanted", [(0.0, "very_low"), (70.0, "high"), (100.0, "very_high"), (None, None)])
def test_bands(spark, score, wanted):
    assert one(spark, numbers.band, score, "double") == wanted


def test_percentile_interpolates(spark):
    rows = spark.createDataFrame([(float(x),) for x in (0, 10, 20, 30, 1000)], "v double")
    r = rows.agg(F.percentile("v", 0.05).alias("a"), F.percentile("v", 0.95).alias("b")).first()
    assert (round(r["a"], 9), round(r["b"], 9)) == (2.0, 806.0)


def test_constant_columns_have_no_correlation(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert rows.agg(numbers.correlation(F.col("x"), F.col("y")).alias("r")).first()["r"] is None


def test_keys_keep_null_places(spark):
    rows = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    assert rows.select(idempotence_key(F.col("x"), F.col("y"), F.col("z")).alias("k")).distinct().count() == 2


def test_rules(spark):
    assert one(spark, rules.aggregation_rule, "TX_CHOM") == "mean"
    assert one(spark, rules.aggregation_rule, "P20_POP") == "sum"


def test_months_between(spark):
    row = spark.createDataFrame([("2025-11", "2026-02")], "a string, b string")
    assert row.select(periods.months_between(F.col("a"), F.col("b")).alias("m")).first()["m"] == ["2025-11", "2025-12", "2026-01", "2026-02"]
    with pytest.raises(Exception, match="backwards"):
        row.select(periods.months_between(F.col("b"), F.col("a")).alias("m")).collect()
