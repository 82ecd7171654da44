"""Frames of any layout: which column plays which role, and the long form that follows from it. Shares of a whole frame
come from one pass that returns one row."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territoria.functions.numbers import parsed_loose
from territoria.functions.periods import first_year
from territoria.functions.text import column_name

#: Names of columns by role (fixed values), as identifiers; some more that sources of the same kind use follow in each.
YEARS = ("year", "annee", "exercice", "date_annee")
PLACES = ("departement", "region", "territoire", "department", "dep", "code_departement", "departement_name")
INDICATORS = ("indicator_name", "indicator", "indicateur", "libelle", "categorie", "variable", "type")
VALUES = ("value", "valeur", "nombre", "nb", "montant", "taux")
#: Shares from which a column is a number, or is a place: much text, few numbers.
NUMERIC, TEXTUAL, FEW_NUMBERS = 0.6, 0.7, 0.4


@dataclass(frozen=True)
class Shares:
    """Of one column: parts of its rows that are known, that are text, and that are numbers."""

    known: float
    text: float
    number: float


def renamed(df: DataFrame) -> DataFrame:
    """Headers as identifiers, accents folded; the second of a name gets _1, and so on."""
    names, seen = [], {}
    for c in df.columns:
        name = column_name(c, fold=True) or "column"
        seen[name] = seen.get(name, -1) + 1
        names.append(f"{name}_{seen[name]}" if seen[name] else name)
    return df.toDF(*names)


def found_column(columns: list[str], aliases: Iterable[str], partly: bool = False) -> str | None:
    """The first column whose name is one of the aliases; where `partly`, aliases come in their order, and failing an
    equal name the first column whose name holds one will do."""
    wanted = [column_name(a, fold=True) for a in aliases]
    if not partly:
        return next((c for c in columns if c in wanted), None)
    return next((a for a in wanted if a in columns), None) or next((c for c in columns if any(a in c for a in wanted)), None)


def first_present(columns: list[str], *names: str) -> str | None:
    return next((n for n in names if n in columns), None)


def shares(df: DataFrame) -> dict[str, Shares]:
    """The shares of every column, by one job whose result is one row."""
    text = lambda c: F.col(f"`{c}`").cast("string")
    part = lambda flag: F.avg(F.coalesce(flag, F.lit(False)).cast("double"))
    row = df.agg(*(x for k, c in enumerate(df.columns) for x in (
        part(text(c).isNotNull()).alias(f"k{k}"), part(F.trim(text(c)) != "").alias(f"t{k}"), part(parsed_loose(text(c)).isNotNull()).alias(f"n{k}")))).first()
    return {c: Shares(*(row[f"{x}{k}"] or 0.0 for x in "ktn")) for k, c in enumerate(df.columns)}


def told(df: DataFrame) -> DataFrame:
    """(column_name, text, number, is_number, has_numbers, place) of every column of a frame, as a plan: its shares of text
    and of numbers, what follows from them, and whether it is the first that may be a place. One pass; a row a column."""
    cell = lambda c: F.col(f"`{c}`").cast("string")
    part = lambda flag: F.avg(F.coalesce(flag, F.lit(False)).cast("double"))
    one = df.agg(F.array(*(F.struct(F.lit(k).alias("at"), F.lit(c).alias("column_name"), part(F.trim(cell(c)) != "").alias("text"), part(parsed_loose(cell(c)).isNotNull()).alias("number")) for k, c in enumerate(df.columns))).alias("all"))
    may = lambda x: (x["text"] >= TEXTUAL) & (x["number"] <= FEW_NUMBERS)
    rows = one.withColumn("first", F.array_min(F.transform(F.filter("all", may), lambda x: x["at"]))).select("first", F.explode("all").alias("x")).select("first", "x.*")
    return rows.select("column_name", "text", "number", (F.col("number") >= NUMERIC).alias("is_number"), (F.col("number") > 0).alias("has_numbers"), F.coalesce(F.col("at") == F.col("first"), F.lit(False)).alias("place"))


def geography(of: dict[str, Shares], year: str | None) -> str | None:
    return next((c for c, s in of.items() if c != year and s.text >= TEXTUAL and s.number <= FEW_NUMBERS), None)


def numeric_columns(of: dict[str, Shares], least: float = NUMERIC) -> list[str]:
    return [c for c, s in of.items() if s.number >= least]


def value_columns(of: dict[str, Shares], places: Iterable[str]) -> list[str]:
    """Columns that aren't places and hold any number."""
    return [c for c, s in of.items() if c not in set(places) and s.number > 0]


def long_rows(df: DataFrame, of: dict[str, Shares], year: str | None, place: str | None, indicator: str | None, value: str | None) -> DataFrame:
    """(year, departement, indicator_name, value), all text. The value column tells the values, or else the one numeric
    column; several numeric columns become a row each, those that also tell the year or place excepted; without any, the
    first column is read as numbers."""
    text = lambda c: F.col(f"`{c}`").cast("string") if c else F.lit(None).cast("string")
    ids = [text(year).alias("year"), text(place).alias("departement")]
    numbers = numeric_columns(of)
    if not value and len(numbers) != 1:
        several = [c for c in numbers if c not in (year, place)]
        if several:
            wide = df.select(*ids, *(text(c).alias(f"v_{k}") for k, c in enumerate(several)))
            names = F.element_at(F.array(*(F.lit(c) for c in several)), F.substring("k", 3, 9).cast("int") + 1)
            return wide.unpivot(["year", "departement"], [f"v_{k}" for k in range(len(several))], "k", "value").select("year", "departement", names.alias("indicator_name"), "value")
    one = value or (numbers[0] if len(numbers) == 1 else df.columns[0])
    named = text(indicator) if indicator and (value or numbers) else F.lit(one)
    return df.select(*ids, named.alias("indicator_name"), text(one).alias("value"))


def normalised(df: DataFrame, source_file: str, year: int | None = None, region: str | None = None, dataset: str | None = None) -> DataFrame:
    """A frame of any layout as (departement string, year int, indicator_name, value double, source_file), rows without a
    number left out. The year is given or in the file's name only where no row has one; so with the region for places;
    rows without an indicator get the data set's type. An empty frame gives no rows."""
    cleaned = renamed(df)
    of = {c: s for c, s in shares(cleaned).items() if s.known > 0}  # columns without any value go
    cleaned = cleaned.select(*(f"`{c}`" for c in of)) if of else cleaned.limit(0)
    if not of:
        return cleaned.select(F.lit(None).cast("string").alias("departement"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("indicator_name"), F.lit(None).cast("double").alias("value"), F.lit(source_file).alias("source_file"))
    year_column = found_column(list(of), YEARS)
    place = found_column(list(of), PLACES) or geography(of, year_column)
    rows = long_rows(cleaned, of, year_column, place, found_column(list(of), INDICATORS), found_column(list(of), VALUES))
    own_year = year_column is not None and of[year_column].number > 0
    known_year = F.col("year").try_cast("double").cast("int") if own_year else F.lit(year).cast("int") if year else first_year(F.lit(source_file))
    where = F.col("departement") if place or not region else F.lit(region)
    return rows.select(where.alias("departement"), known_year.alias("year"), F.coalesce("indicator_name", F.lit(dataset)).alias("indicator_name"), parsed_loose(F.col("value")).alias("value"), F.lit(source_file).alias("source_file")).where("value is not null")


def standardised(df: DataFrame, year: int, source: str) -> DataFrame | None:
    """(departement, value, variable, year, source) by the last column whose name holds each word; None where a place or a
    value is lacking."""
    last = lambda *words: next((c for c in reversed(df.columns) if any(w in c.upper() for w in words)), None)
    place, value, name = last("DEP"), last("VALEUR", "VALUE"), last("LIB", "TYPE")
    if not place or not value:
        return None
    variable = F.col(f"`{name}`").cast("string") if name else F.lit("unknown")
    return df.select(F.col(f"`{place}`").cast("string").alias("departement"), F.col(f"`{value}`").cast("string").try_cast("double").alias("value"), variable.alias("variable"), F.lit(year).alias("year"), F.lit(source).alias("source"))
