"""Periods as strings, YYYY or YYYY-MM, whose order is lexicographic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from territoria.functions.text import folded, match_or_null
from territoria.reference_data import MONTHS


def first_year(c: Column) -> Column:
    return match_or_null(c, r"((?:19|20)\d{2})").cast("int")


def last_year(c: Column) -> Column:
    """The largest year from 2000 on in a text."""
    return F.array_max(F.transform(F.regexp_extract_all(c, F.lit(r"(20\d{2})"), 1), lambda x: x.cast("int")))


def period_of_file(c: Column) -> Column:
    year, month = match_or_null(c, r"(20\d{2})(0[1-9]|1[0-2])", 1), match_or_null(c, r"(20\d{2})(0[1-9]|1[0-2])", 2)
    return F.when(year.isNotNull(), F.concat(year, F.lit("-"), month))


def month_number(c: Column) -> Column:
    """A French month's number, with or without accents, or the number itself."""
    names = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))
    t = F.trim(folded(F.lower(c)))
    return F.coalesce(F.when(t.rlike(r"^\d{1,2}$"), t.try_cast("int")), F.element_at(names, t))


def period_key(year: Column, month: Column) -> Column:
    return F.when(year.isNotNull() & month.isNotNull(), F.format_string("%04d-%02d", year.cast("int"), month.cast("int")))


def year_of(period: Column) -> Column:
    return F.substring(period, 1, 4).cast("int")


def month_of(period: Column) -> Column:
    return F.when(F.length(period) == 7, F.substring(period, 6, 2).cast("int"))


def granularity(period: Column) -> Column:
    return F.when(F.length(period) == 7, "month").otherwise("year")


def year_before(period: Column) -> Column:
    return F.concat((year_of(period) - 1).cast("string"), F.substring(period, 5, 3))


def months_between(first: Column, last: Column) -> Column:
    """All months from first to last, both included."""
    day = lambda c: F.to_date(F.concat(c, F.lit("-01")))
    return F.when(first > last, F.raise_error(F.lit("months run backwards")).cast("array<string>")).otherwise(F.transform(F.sequence(day(first), day(last), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM")))


def month_index(period: Column) -> Column:
    return year_of(period) * 12 + month_of(period)
