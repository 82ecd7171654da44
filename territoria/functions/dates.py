"""Dates, sizes and figures as they stand in pages, and as reports print them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from territoria.functions.periods import first_year, month_number, period_key
from territoria.functions.text import folded, match_or_null
from territoria.reference_data import MONTHS

#: Any French month, accents folded; a year; a size as pages announce it (fixed values: the pages' own forms).
MONTH, YEAR = "|".join(MONTHS), r"(?:19|20)\d{2}"
BLANK = r"\s+"
SIZE = r"(\d+(?:[,.]\d+)?)\s*(ko|mo|kb|mb)"


def _month_of_year(between: str) -> str:
    """A month and its year as two groups, with what stands between them."""
    return f"({MONTH}){between}({YEAR})"


def period_of_slug(url: Column) -> Column:
    """The period of an address that ends in -month-year, or null."""
    p = f"(?i)-{_month_of_year('-')}(?:[/?#]|$)"
    return period_key(match_or_null(folded(url), p, 2), month_number(match_or_null(folded(url), p, 1)))


def period_of_title(title: Column) -> Column:
    """The period of a title that ends in ` - month year`, or null."""
    p = rf"(?i)[-–]\s*{_month_of_year(BLANK)}"
    return period_key(match_or_null(folded(title), p, 2), month_number(match_or_null(folded(title), p, 1)))


def publication_period(title: Column, url: Column) -> Column:
    return F.coalesce(period_of_title(title), period_of_slug(url))


def iso_date(text: Column, label: str) -> Column:
    """The ISO date after a label and `le`, as in `mise en ligne le 5 mars 2024`; null where there is none."""
    p = rf"(?i)(?:{label})\s+le\s+(\d{{1,2}})\s+{_month_of_year(BLANK)}"
    t = folded(text)
    month = month_number(match_or_null(t, p, 2))
    return F.when(month.isNotNull(), F.format_string("%s-%02d-%02d", match_or_null(t, p, 3), month, match_or_null(t, p, 1).cast("int")))


def statement_period(text: Column, file_name: Column) -> Column:
    """The period that a statement names (`fin mois année`), before any other month and year of the text or file."""
    t = folded(F.lower(text))
    stated = rf"fin\s+{_month_of_year(BLANK)}"
    month = F.coalesce(match_or_null(t, stated, 1), match_or_null(t, rf"\b({MONTH})\b"))
    year = F.coalesce(match_or_null(t, stated, 2), first_year(F.concat_ws(" ", t, file_name)).cast("string"))
    return F.when(month.isNotNull() & year.isNotNull(), period_key(year, month_number(month)))


def announced_size(text: Column) -> Column:
    """A size with its unit as it stands in a text: `1,5 Mo`."""
    return match_or_null(text, f"(?i)({SIZE})")


def announced_bytes(text: Column) -> Column:
    p = f"(?i){SIZE}"
    unit = F.lower(F.substring(F.coalesce(match_or_null(text, p, 2), F.lit("")), 1, 1))
    return (F.replace(match_or_null(text, p, 1), F.lit(","), F.lit(".")).try_cast("double") * F.when(unit == "k", 1024.0).when(unit == "m", 1024.0 * 1024)).cast("long")


def response_fault(status: Column, mime: Column, content: Column, least: int, most: int) -> Column:
    """The first thing against a response that should be a PDF file, or null: status, type, signature, size."""
    return (
        F.when(~F.coalesce(status.between(200, 299), F.lit(False)), "invalid status")
        .when((F.coalesce(mime, F.lit("")) != "") & ~F.contains(F.lower(mime), F.lit("pdf")), "wrong type")
        .when(~F.startswith(content, F.lit("%PDF-").cast("binary")), "wrong signature")
        .when(F.octet_length(content) < least, "too small")
        .when(F.octet_length(content) > most, "too large")
    )


def signed(value: Column, digits: int = 1) -> Column:
    """+1.5 or -1.5."""
    return F.when(value.isNotNull(), F.format_string(f"%+.{digits}f", value))


def percent(value: Column, digits: int = 1) -> Column:
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f %%", value))
