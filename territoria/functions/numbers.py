"""Number parsers, guarded arithmetic and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from territoria.reference_data import BANDS

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def parsed(c: Column) -> Column:
    """A plain number or null; suffixes that Java reads, such as 12d, aren't numbers."""
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def parsed_loose(c: Column) -> Column:
    """Digits, points and signs of a text as one number: `12 dossiers` is 12."""
    return parsed(F.regexp_replace(F.replace(F.regexp_replace(c, "[  ]", ""), F.lit(","), F.lit(".")), r"[^0-9.\-]", ""))


def parsed_french(c: Column) -> Column:
    """French figures: spaces and percent signs go, a comma is the point, brackets mean minus; missing marks are null."""
    t = F.lower(F.trim(F.replace(c, F.lit(" "), F.lit(" "))))
    t = F.when(t.isin("n.d.", "nd", "n.s.", "ns", "-", ""), None).otherwise(t)
    t = F.regexp_replace(t, r"^\((.*)\)$", "-$1")
    return parsed(F.replace(F.regexp_replace(t, r"[\s% ]", ""), F.lit(","), F.lit(".")))


def finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def ratio(top: Column, bottom: Column, factor: float = 100.0) -> Column:
    """factor * top / bottom, null for a zero below."""
    return F.lit(float(factor)) * top / F.nullif(bottom, F.lit(0).cast("double"))


def guarded_ratio(top: Column, bottom: Column, factor: float) -> Column:
    """Null unless both are finite and the lower one positive."""
    return F.when(finite(top) & finite(bottom) & (bottom > 0), top / bottom * float(factor))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's correlation of the pairs without nulls; null where a column is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def average_rank(value: str, *by: str, descending: bool = False) -> Column:
    """Ranks from 1, the mean of the places for ties."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    return F.rank().over(Window.partitionBy(*by).orderBy(order)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / F.lit(2).cast("double")


def scaled(v: Column, lo: Column, hi: Column, direction: Column) -> Column:
    """Min-max to [0, 1], turned round for a negative direction; 0.5 where both bounds are equal."""
    part = F.least(F.greatest((v - lo) / F.nullif(hi - lo, F.lit(0).cast("double")), F.lit(0.0)), F.lit(1.0))
    return F.when(lo == hi, 0.5).when(direction == "negative", 1 - part).otherwise(part)


def band(score: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, lo, hi in reversed(BANDS):
        out = F.when((score >= lo) & (score < hi), name).otherwise(out)
    return out


def zscore(value: str, over: WindowSpec) -> Column:
    return (F.col(value) - F.avg(value).over(over)) / F.nullif(F.stddev_samp(value).over(over), F.lit(0).cast("double"))
