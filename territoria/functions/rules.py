"""Rules that read meaning from names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from territoria.functions.text import match_or_null

#: Name parts of indicators that are means, not sums (fixed values).
MEAN_PARTS = ("tx", "taux", "part", "pct", "moy", "med", "méd")


def aggregation_rule(name: Column) -> Column:
    return F.when(F.lower(name).rlike("|".join(MEAN_PARTS)), "mean").otherwise("sum")


def cascade(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The result of the first rule whose word the text contains."""
    out = F.lit(default)
    for word, result in reversed(rules):
        out = F.when(F.contains(c, F.lit(word)), result).otherwise(out)
    return out


def reference_year(label: Column, code: Column) -> Column:
    """A four-digit year in the label, else two digits of the code after 2000, else an error."""
    four, two = match_or_null(label, r"\b((?:19|20)\d{2})\b"), match_or_null(code, r"(\d{2})")
    return F.coalesce(four.cast("int"), F.concat(F.lit("20"), two).cast("int"), F.raise_error(F.lit("no year")).cast("int"))
