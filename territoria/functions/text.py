"""Text normalisers and territory codes as column expressions. Each is part of some contract, so they stay apart."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from territoria.reference_data import ACCENTED, PLAIN


def folded(c: Column) -> Column:
    """Accented Latin letters without their accents."""
    return F.translate(c, ACCENTED, PLAIN)


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def column_name(name: str, fold: bool = False) -> str:
    """A header as an identifier; accents become underscores unless they are folded first."""
    name = name.strip().lower()
    name = name.translate(str.maketrans(ACCENTED, PLAIN)) if fold else name
    return re.sub(r"[^a-z0-9]+", "_", name).strip("_")


def page_text(c: Column) -> Column:
    """Lower case, folded, straight apostrophes; other punctuation becomes space."""
    return squeezed(F.regexp_replace(folded(F.lower(F.replace(c, F.lit("’"), F.lit("'")))), r"[^a-z0-9'\s]", " "))


def plain_text(c: Column) -> Column:
    """Lower case, folded, squeezed; punctuation stays."""
    return squeezed(folded(F.lower(c)))


def slug(c: Column) -> Column:
    """ASCII words joined by hyphens."""
    ascii_only = F.regexp_replace(folded(F.replace(F.lower(c), F.lit("’"), F.lit("'"))), r"[^\x00-\x7F]", "")
    return F.regexp_replace(F.regexp_replace(ascii_only, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def name_key(c: Column) -> Column:
    """Letters and digits only, folded; null is empty."""
    return F.regexp_replace(folded(F.lower(F.coalesce(c, F.lit("")))), "[^a-z0-9]", "")


def name_words(c: Column) -> Column:
    """Folded words; punctuation becomes space."""
    return squeezed(F.lower(F.regexp_replace(folded(c), r"\p{P}", " ")))


def code_slug(c: Column) -> Column:
    """Letters and digits of any script joined by underscores; accents stay; empty is `unknown`."""
    return _or_unknown(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_"))


def legacy_slug(c: Column) -> Column:
    """ASCII letters and digits joined by underscores, accents lost; empty is `unknown`."""
    return _or_unknown(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"))


def _or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(c, "^_+|_+$", ""), F.lit("")), F.lit("unknown"))


def file_slug(name: str) -> str:
    """A file name's stem as an identifier."""
    return re.sub(r"[^a-z0-9_]+", "_", name.lower().replace("-", "_")).strip("_")


def token_set(c: Column) -> Column:
    """The distinct folded words of a text."""
    return F.filter(F.array_distinct(F.split(folded(F.lower(c)), "[^a-z0-9]+")), lambda x: x != "")


def level(c: Column) -> Column:
    """A geographic level by its aliases; an unknown one is an error."""
    alias = folded(F.lower(F.trim(c)))
    return F.when(alias.isin("departement", "dep", "department"), "department").when(alias.isin("region", "reg"), "region").otherwise(F.raise_error(F.concat(F.lit("unknown level: "), c)).cast("string"))


def padded(c: Column) -> Column:
    """A one-digit code with a zero before it; longer codes keep their digits."""
    return F.when(c.rlike(r"^\d$"), F.concat(F.lit("0"), c)).otherwise(c)


def code_any(c: Column) -> Column:
    """Upper case without `.0` and points, padded."""
    return padded(F.replace(F.replace(F.upper(F.trim(c)), F.lit(".0"), F.lit("")), F.lit("."), F.lit("")))


def code_upper(c: Column) -> Column:
    return padded(F.upper(F.trim(c)))


def code_clean(c: Column) -> Column:
    """As code_any, but blank is null."""
    return padded(F.nullif(F.replace(F.upper(F.trim(c)), F.lit(".0"), F.lit("")), F.lit("")))


def code_strict(c: Column) -> Column:
    """Only 2A, 2B and one or two digits; anything else is null."""
    up = F.upper(F.trim(c))
    return F.when(up.isin("2A", "2B") | up.rlike(r"^\d{1,2}$"), padded(up))


def code_of_commune(c: Column) -> Column:
    return F.substring(c, 1, 2)


def match_or_null(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null, not empty, where there is none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def contains_any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return F.coalesce(out, F.lit(False))


def overlap(a: Column, b: Column) -> Column:
    """How many words two token sets share."""
    return F.size(F.array_intersect(a, b))


def label(name: Column, code: Column) -> Column:
    return F.concat(F.coalesce(name, code), F.lit(" ("), code, F.lit(")"))


def defragmented(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def extension(url: Column) -> Column:
    return F.coalesce(match_or_null(F.lower(F.regexp_replace(url, r"[?#].*$", "")), r"\.([a-z0-9]{1,5})$"), F.lit(""))
