"""Years before a series begins, filled from other publications, and debt tables by department."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territoria.functions.keys import idempotence_key
from territoria.functions.text import match_or_null, name_words
from territoria.operators.joins import absent_keys
from territoria.operators.windows import first_by
from territoria.plans.tables import longest_names, nearest_names

#: What a department's block, or a cell, says of it (fixed values: the publications' own words), figures before the label.
UNEMPLOYMENT, POVERTY = r"(\d+)\s+(\d+)\s+de\s+chomage", r"(\d+)(?:\s+(\d+))?\s+des\s+menages\s+sous\s+le\s+seuil\s+de\s+pauvrete"
FILING_RATE = r"(?i)([\d  ]+)\s+d[ée]p[ôo]ts?\s+de\s+dossiers\s+pour\s+100\s+000"
VERSION = "historical-harmonisation-1"


def context(blocks: DataFrame) -> DataFrame:
    """(year, code, taux_chomage, taux_pauvrete) from folded text blocks (year, code, block) that tell both."""
    two = lambda p: F.concat_ws(".", match_or_null(F.col("block"), p, 1), match_or_null(F.col("block"), p, 2)).try_cast("double")
    return blocks.select("year", "code", two(UNEMPLOYMENT).alias("taux_chomage"), two(POVERTY).alias("taux_pauvrete")).where("taux_chomage is not null and taux_pauvrete is not null")


def blocks(texts: DataFrame, ident: list[str], names: DataFrame, most: int) -> DataFrame:
    """(ident, code, block): the words of folded texts (ident, text) from each known name (name, code) on up to the next
    one; a name inside a longer one isn't one."""
    from pyspark.sql import Window

    keyed = texts.withColumn("_id", F.struct(*ident)).withColumn("text", F.lower(name_words(F.col("text"))))
    spans = longest_names(keyed.select("_id", "text"), "_id", names, most)
    until = F.lead("start").over(Window.partitionBy("_id").orderBy("start"))
    held = spans.withColumn("_until", until).join(names.select("name", "code"), "name").join(keyed, "_id")
    words = F.split("text", " ")
    block = F.array_join(F.slice(words, F.col("start") + 1, F.coalesce("_until", F.size(words)) - F.col("start")), " ")
    return held.select(*(f"_id.{c}" for c in ident), "code", block.alias("block"))


def harmonised(known: DataFrame, context_rows: DataFrame, history: DataFrame, written: DataFrame, years: list[int]) -> DataFrame:
    """New observations (period, code, indicator, value, unit, key) for years before the series: the context's rates, and
    each department's latest income. An observation whose key is written already is left out. A year whose context
    lacks a known department (code) is an error, which the job that reads the result raises."""
    wanted = known.agg(F.count_distinct("code").alias("_all"))
    have = context_rows.where(F.col("year").isin(years)).join(known.select("code").distinct(), "code")
    counts = have.groupBy("year").agg(F.count_distinct("code").alias("_have")).crossJoin(F.broadcast(wanted))
    whole = F.when(F.col("_have") == F.col("_all"), True).otherwise(F.raise_error(F.concat(F.lit("incomplete context: "), F.col("year").cast("string"))).cast("boolean"))
    rows = have.join(F.broadcast(counts.where(whole).select("year")), "year")
    income = first_by(history.where("indicator = 'revenu_median' and value is not null"), ["code"], "period", "id", descending=True).select("code", F.col("value").alias("revenu_median"))
    wide = rows.join(income, "code", "left").select(F.col("year").cast("string").alias("period"), "code", "taux_chomage", "taux_pauvrete", "revenu_median")
    out = wide.unpivot(["period", "code"], ["taux_chomage", "taux_pauvrete", "revenu_median"], "indicator", "value").where("value is not null")
    out = out.withColumn("unit", F.when(F.col("indicator") == "revenu_median", "euros").otherwise("%"))
    keyed = out.withColumn("key", idempotence_key(F.lit(VERSION), F.col("period"), F.col("code"), F.col("indicator"), F.format_string("%.6f", "value")))
    return absent_keys(keyed, written, ["key"])


def filing_rates(cells: DataFrame, sheet: list[str], names: DataFrame) -> DataFrame:
    """(sheet, code, name, rate): filings per 1000 from cells that tell them per 100 000, by the nearest department above."""
    found = nearest_names(cells, sheet, FILING_RATE, names)
    figure = F.regexp_replace("figure", "[  ]", "").try_cast("double")
    return first_by(found.withColumn("rate", figure / 100.0), [*sheet, "code"], "row", "col", descending=True).select(*sheet, "code", "name", "rate")
