"""Links in listing pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territoria.functions.periods import last_year
from territoria.functions.rules import cascade
from territoria.functions.text import defragmented, extension, name_words


def links(pages: DataFrame) -> DataFrame:
    """(page_id, href, absolute, extension, year, place): each distinct link of a page, where it first stands."""
    base = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    rows = pages.select("page_id", base.alias("base"), F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("place", "href"))
    rows = rows.withColumn("absolute", defragmented(F.when(F.col("href").rlike("^https?://"), F.col("href")).otherwise(F.concat("base", "href"))))
    once = rows.groupBy("page_id", "absolute").agg(F.min(F.struct("place", "href")).alias("m"))
    return once.select("page_id", "m.href", "absolute", extension(F.col("absolute")).alias("extension"), last_year(F.col("absolute")).alias("year"), F.col("m.place").cast("long").alias("place"))


def chosen_file(candidates: DataFrame, year: int, current: int) -> DataFrame:
    """Of each page's candidate links (page_id, href, year, place) the first of the year wanted, else the first at all if
    the year wanted is the current one."""
    from territoria.operators.windows import first_by

    fit = candidates.where((F.col("year") == year) | F.lit(year == current))
    return first_by(fit, ["page_id"], ~F.coalesce(F.col("year") == year, F.lit(False)), "place")


#: Extensions of files that hold data, and words that tell a link's kind (fixed values), in the order in which they count.
DATA = ("csv", "xlsx", "xls", "zip", "json", "xml", "pdf")
KINDS = [("surendettement", "filings"), ("depots", "deposits"), ("inclusion", "inclusion"), ("emploi", "employment")]


def classified(found: DataFrame, regions: list[str]) -> DataFrame:
    """Links (see links) with region, kind and relevant: the first region and kind whose word the address holds, letters
    folded, and whether it leads to a file of data."""
    key = name_words(F.lower(F.translate("absolute", "-_/", "   ")))
    region = F.lit(None).cast("string")
    for r in reversed(regions):
        region = F.when(F.contains(key, F.lower(name_words(F.lit(r)))), r).otherwise(region)
    kind = cascade(key, KINDS, "other")
    return found.withColumn("region", region).withColumn("kind", kind).withColumn("relevant", F.col("extension").isin(*DATA))


def publications(pages: DataFrame, pattern: str) -> DataFrame:
    """(page_id, url, place): addresses of publications by a pattern, in links or in JSON whose slashes are escaped, once
    each; place counts from the last in the alphabet, as newer ones have later names."""
    hits = F.regexp_extract_all(F.replace("html", F.lit("\\/"), F.lit("/")), F.lit(f"({pattern})"), 1)
    base = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    rows = pages.select("page_id", base.alias("base"), F.explode(F.array_distinct(hits)).alias("hit"))
    absolute = F.when(F.col("hit").rlike("^https?://"), F.col("hit")).otherwise(F.concat("base", "hit"))
    once = rows.groupBy("page_id").agg(F.sort_array(F.collect_set(absolute), asc=False).alias("urls"))
    return once.select("page_id", F.posexplode("urls").alias("place", "url")).select("page_id", "url", (F.col("place") + 1).cast("long").alias("place"))
