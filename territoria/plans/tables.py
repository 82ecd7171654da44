"""Text pages and tables as rows: lines, cell grids and known names, by windows and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from territoria.functions.numbers import parsed_loose
from territoria.functions.text import match_or_null, name_words, page_text, squeezed
from territoria.operators.windows import first_by

#: A figure of a text page: digits, perhaps in threes with blanks between, a comma or point, and decimals. Threes don't
#: begin within a word: the figure of `NATION_1 420,0` is 420,0.
FIGURE = r"(?:(?<![\p{L}_])-|(?<![\p{L}\p{N}_-]))\d{1,3}(?:[  ]\d{3})+[,.]\d+|-?\d+[,.]\d+"
#: A department: its code, of two digits, of three overseas, or of a digit and a letter; a blank or a dash; and its name,
#: which begins with a letter.
DEPARTMENT = r"^\s*(\d[ABab]|9[78]\d|\d{2})(?:\s*[-–]\s*|\s+)(\p{L}.*)$"


def cell(c: Column) -> Column:
    """A cell's text on one line, null where blank."""
    return F.nullif(squeezed(F.translate(c, " \n", "  ")), F.lit(""))


def known_region(label: Column, regions: dict[str, str]) -> Column:
    """The region whose folded name a label is, or null. regions: folded name to name."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in regions.items() for x in kv)), page_text(label))


def folded_regions(names: list[str]) -> dict[str, str]:
    import re

    from territoria.reference_data import ACCENTED, PLAIN

    fold = lambda n: " ".join(re.sub(r"[^a-z0-9'\s]", " ", n.lower().replace("’", "'").translate(str.maketrans(ACCENTED, PLAIN))).split())
    return {fold(n): n for n in names}


def statement_rows(lines: DataFrame, page: list[str], regions: list[str], indicators: list[str]) -> DataFrame:
    """(page, region, departement_code, departement_name, indicator_name, value) from lines (page, line_no, line).

    A line of a label and as many figures as there are indicators is a row. A label that stands on the line before without
    any figure, a department's or the beginning of a region's, belongs to it. A region's row is no result but holds for the rows that
    follow; it never leaves its page."""
    names, at = folded_regions(regions), Window.partitionBy(*page).orderBy("line_no")
    rows = lines.withColumn("line", cell(F.col("line"))).where("line is not null")
    figures = F.regexp_extract_all("line", F.lit(f"({FIGURE})"), 1)
    rows = rows.withColumn("figures", figures).withColumn("label", F.trim(F.regexp_replace("line", rf"(?s)(?:{FIGURE}).*$", "")))
    full = F.size("figures") == len(indicators)
    begins = F.exists(F.array(*(F.lit(n) for n in names)), lambda n: F.startswith(n, page_text(F.col("line"))) & (page_text(F.col("line")) != ""))
    rows = rows.withColumn("full", full).withColumn("splits", (F.size("figures") == 0) & (F.col("line").rlike(DEPARTMENT) | begins))
    before = F.when(F.lag("splits").over(at), F.lag("line").over(at))
    rows = rows.withColumn("joined", F.trim(F.concat_ws(" ", before, "label")))
    rows = rows.where(F.col("full") & (F.col("joined") != ""))
    region = known_region(F.col("joined"), names)
    rows = rows.withColumn("own", region).withColumn("region", F.last("own", ignorenulls=True).over(at.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where(F.col("own").isNull() & F.col("joined").rlike(DEPARTMENT))
    pairs = F.explode(F.arrays_zip(F.array(*(F.lit(i) for i in indicators)).alias("indicator_name"), F.col("figures").alias("figure")))
    out = rows.select(*page, "region", F.upper(match_or_null(F.col("joined"), DEPARTMENT, 1)).alias("departement_code"), F.trim(match_or_null(F.col("joined"), DEPARTMENT, 2)).alias("departement_name"), pairs.alias("z"))
    return out.select(*page, "region", "departement_code", "departement_name", "z.indicator_name", parsed_loose(F.col("z.figure")).alias("value"))


def _numeric_after_first() -> Column:
    return F.size(F.filter("cells", lambda x, k: (k > 0) & parsed_loose(x).isNotNull()))


def region_label(first: Column) -> Column:
    """A row label that names a region: letters, and no department code."""
    return F.when(~first.rlike(DEPARTMENT) & first.rlike(r"\p{L}"), F.trim(F.replace(first, F.lit("*"), F.lit(""))))


def headers(cells: DataFrame, table: list[str]) -> DataFrame:
    """(table, col, header) from the header cells (table, row_no, col, value) of tables: the distinct texts of a column,
    from top to bottom; col_n where there is none."""
    parts = cells.withColumn("value", cell(F.col("value"))).groupBy(*table, "col").agg(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("row_no", "value")))).alias("p"))
    text = F.array_join(F.array_distinct(F.transform("p", lambda x: x["value"])), " ")
    return parts.select(*table, "col", F.coalesce(F.nullif(text, F.lit("")), F.concat(F.lit("col_"), F.col("col").cast("string"))).alias("header"))


def table_rows(rows: DataFrame, table: list[str], least: int = 3) -> DataFrame:
    """(table, region, departement_code, departement_name, indicator_name, value) from table rows (table, row_no, cells).

    Data begins with the first row of a department or region that has `least` numbers; the rows above are headers. A
    region's row holds for the departments that follow. Columns without a header, and cells without a number, are left
    out; a table without data rows gives none."""
    rows = rows.withColumn("cells", F.transform("cells", lambda c: cell(c))).withColumn("first", F.get("cells", F.lit(0)))
    starts = rows.where((_numeric_after_first() >= least) & F.col("first").isNotNull() & (F.col("first").rlike(DEPARTMENT) | region_label(F.col("first")).isNotNull())).groupBy(*table).agg(F.min("row_no").alias("begin"))
    rows = rows.join(starts, table)
    top = rows.where("row_no < begin").select(*table, "row_no", F.posexplode("cells").alias("col", "value"))
    at = Window.partitionBy(*table).orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    body = rows.where("row_no >= begin").withColumn("region", F.last(region_label(F.col("first")), ignorenulls=True).over(at)).where(F.col("first").rlike(DEPARTMENT))
    values = body.select(*table, "region", F.upper(match_or_null(F.col("first"), DEPARTMENT, 1)).alias("departement_code"), F.trim(match_or_null(F.col("first"), DEPARTMENT, 2)).alias("departement_name"), F.posexplode("cells").alias("col", "c")).where("col > 0")
    named = values.join(headers(top, table).where(F.col("header") != F.concat(F.lit("col_"), F.col("col").cast("string"))), [*table, "col"])
    return named.select(*table, "region", "departement_code", "departement_name", F.col("header").alias("indicator_name"), parsed_loose(F.col("c")).alias("value")).where("value is not null")


def tabled(rows: DataFrame, table: list[str]) -> DataFrame:
    """(table, row_no, name, value) from table rows (table, row_no, cells), where row 0 is the header: clean cells that
    hold anything, by the name of their column, col_n where it has none. A table of a header alone gives no rows."""
    cells = rows.select(*table, "row_no", F.posexplode("cells").alias("col", "value")).withColumn("value", cell(F.col("value")))
    names = cells.where("row_no = 0").select(*table, "col", F.coalesce("value", F.concat(F.lit("col_"), F.col("col").cast("string"))).alias("name"))
    return cells.where("row_no > 0 and value is not null").join(names, [*table, "col"]).select(*table, "row_no", "name", "value")


def best_tables(rows: DataFrame, page: list[str]) -> DataFrame:
    """The rows of each page's best table (page, strategy, table_no, row_no, cells): five points for a row of a department,
    one for another label, and one for each number; the first strategy and table among equals. A page whose tables have
    no points gives none."""
    cells = rows.withColumn("cells", F.transform("cells", lambda c: cell(c))).withColumn("first", F.get("cells", F.lit(0)))
    points = F.when(F.col("first").isNull(), 0).otherwise(F.when(F.col("first").rlike(DEPARTMENT), 5).when(F.col("first").rlike(r"\p{L}"), 1).otherwise(0) + _numeric_after_first())
    scored = cells.groupBy(*page, "strategy", "table_no").agg(F.sum(points).alias("points")).where("points > 0")
    best = first_by(scored, page, -F.col("points"), "strategy", "table_no").drop("points")
    return rows.join(best, [*page, "strategy", "table_no"])


def first_tables(rows: DataFrame, page: list[str]) -> DataFrame:
    """The rows of all tables of the first strategy that finds any on a page."""
    first = F.min("strategy").over(Window.partitionBy(*page))
    return rows.withColumn("_first", first).where(F.col("strategy") == F.col("_first")).drop("_first")


def nearest_names(cells: DataFrame, sheet: list[str], pattern: str, names: DataFrame, up: int = 7, left: int = 1, right: int = 2) -> DataFrame:
    """(sheet, row, col, code, name, figure): cells (sheet, row, col, value) that match a pattern, its first group as the
    figure, with the known name (code, name) in a cell above: up to `up` rows, from `left` columns before to `right`
    after; the nearest row first, then the leftmost column. Both sides meet in the cells where a name may be, so no
    inequality is joined."""
    hits = cells.withColumn("figure", match_or_null(F.col("value"), pattern)).where("figure is not null").select(*sheet, "row", "col", "figure")
    spots = hits.withColumn("up", F.explode(F.sequence(F.lit(1), F.lit(up)))).withColumn("side", F.explode(F.sequence(F.lit(-left), F.lit(right))))
    spots = spots.select(*sheet, "row", "col", "figure", "up", "side", (F.col("row") - F.col("up")).alias("_r"), (F.col("col") + F.col("side")).alias("_c"))
    known = cells.select(*sheet, F.col("row").alias("_r"), F.col("col").alias("_c"), F.lower(name_words(F.col("value"))).alias("key")).join(names.select("code", "name", F.lower(name_words(F.col("name"))).alias("key")), "key").drop("key")
    met = spots.join(known, [*sheet, "_r", "_c"])
    return first_by(met, [*sheet, "row", "col"], "up", "side").select(*sheet, "row", "col", "code", "name", "figure")


def longest_names(texts: DataFrame, ident: str, names: DataFrame, most: int) -> DataFrame:
    """(ident, start, end, name): where known names (name, of up to `most` words) stand in texts (ident, text) as words,
    start and end as word places; a name inside a longer one that is found there doesn't count."""
    words = texts.select(ident, F.split(name_words(F.col("text")), " ").alias("w"))
    grams = words.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(most)))).where("size(w) >= n")
    grams = grams.select(ident, "n", F.posexplode(F.expr("transform(sequence(0, size(w) - n), k -> array_join(slice(w, k + 1, n), ' '))")).alias("start", "key"))
    found = grams.join(names.select(F.lower(name_words(F.col("name"))).alias("key"), "name"), "key").select(ident, "start", (F.col("start") + F.col("n")).alias("end"), "name")
    reach = F.max("end").over(Window.partitionBy(ident).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("_reach", reach).where("_reach is null or end > _reach").drop("_reach")
