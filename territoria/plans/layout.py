"""Tables rebuilt from words that have places on a page, by its rules, by the words' own edges, or by both."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Strategies in the order in which a page tries them: what tells columns, and what tells rows.
STRATEGIES = (("lines", "lines"), ("lines", "text"), ("text", "text"))
#: In points: how far places may differ and be the same; the blank between two words of a cell; the least blank between
#: columns; the blank between tables, in heights of a row.
SNAP, WORD, GAP, APART = 3.0, 6.0, 8.0, 2.5
#: Part of a table's rows that may reach over the blank between two columns, as a heading over both does.
REACHING = 0.25


def _islands(rows: DataFrame, keys: list[str], begin: str, end: str, apart: Column, name: str) -> DataFrame:
    """rows with the number, from 0, of the island they are in: intervals with no blank of `apart` or more between them."""
    order = Window.partitionBy(*keys).orderBy(begin, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col(begin) >= reach + apart, 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn(name, F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def text_rows(words: DataFrame, page: list[str], apart: float = APART, name: str = "table_no") -> DataFrame:
    """words (page, x0, x1, top, bottom, text) with table_no (or another name) and row_no: a row is what overlaps in height, but for a
    little; a table ends where the blank below a row is `apart` times its height."""
    middle = words.withColumn("_a", F.col("top") + (F.col("bottom") - F.col("top")) * 0.25).withColumn("_b", F.col("bottom") - (F.col("bottom") - F.col("top")) * 0.25)
    rows = _islands(middle, page, "_a", "_b", F.lit(0.0), "_row")
    spans = rows.groupBy(*page, "_row").agg(F.min("top").alias("_top"), F.max("bottom").alias("_bottom"))
    before = Window.partitionBy(*page).orderBy("_row")
    blank = F.col("_top") - F.lag("_bottom").over(before)
    spans = spans.withColumn("_new", F.when(blank > apart * (F.col("_bottom") - F.col("_top")), 1).otherwise(0))
    spans = spans.withColumn(name, F.sum("_new").over(before.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    spans = spans.withColumn("row_no", (F.row_number().over(Window.partitionBy(*page, name).orderBy("_row")) - 1).cast("int"))
    return rows.join(spans.select(*page, "_row", name, "row_no"), [*page, "_row"]).drop("_row", "_a", "_b")


def text_columns(words: DataFrame, table: list[str], gap: float = GAP, word: float = WORD, reaching: float = REACHING) -> DataFrame:
    """(table, edges): the places between columns of tables of words with row_no: blanks at least `gap` wide that few rows
    reach over. Words of a row that are close are one stretch; stretches begin and end, and a running count of those that
    are open tells how many rows cover a place."""
    stretches = _islands(words, [*table, "row_no"], "x0", "x1", F.lit(word), "_s").groupBy(*table, "row_no", "_s").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    rows = words.groupBy(*table).agg(F.count_distinct("row_no").alias("_rows"))
    steps = stretches.select(*table, F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("d")))).alias("e")).select(*table, "e.x", "e.d")
    steps = steps.groupBy(*table, "x").agg(F.sum("d").alias("d"))
    along = Window.partitionBy(*table).orderBy("x")
    open_ = steps.withColumn("_open", F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_to", F.lead("x").over(along))
    # neighbouring places with few rows open are one blank
    thin = open_.join(rows, table).withColumn("_thin", (F.col("_open") <= F.floor(F.col("_rows") * reaching)) & F.col("_to").isNotNull())
    thin = thin.withColumn("_run", F.sum(F.when(F.col("_thin"), 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0))).where("_thin")
    blanks = thin.groupBy(*table, "_run").agg(F.min("x").alias("a"), F.max("_to").alias("b"), F.min("_open").alias("least"), F.min(F.struct("_open", "x", "_to")).alias("inner"))
    # a heading over two columns leaves the blank between them as thin; the edge stands where fewest rows are open
    edges = blanks.where((F.col("b") - F.col("a") >= gap)).select(*table, ((F.col("inner.x") + F.col("inner._to")) / 2).alias("edge"))
    return rows.select(*table).join(edges.groupBy(*table).agg(F.sort_array(F.collect_list("edge")).alias("edges")), table, "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<double>")))


def _snapped(places: DataFrame, keys: list[str], value: str, snap: float, name: str) -> DataFrame:
    """(keys, name): the different places, ascending, where those within `snap` of each other are one, their mean."""
    near = _islands(places.withColumn("_v", F.col(value)), keys, value, "_v", F.lit(snap), "_n")
    return near.groupBy(*keys, "_n").agg(F.avg(value).alias("_m")).groupBy(*keys).agg(F.sort_array(F.collect_list("_m")).alias(name))


def ruled(lines: DataFrame, page: list[str], snap: float = SNAP) -> DataFrame:
    """(page, table_no, xs, ys, top, bottom, left, right): tables by their rules (page, x0, x1, top, bottom), of which those
    that are narrower than `snap` stand upright and those that are lower lie flat. Rules that overlap in height are one
    table; one without two upright rules is none."""
    upright = F.col("x1") - F.col("x0") <= snap
    flat = F.col("bottom") - F.col("top") <= snap
    rules = lines.where(upright | flat).withColumn("upright", upright)
    rules = _islands(rules.withColumn("_a", F.col("top") - snap).withColumn("_b", F.col("bottom") + snap), page, "_a", "_b", F.lit(0.0), "table_no")
    keys = [*page, "table_no"]
    rules = rules.withColumn("x", (F.col("x0") + F.col("x1")) / 2).withColumn("y", (F.col("top") + F.col("bottom")) / 2)
    box = rules.groupBy(*keys).agg(F.min("top").alias("_top"), F.max("bottom").alias("_bottom"))
    xs, ys = _snapped(rules.where("upright"), keys, "x", snap, "xs"), _snapped(rules.where("not upright"), keys, "y", snap, "ys")
    return box.join(xs, keys).join(ys, keys, "left").where("size(xs) > 1").withColumn("ys", F.coalesce("ys", F.array().cast("array<double>")))


def _place(edges: str, at: Column) -> Column:
    return F.size(F.filter(edges, lambda e: e < at))


def _cells(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row_no, cells): words of a cell in reading order, one text; null where a table's row has none. Words have
    row_no, col and the table's number of columns."""
    cell = words.groupBy(*keys, "row_no", "columns", "col").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.round("top", 0).alias("t"), "x0", "text"))), lambda w: w["text"]), " ").alias("value"))
    rows = cell.groupBy(*keys, "row_no", "columns").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("_by"))
    numbered = rows.withColumn("row_no", (F.row_number().over(Window.partitionBy(*keys).orderBy("row_no")) - 1).cast("int"))
    return numbered.select(*keys, "row_no", F.expr("transform(sequence(0, columns - 1), k -> _by[k])").alias("cells"))


def rebuilt(words: DataFrame, lines: DataFrame, page: list[str], columns: str = "lines", rows: str = "lines", snap: float = SNAP) -> DataFrame:
    """(page, table_no, row_no, cells) of the tables of pages, from words (page, x0, x1, top, bottom, text) and rules
    (page, x0, x1, top, bottom). columns and rows say what tells them: the page's "lines", or the words' "text". A word
    is where its middle is; one outside of the rules belongs to no table. Tables by text have two rows and two columns
    at least. Pages are small; all is by page."""
    mid_x, mid_y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    keys = [*page, "table_no"]
    if columns == "text":
        placed = text_rows(words, page)
        held = placed.join(text_columns(placed, keys), keys).withColumn("col", _place("edges", mid_x)).withColumn("columns", F.size("edges") + 1)
        whole = held.groupBy(*keys).agg(F.max("row_no").alias("_last")).where("_last > 0").select(*keys)
        return _cells(held.where("columns > 1").join(whole, keys, "left_semi"), keys)
    tables = ruled(lines, page, snap)
    inside = words.join(tables, page).where((mid_y > F.col("_top") - snap) & (mid_y < F.col("_bottom") + snap) & (mid_x > F.element_at("xs", 1)) & (mid_x < F.element_at("xs", -1)))
    inside = inside.withColumn("col", _place("xs", mid_x) - 1).withColumn("columns", F.size("xs") - 1)
    if rows == "lines":
        inside = inside.where((F.size("ys") > 1) & (mid_y > F.element_at("ys", 1)) & (mid_y < F.element_at("ys", -1))).withColumn("row_no", _place("ys", mid_y) - 1)
    else:
        inside = text_rows(inside.drop("_top", "_bottom"), keys, apart=float("inf"), name="_part")
    return _cells(inside, keys)


def _kept(rows: DataFrame, page: list[str]) -> DataFrame:
    """rows dealt by page and kept under a mark of their own. Spark finds what is kept by its plan: without a mark, the same
    path would give these rows again after its files have changed."""
    return rows.withColumn("_mark", F.lit(uuid4().hex)).repartition(*page).persist().drop("_mark")


def page_tables(words: DataFrame, lines: DataFrame, page: list[str]) -> DataFrame:
    """The tables of pages (page, strategy, table_no, row_no, cells) by every strategy, numbered in their order. Words and
    rules, which come of parsing files, are made once for each call, dealt by page and kept for all strategies."""
    words, lines, out = _kept(words, page), _kept(lines, page), None
    for k, (columns, rows) in enumerate(STRATEGIES):
        found = rebuilt(words, lines, page, columns, rows).select(*page, F.lit(f"{k} {columns} {rows}").alias("strategy"), "table_no", "row_no", "cells")
        out = found if out is None else out.unionByName(found)
    return out
