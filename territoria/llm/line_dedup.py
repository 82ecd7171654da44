"""Near-duplicate lines: MinHash of character shingles, exact verification, union-find, one line kept per component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territoria.llm.common import carried, cut, documents_of, likely_in, tidy
from territoria.llm.minhash import Plan, banded, links, planned

#: Shingles of eight characters (of a trimmed line in lower case), a similarity of 0.8, and the recall wanted there.
PLAN = planned("chars", 8, least=0.8, recall=0.98, rows=5)


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, t, line_no, norm): the trimmed lower-case lines of each row's text; t, a hash of it, tells rows of one doc_id
    apart. Whole texts go to lower case, which is the same as line by line, as no letter's form depends on another line;
    and lines come out of the array as they are needed, so that nothing after it makes them again."""
    rows = documents_of(docs, "doc_id", "text").where("text is not null").withColumn("t", F.xxhash64("text"))
    return rows.select("doc_id", "t", F.posexplode(F.transform(F.split(F.lower("text"), "\n"), lambda x: F.trim(x))).alias("line_no", "norm"))


@tidy
def line_components(docs: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """Which lines are near copies of each other.

    Returns a row per line of every text of docs (doc_id, text; other columns are ignored): doc_id, t, line_no,
    n_copies (lines with the same text, this one included), component_doc and component_line (the first line, by doc_id
    and line_no, that exact copies and links lead to), kept (this line is the first). Lines are equal when their trimmed
    lower-case texts are. A blank line is no copy of anything and is kept. Null texts have no lines. Rows that repeat a
    doc_id and its text have the same line places and are kept or dropped alike. An empty table gives no rows.
    """
    lines = lines_of(docs).withColumn("h1", F.xxhash64("norm")).withColumn("h2", F.xxhash64(F.lit(1), "norm"))
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "line_no", "t")
    # lines are hashed before equal ones meet: their band hashes are far smaller than their texts, which then aren't shuffled;
    # they are written, as the places of all lines are read again in the end
    prints = cut(banded(lines.select("doc_id", "t", "line_no", "h1", "h2", F.col("norm").alias("text")), plan))
    classes = cut(prints.where(F.size("bands") > 0).groupBy("h1", "h2").agg(F.min(place).alias("place"), F.count("*").alias("w"), F.first("bands").alias("bands")).withColumn("id", F.monotonically_increasing_id()))
    keyed = cut(classes.select("id", "h1", "h2", "w", "place"))

    def texts(wanted: DataFrame) -> DataFrame:
        held = cut(keyed.join(wanted, "id"))
        # the first line of each class is enough, and most documents hold none that is wanted
        some = likely_in(documents_of(docs, "doc_id", "text"), held, F.col("doc_id"), F.col("place.doc_id"))
        near = likely_in(lines_of(some).select(F.xxhash64("norm").alias("h1"), "norm"), held, F.col("h1"), F.col("h1")).withColumn("h2", F.xxhash64(F.lit(1), "norm"))
        return near.join(held.select("id", "h1", "h2", "w"), ["h1", "h2"]).groupBy("id").agg(F.first("w").alias("w"), F.first("norm").alias("text"))

    found = links(classes.select("id", "bands"), texts, plan)
    linked = keyed.join(found.select("id", "component"), "id")
    least = cut(linked.groupBy("component").agg(F.min("place").alias("first")))
    linked = cut(linked.join(least, "component").select("id", "first"))
    several = keyed.join(linked, "id", "left").where("w > 1 or first is not null").select("h1", "h2", F.col("w").alias("n_copies"), F.coalesce("first", "place").alias("first"))
    every = prints.drop("bands").join(cut(several), ["h1", "h2"], "left")
    first = F.coalesce("first", place)
    return every.select("doc_id", "t", F.col("line_no").cast("long").alias("line_no"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), first["doc_id"].alias("component_doc"), first["line_no"].cast("long").alias("component_line"), (first == place).alias("kept"))


@tidy
def without_repeated_lines(docs: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """docs with only the kept lines in their texts, and n_chars, if there is such a column, counted anew. Other columns
    stay. A document that loses all its lines goes; one whose text is null or blank was no copy and stays."""
    dropped = cut(line_components(docs, plan).where("not kept").groupBy("doc_id", "t").agg(F.collect_set("line_no").alias("gone")))
    rows = carried(docs).withColumn("t", F.xxhash64("text")).alias("d").join(dropped.alias("g"), F.expr("d.doc_id <=> g.doc_id and d.t = g.t"), "left")
    # the lambda's argument holds the lines, so that the text is split once; array_except hashes, so all is linear
    left = F.expr("transform(array(split(text, '\n')), lines -> array_join(transform(array_except(sequence(0L, size(lines) - 1L), gone), k -> lines[cast(k as int)]), '\n'))[0]")
    now = rows.withColumn("now", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)).where("gone is null or trim(now) <> ''")
    out = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("now").alias("text")}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length("now").cast("long")).alias("n_chars")
    return now.select(*out.values())
