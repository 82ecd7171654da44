"""Similarity self-join of documents on word n-grams: MinHash banding, verified on full n-gram sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from territoria.llm.common import carried, cut, documents_of, likely_in, tidy
from territoria.llm.minhash import Plan, banded, links, planned

#: Five-word shingles, a Jaccard similarity of 0.8, found with a probability of 0.9995 or more.
PLAN = planned("words", 5, least=0.8, recall=0.9995, rows=5)


def _normal() -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[\x09-\x0D\x20]+", " "))


def _hashed(rows: DataFrame, text: str) -> DataFrame:
    return rows.withColumn("h1", F.xxhash64(text)).withColumn("h2", F.xxhash64(F.lit(1), text))


def _classed(docs: DataFrame, plan: Plan) -> DataFrame:
    """The rows that `ngram_links` describes, with the hashes h1 and h2 of their words."""
    rows = _hashed(documents_of(docs, "doc_id", "text").select("doc_id", _normal().alias("text")), "text")
    prints = cut(banded(rows, plan))
    worded = prints.where(F.size("bands") > 0)
    classes = cut(worded.groupBy("h1", "h2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.first("bands").alias("bands")))
    ids = classes.where("class_id is not null").select(F.col("class_id").alias("id"), "h1", "h2", F.col("class_size").alias("w"), "bands")
    # two texts under one doc_id would share an id: the second gets a negative one of its own
    twice = ids.groupBy("id").count().where("count > 1")
    keyed = cut(ids.join(twice, "id", "left").withColumn("own", F.when(F.col("count").isNull(), F.col("id")).otherwise(-F.shiftrightunsigned(F.xxhash64("h1", "h2", "id"), 2) - 2)).select(F.col("own").alias("id"), F.col("id").alias("class_id"), "h1", "h2", "w", "bands"))

    def texts(wanted: DataFrame) -> DataFrame:
        one = keyed.join(wanted, "id").select("id", "class_id", "h1", "h2", "w")
        held = cut(one)
        # by doc_id first: only the texts wanted are put in normal form again
        near = likely_in(documents_of(docs, "doc_id", "text"), held, F.col("doc_id"), F.col("class_id"))
        same = _hashed(near.select("doc_id", _normal().alias("text")), "text")
        return same.join(held.withColumnRenamed("class_id", "doc_id"), ["doc_id", "h1", "h2"]).groupBy("id").agg(F.first("w").alias("w"), F.first("text").alias("text"))

    found = links(keyed.select("id", "bands"), texts, plan)
    linked = keyed.select("id", "class_id", "h1", "h2").join(found, "id")
    least = linked.groupBy("component").agg(F.min("class_id").alias("component_id"))
    linked = cut(linked.join(cut(least), "component").select("h1", "h2", "component_id", "n_links"))
    result = classes.drop("bands").join(linked, ["h1", "h2"], "left")
    result = cut(result.where("class_size > 1 or n_links is not null"))
    out = prints.drop("bands").join(result, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "class_id", "doc_id")
    return out.select(
        "h1", "h2", "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (F.coalesce("n_links", F.lit(0)) + F.coalesce("class_size", F.lit(1)) - 1).cast("long").alias("n_links"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


@tidy
def ngram_links(docs: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """Which documents have similar n-gram sets.

    Returns a row per row of docs (doc_id long, text string; other columns are ignored): doc_id, class_id (the smallest
    doc_id whose words are the same, in lower case), class_size, n_links (rows that this one is linked with directly,
    its copies included), component_id (the smallest doc_id that links lead to, its own if there is none), kept (doc_id
    is component_id). Words are split at ASCII white space; a text of fewer words than a shingle has one shingle of
    all of them; a null text or one without words is linked with nothing, not even another such. Rows that repeat
    a doc_id and its text count as copies; an empty table gives no rows. A null doc_id never stays when its
    component has another one.
    """
    return _classed(docs, plan).drop("h1", "h2")


@tidy
def representatives(docs: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """The rows of docs, with all their columns, that stay when one document of each component does: that with the
    smallest doc_id, and one row of it if rows repeat. Rows linked with nothing stay, null and empty texts among them."""
    stay = cut(_classed(docs, plan).where("kept").groupBy("doc_id", "h1", "h2").agg(F.count("*").alias("n"), F.max("class_size").alias("size")))
    rows = _hashed(carried(docs).withColumn("words", _normal()), "words").drop("text", "words").alias("d")
    held = rows.join(stay.alias("s"), F.expr("d.doc_id <=> s.doc_id and d.h1 = s.h1 and d.h2 = s.h2"))
    own = [F.col(f"row.`{c}`") for c in docs.columns]
    repeats = F.expr("s.n > 1 and s.size > 1")
    if stay.where("n > 1 and size > 1").isEmpty():
        return held.select(*own)
    once = held.where(repeats).select("row", "d.doc_id", "d.h1", "d.h2").dropDuplicates(["doc_id", "h1", "h2"])
    return held.where(~repeats).select(*own).unionByName(once.select(*own))
