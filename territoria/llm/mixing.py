"""Mixing sources to target weights: Efraimidis-Spirakis sampling to word budgets, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from territoria.llm.common import carried, cut, documents_of, tidy

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of sources in code point order, repeating; words mixed for each word there is; most times a source is taken.
WEIGHTS, SHARE, CEILING = (3, 1, 2), 1.5, 2
#: Sampling weight by a document's quality label, and that of documents without one.
QUALITY, UNLABELLED = {1: 2.0, 0: 0.5}, 1.0
#: Up to so many sources the table of budgets is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 10_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def budgets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """(source, source_size, docs, target) from (source, source_size, docs): `share` of all words is dealt out by
    weight, a source takes at most `ceiling` times its size, and the excess goes to the others by weight. With sources
    in the order in which they reach their ceilings, this is one prefix sum; there is a row per source only."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * share
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    free = sources.withColumn("weight", pick).withColumn("cap", F.col("source_size") * float(ceiling)).withColumn("level", level)
    # the level of the first source that stays below its ceiling holds for all that follow
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(Window.partitionBy())
    final = F.coalesce(first["level"], F.lit(float("inf")))
    return free.withColumn("target", F.least(F.col("cap"), final * F.col("weight"))).select("source", "source_size", "docs", "target")


def uniform(*columns: str) -> Column:
    """A number in (0, 1) from the md5 of the columns: alike on every run, machine and engine."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


@tidy
def mixed_sources(docs: DataFrame, labels: DataFrame | None = None, weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """Takes each source's words up to its target.

    Returns a row per row of docs (doc_id, text, source; other columns are ignored): doc_id, h (hash of the text), source, size,
    source_size, target, epochs, taken, sample_key. Whole epochs come first: epochs = floor(target / source_size), and
    every document is taken so often. What is left of the target goes to documents in the order of their keys,
    -ln(u) / quality weight, the document at the boundary up to the budget (so a source's words are its target
    rounded down). labels (doc_id, quality) may give quality weights; the best label of a doc_id counts.

    A null text has size 0; a null source is a source of its own, in last place; a source without words has target 0.
    Rows that repeat a doc_id are rows like others; ties of keys are broken by doc_id and size. No rows give no rows.
    Keys are sorted in sqrt(n) ranges of each source, whose sums are added up before, so no task sorts a source.
    """
    rows = documents_of(docs, "doc_id", "source", "text").select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("h"))
    rows = cut(rows)  # texts are read and counted once
    if labels is None:
        rows = rows.withColumn("quality_weight", F.lit(UNLABELLED))
    else:
        best = labels.groupBy("doc_id").agg(F.max("quality").alias("_q"))
        value = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in QUALITY.items() for x in kv)), F.col("_q").cast("int")), F.lit(UNLABELLED))
        rows = rows.join(best, "doc_id", "left").withColumn("quality_weight", value).drop("_q")
    targets = budgets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), weights, share, ceiling)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("left", F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"))
    targets = cut(targets)
    few = targets.count() <= BROADCAST_SOURCES
    same_source = rows["source"].eqNullSafe(targets["source"])
    keyed = rows.join(F.broadcast(targets) if few else targets, same_source).drop(targets["source"])
    keyed = keyed.withColumn("sample_key", -F.ln(uniform("doc_id")) / F.col("quality_weight"))
    ranges = F.greatest(F.floor(F.sqrt("docs")), F.lit(1))
    keyed = keyed.withColumn("range", F.floor((1 - F.exp(-F.col("sample_key"))) * ranges).cast("int"))
    sums = keyed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("_s"), F.col("range").alias("_r"), F.coalesce(F.sum("range_size").over(ahead), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "range").orderBy("sample_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("range") == F.col("_r")))
    part = F.least(F.greatest(F.col("left") - F.col("start") - F.col("inside"), F.lit(0)), F.col("size"))
    return placed.select("doc_id", "h", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "sample_key")


@tidy
def repeated(docs: DataFrame, labels: DataFrame | None = None, **options) -> DataFrame:
    """The rows of docs, with all their columns, as often as the mix takes them. Documents aren't cut: the one at a
    budget's boundary is taken whole if half of it is within, and texts without words as often as there are whole
    epochs. Rows that repeat a doc_id and its text share evenly in what is taken of them."""
    taken = mixed_sources(docs, labels, **options).groupBy("doc_id", "h").agg((F.sum("taken") / F.count("*")).alias("taken"), F.max("size").alias("size"), F.max("epochs").alias("epochs"))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.col("epochs")).cast("int")
    wanted = cut(taken.select("doc_id", "h", times.alias("times")).where("times > 0"))
    rows = carried(docs).withColumn("h", F.xxhash64("text")).alias("d").join(wanted.alias("w"), F.expr("d.doc_id <=> w.doc_id and d.h = w.h"))
    return rows.withColumn("again", F.explode(F.expr("sequence(1, w.times)"))).select(*(F.col(f"row.`{c}`") for c in docs.columns))


#: The same rows by SQL alone, without the ranges.
ORACLE = r"""
with best as (select doc_id, max(quality) q from labels group by doc_id),
sized as (
  select d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+'))::bigint size,
    case b.q when 1 then 2.0::double when 0 then 0.5::double else 1.0::double end w
  from documents d left join best b using (doc_id)),
sources as (
  select source, sum(size)::bigint source_size, ([3, 1, 2])[1 + (row_number() over (order by source nulls last) - 1) % 3]::double weight
  from sized group by source),
levels as (
  select *, 2.0::double * source_size cap, (1.5::double * sum(source_size) over ()
    - coalesce(sum(2.0::double * source_size) over (order by 2.0::double * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by 2.0::double * source_size / weight, source nulls last rows between current row and unbounded following) as lvl
  from sources),
final as (select coalesce(arg_min(lvl, cap / weight) filter (where lvl * weight <= cap), 'infinity'::double) lvl from levels),
targets as (select source, source_size, least(cap, f.lvl * weight) target from levels, final f),
budget as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end epochs from targets),
keyed as (
  select s.doc_id, s.size, b.source_size, b.target, b.epochs, floor(b.target)::bigint - b.epochs * b.source_size as rest,
    coalesce(sum(s.size) over (partition by s.source
      order by -ln((('0x' || substr(md5(s.doc_id::varchar), 1, 12))::bigint + 0.5::double) / 281474976710656::double) / s.w, s.doc_id, s.size
      rows between unbounded preceding and 1 preceding), 0)::bigint ahead
  from sized s join budget b on s.source is not distinct from b.source)
select doc_id, size, source_size, target, (epochs * size + least(greatest(rest - ahead, 0), size))::bigint as taken from keyed
"""
