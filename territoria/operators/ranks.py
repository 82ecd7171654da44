"""Ranks, places and percentiles over groups of any size: no task sorts or holds a group as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts into which a group is cut for ranking, by its own quantiles; accuracy of the sketches that tell these.
BUCKETS, ACCURACY = 64, 10_000


def _with(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Joined by keys that may be null, or by none to the one row there is."""
    if not keys:
        return df.crossJoin(F.broadcast(other))
    right = other.withColumnsRenamed({k: f"_k{n}" for n, k in enumerate(keys)})
    on = [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)]
    return df.join(right, on).drop(*(f"_k{n}" for n in range(len(keys))))


def bucketed(df: DataFrame, keys: list[str], value: str, buckets: int = BUCKETS) -> DataFrame:
    """df with _bucket, the part of its group that a row is in: parts follow the order of the value and are about equally
    large; equal values share a part."""
    points = df.groupBy(*keys).agg(F.percentile_approx(value, [k / buckets for k in range(1, buckets)], ACCURACY).alias("_points"))
    return _with(df, points, keys).withColumn("_bucket", F.size(F.filter("_points", lambda p: p < F.col(value)))).drop("_points")


def places(df: DataFrame, keys: list[str], value: str, name: str = "place") -> DataFrame:
    """df with each row's place, from 1, in the order of the keys and then of the value, which is unique within them. The
    one window over all rows is over counts of groups' parts."""
    parts = bucketed(df, keys, value)
    sizes = parts.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*keys, "_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(value))
    return _with(parts, sizes.withColumn("_before", before).drop("_n"), [*keys, "_bucket"]).withColumn(name, (F.col("_before") + inside).cast("long")).drop("_bucket", "_before")


def average_ranks(df: DataFrame, ranks: dict[str, str], keys: list[str] = ()) -> DataFrame:
    """df with the rank of each row's value in its group, from 1, ascending, the mean of the places for ties, for several
    columns at once (column of numbers to the rank's name). A null has no rank.

    df is made once and kept for the two passes over it. One sketch of each group tells the parts of all columns; columns
    are stacked as (column, value), equal values counted, and counts are ordered within their part only, so neither a
    group nor a value that many rows share is one task's. Parts' own begins are few."""
    keys, names = list(keys), list(ranks)
    held = df.withColumn("_row", F.monotonically_increasing_id()).persist()
    points = held.groupBy(*keys).agg(*(F.percentile_approx(c, [k / BUCKETS for k in range(1, BUCKETS)], ACCURACY).alias(f"_p{k}") for k, c in enumerate(names)))
    below = lambda k, c: F.size(F.filter(f"_p{k}", lambda p: p < F.col(c)))
    cells = F.array(*(F.struct(F.lit(k).alias("_k"), F.col(c).cast("double").alias("_v"), below(k, c).alias("_b")) for k, c in enumerate(names)))
    stacked = _with(held, points, keys).select("_row", *keys, F.explode(cells).alias("_e")).select("_row", *keys, "_e._k", "_e._v", "_e._b").where("_v is not null")
    part = [*keys, "_k", "_b"]
    counts = stacked.repartition(*part).groupBy(*part, "_v").agg(F.count("*").alias("_c"))
    inside = Window.partitionBy(*part)
    placed = counts.withColumn("_in", F.sum("_c").over(inside.orderBy("_v"))).withColumn("_n", F.sum("_c").over(inside))
    sizes = stacked.groupBy(*part).agg(F.count("*").alias("_n"))
    begins = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys, "_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = _with(placed, begins, part).select(*keys, "_k", "_v", (F.col("_before") + F.col("_in") - F.col("_c") + (F.col("_c") + 1) / F.lit(2.0)).alias("_rank"))
    told = _with(stacked, ranked, [*keys, "_k", "_v"]).groupBy("_row").agg(*(F.max(F.when(F.col("_k") == k, F.col("_rank"))).alias(name) for k, name in enumerate(ranks.values())))
    return held.join(told, "_row", "left").drop("_row")


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, a column for each share, n): exact percentiles, interpolated. A sketch tells between which values each lies
    for certain, give or take a place; rows below and above are counted, with the value next to those between, and only
    the distinct values between are ordered."""
    keys, rows = list(keys), df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    slack = 3 / ACCURACY
    edges = [e for p in shares.values() for e in (max(p - slack, 0.0), min(p + slack, 1.0))]
    sketch = rows.groupBy(*keys).agg(F.percentile_approx("_v", edges, ACCURACY).alias("_e"))
    held = _with(rows, sketch, keys)
    spans = [F.struct(F.lit(k).alias("s"), F.get("_e", F.lit(2 * k)).alias("lo"), F.get("_e", F.lit(2 * k + 1)).alias("hi")) for k in range(len(shares))]
    side = held.withColumn("_p", F.explode(F.array(*spans))).select(*keys, F.col("_p.s").alias("_s"), "_v", F.when(F.col("_v").between(F.col("_p.lo"), F.col("_p.hi")), F.col("_v")).alias("_at"), F.when(F.col("_v") < F.col("_p.lo"), -1).when(F.col("_v") > F.col("_p.hi"), 1).otherwise(0).alias("_side"))
    counts = side.groupBy(*keys, "_s", "_side", "_at").agg(F.count("*").alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    of, order = Window.partitionBy(*keys, "_s"), ["_side", "_at"]
    placed = counts.withColumn("_n", F.sum("_c").over(of)).withColumn("_before", F.coalesce(F.sum("_c").over(of.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    share = F.element_at(F.array(*(F.lit(float(p)) for p in shares.values())), F.col("_s") + 1)
    placed = placed.withColumn("_pos", share * (F.col("_n") - 1))
    last = F.col("_before") + F.col("_c") - 1
    next_to = lambda rank: F.when(F.col("_side") == 0, F.col("_at")).when((F.col("_side") < 0) & (rank == last), F.col("_max")).when((F.col("_side") > 0) & (rank == F.col("_before")), F.col("_min")).otherwise(F.raise_error(F.lit("the sketch is less exact than it should be")).cast("double"))
    at = lambda rank: F.max(F.when((F.col("_before") <= rank) & (rank <= last), next_to(rank)))
    found = placed.groupBy(*keys, "_s").agg(at(F.floor("_pos")).alias("_lo"), at(F.ceil("_pos")).alias("_hi"), F.max(F.col("_pos") - F.floor("_pos")).alias("_part"), F.max("_n").alias("_n"))
    found = found.withColumn("_x", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part"))
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("_s") == k, F.col("_x"))).alias(name) for k, name in enumerate(shares)), F.max("_n").alias("n"))
