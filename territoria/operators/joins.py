"""Joins that the domain needs beyond plain ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from territoria.functions.periods import year_before


def different(df: DataFrame, value: str | Column) -> Column:
    """The different values of a column with few of them (years), ascending, as one array: a scalar subquery, so no join is
    planned for it."""
    return df.select(F.sort_array(F.collect_set(value))).scalar()


def with_latest_year(left: DataFrame, name: str, year: Column, right: DataFrame, right_year: str, ahead: int = 0) -> DataFrame:
    """left with the latest year on the right that is up to `ahead` years after its own, null where there is none."""
    held = left.withColumn("_years", different(right, right_year))
    return held.withColumn(name, F.array_max(F.filter("_years", lambda y: y <= year + ahead))).drop("_years")


def snapshot_asof(left: DataFrame, right: DataFrame, on: list[str], left_year: str, right_year: str, ahead: int = 0) -> DataFrame:
    """Each left row with the right rows of equal keys from the latest snapshot, that is the latest year of any key. A
    key that the snapshot lacks has no row."""
    dated = with_latest_year(left, "_y", F.col(left_year), right, right_year, ahead)
    return dated.join(right.withColumnRenamed(right_year, "_y"), [*on, "_y"]).withColumnRenamed("_y", "snapshot_year")


def conformed(frames: list[DataFrame], key: str, column: str) -> DataFrame:
    """One row per key of any frame, with the first known value in their order, and how many frames know the key."""
    out = None
    for n, f in enumerate(frames):
        part = f.select(F.col(key), F.col(column).alias(f"_v{n}"), F.lit(1).alias(f"_n{n}"))
        out = part if out is None else out.join(part, key, "full")
    values, known = [F.col(f"_v{n}") for n in range(len(frames))], [F.coalesce(f"_n{n}", F.lit(0)) for n in range(len(frames))]
    return out.select(key, F.coalesce(*values).alias(column), sum(known[1:], known[0]).cast("long").alias("sources"))


def missing_pairs(a: DataFrame, b: DataFrame, present: DataFrame) -> DataFrame:
    """Pairs of two small dimensions that are not present."""
    return a.crossJoin(b).join(present, [*a.columns, *b.columns], "left_anti")


def compared_sets(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, as `missing` or `unexpected`."""
    return expected.select(key).join(observed, key, "left_anti").withColumn("status", F.lit("missing")).unionByName(observed.select(key).join(expected, key, "left_anti").withColumn("status", F.lit("unexpected"))).distinct()


def year_over_year(series: DataFrame, period: str, value: str) -> DataFrame:
    """(period, before, rate): the change in percent against the same month a year before, where there is one."""
    before = series.select(F.col(period).alias("_p"), F.col(value).alias("before"))
    joined = series.withColumn("_p", year_before(F.col(period))).join(before, "_p").where("before <> 0")
    return joined.select(period, "before", ((F.col(value) / F.col("before") - 1) * 100.0).alias("rate"))


def propagated(annual: DataFrame, periods: DataFrame, year: str, period: str) -> DataFrame:
    """Each annual row at each period from its year's first month on. Periods compare as strings: a bare year comes
    before its own months. Periods are binned by their first four characters; a row goes to the few bins from its year's
    on, where both sides meet by an equal key."""
    begin = F.col(year).cast("string")
    binned = annual.withColumn("_bins", different(periods, F.substring(period, 1, 4)))
    binned = binned.withColumn("_bin", F.explode(F.filter("_bins", lambda y: y >= F.substring(begin, 1, 4)))).drop("_bins")
    return binned.join(periods.withColumn("_bin", F.substring(period, 1, 4)), "_bin").where(F.col(period) >= F.concat(begin, F.lit("-01"))).drop("_bin")


def months_or_year(annual: DataFrame, months: DataFrame, year: str, month: str) -> DataFrame:
    """Each annual row at the months of its year, or at the year itself if no month is known."""
    found = months.select(F.col(month).alias("_m"), F.substring(F.col(month), 1, 4).alias("_y"))
    return annual.join(found, F.col(year).cast("string") == F.col("_y"), "left").withColumn("period_key", F.coalesce("_m", F.col(year).cast("string"))).drop("_m", "_y")


def ratios(rows: DataFrame, keys: list[str], code: str, value: str, pairs: DataFrame) -> DataFrame:
    """(keys, code, value) of derived ratios by their definitions (result, top, bottom); null where the lower value is
    zero. Definitions are few."""
    top, bottom = rows.select(*keys, F.col(code).alias("top"), F.col(value).alias("_t")), rows.select(*keys, F.col(code).alias("bottom"), F.col(value).alias("_b"))
    joined = top.join(pairs, "top").join(bottom, [*keys, "bottom"])
    return joined.select(*keys, F.col("result").alias(code), (F.lit(100.0) * F.col("_t") / F.nullif(F.col("_b"), F.lit(0.0))).alias(value))


def matched(rows: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    """An inner join that must be one to one: a repeated key on either side is an error, which the job that reads the
    result raises. Keys that are null equal each other."""

    def once(side: DataFrame, tag: str) -> DataFrame:
        rest = [c for c in side.columns if c not in on]
        held = side.groupBy(*on).agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_r"))
        single = F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit(f"keys {on} repeat")).cast("boolean"))
        return held.where(single).select(*(F.col(k).alias(f"{tag}{k}") for k in on), "_r.*")

    a, b = once(rows, ""), once(others, "_o_")
    return a.join(b, [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in on]).drop(*(f"_o_{k}" for k in on))


def absent_keys(rows: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't there yet."""
    return rows.join(there.select(*keys).distinct(), keys, "left_anti")


def candidate_pairs(sets: DataFrame, candidates: DataFrame, n: int, common: int) -> DataFrame:
    """(name, cand): pairs among which are the n candidates (cand, cw) that share most words with each set (name, w).

    A word that at most `common` candidates hold is rare, and all who share it meet. Of candidates that share nothing but
    common words with a set, those with the same common words are equals, so the first n by name of each such kind will do:
    kinds meet sets, candidates don't. If one of these n shares a rare word as well, it only ranks higher."""
    words = candidates.select("cand", F.explode(F.array_distinct("cw")).alias("word")).where("word is not null")
    frequent = words.groupBy("word").agg(F.count("*").alias("_n")).where(F.col("_n") > common).select("word")
    wanted = sets.select("name", F.explode(F.array_distinct("w")).alias("word"))
    rare = wanted.join(frequent, "word", "left_anti").join(words, "word").select("name", "cand")
    kinds = words.join(frequent, "word").groupBy("cand").agg(F.sort_array(F.collect_list("word")).alias("kind"))
    first = kinds.withColumn("_at", F.row_number().over(Window.partitionBy("kind").orderBy("cand"))).where(F.col("_at") <= n).drop("_at")
    met = wanted.join(first.select("kind").distinct().withColumn("word", F.explode("kind")), "word").select("name", "kind").distinct()
    return rare.unionByName(met.join(first, "kind").select("name", "cand")).distinct()


def best_matches(sets: DataFrame, candidates: DataFrame, n: int, common: int = 1000) -> DataFrame:
    """(name, cand, overlap, place): of the candidates (cand, cw) the n that share most words with each set (name, w),
    the first by name among equals; candidates that share none are left out. A word that stands nearly everywhere makes no
    pairs of its own (see candidate_pairs), so pairs grow with the rows; overlaps are of whole sets. Names on either side
    are unique."""
    pairs = candidate_pairs(sets, candidates, n, common).join(sets.select("name", "w"), "name").join(candidates.select("cand", "cw"), "cand")
    shared = pairs.select("name", "cand", F.size(F.array_intersect("w", "cw")).cast("long").alias("overlap")).where("overlap > 0")
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("overlap"), "cand"))
    return shared.withColumn("place", place.cast("long")).where(F.col("place") <= n)


def either(*conditions: Column) -> Column:
    """Any of the flags; null counts as false."""
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out
