"""Dimensions that several stores share, and the migrations that bring a store to them without losing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from territoria.functions.keys import idempotence_key
from territoria.functions.text import name_key

#: What an observation's key is made of, by the version that made it: each import has its own.
KEY_PARTS = {
    "department-rates-1": ("code", "period", "value"),
    "mean-debt-1": ("code", "period", "value"),
    "inflation-1": ("code", "period", "indicator", "value"),
    "income-1": ("level", "code", "period", "indicator", "value"),
    "bridge-1": ("level", "code", "period", "indicator"),
    "historical-harmonisation-1": ("period", "code", "indicator", "value"),
}


def key_of(version: str, columns: list[str]) -> Column:
    """The key of an observation by a version, values with six decimals; a column that rows lack is an error."""
    parts = KEY_PARTS[version]
    if lacking := [p for p in parts if p not in columns]:
        raise ValueError(f"{version} needs {', '.join(lacking)}")
    return idempotence_key(F.lit(version), *(F.format_string("%.6f", F.col(p).cast("double")) if p == "value" else F.col(p) for p in parts))


def keyed(rows: DataFrame, version: str, name: str = "key") -> DataFrame:
    return rows.withColumn(name, key_of(version, rows.columns))


def rekeyed(rows: DataFrame, old: str, new: str) -> DataFrame:
    """rows (with key and version) after a migration of keys: those of the old version get the new one's key and version,
    unless a row with that key is there already; all others stay. `moved` tells which changed, so a second run moves none.
    A row whose old key isn't what its version makes of it is left as it is."""
    due = (F.col("version") == old) & (F.col("key") == key_of(old, rows.columns))
    fresh = rows.withColumn("_due", F.coalesce(due, F.lit(False))).withColumn("_new", key_of(new, rows.columns))
    there = rows.select(F.col("key").alias("_new")).distinct().withColumn("_taken", F.lit(True))
    joined = fresh.join(there, "_new", "left").withColumn("moved", F.col("_due") & F.col("_taken").isNull())
    return joined.withColumn("key", F.when(F.col("moved"), F.col("_new")).otherwise(F.col("key"))).withColumn("version", F.when(F.col("moved"), F.lit(new)).otherwise(F.col("version"))).select(*rows.columns, "moved")


def with_region_codes(departments: DataFrame, regions: DataFrame) -> DataFrame:
    """departments (code, name, region_name) with region_code by the region's name in any spelling; one whose name no region
    (region_code, region_name) has keeps the code it had, if any."""
    known = regions.select(F.col("region_code").alias("_code"), name_key(F.col("region_name")).alias("_k"))
    had = F.col("region_code") if "region_code" in departments.columns else F.lit(None).cast("string")
    joined = departments.withColumn("_k", name_key(F.col("region_name"))).join(known, "_k", "left")
    return joined.withColumn("region_code", F.coalesce("_code", had)).drop("_k", "_code")


def mismatches(rows: DataFrame, dimension: DataFrame, ident: str, code: str, dim_code: str) -> DataFrame:
    """(ident, written, known) of rows whose own code isn't that of the dimension's row they point at."""
    joined = rows.join(dimension.select(ident, F.col(dim_code).alias("known")), ident)
    return joined.where(F.col(code) != F.col("known")).select(ident, F.col(code).alias("written"), "known")


def deprecated(registry: DataFrame, objects: DataFrame) -> DataFrame:
    """The registry of objects no longer used (object_name, object_type, replacement, reason), with those new ones that it
    lacks; one that it has stays as it was noted first."""
    return registry.unionByName(objects.join(registry.select("object_name"), "object_name", "left_anti").select(registry.columns))


def migration_report(before: dict[str, DataFrame], after: dict[str, DataFrame], mismatched: DataFrame) -> DataFrame:
    """(name, before, after, added) for each dimension, and the number of mismatches as a row of its own."""
    out = None
    for name in sorted(after):
        old = before[name].agg(F.count("*").alias("before")) if name in before else after[name].limit(0).agg(F.count("*").alias("before"))
        one = old.join(after[name].agg(F.count("*").alias("after"))).select(F.lit(name).alias("name"), "before", "after", (F.col("after") - F.col("before")).alias("added"))
        out = one if out is None else out.unionByName(one)
    wrong = mismatched.agg(F.count("*").alias("after")).select(F.lit("mismatches").alias("name"), F.lit(0).cast("long").alias("before"), "after", F.col("after").alias("added"))
    return out.unionByName(wrong)
