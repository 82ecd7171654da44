"""Long and wide forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_form(df: DataFrame, ids: list[str], values: list[str], names: str = "indicator_code", value: str = "value") -> DataFrame:
    """A row per id and value column; rows without a value go."""
    wide = df.select(*ids, *(F.col(v).cast("double").alias(v) for v in values))
    return wide.unpivot(ids, values, names, value).where(F.col(value).isNotNull())


def wide_form(df: DataFrame, keys: list[str], names: str, value: str, columns: list, how=F.sum, prefix: str = "", fill: float | None = None) -> DataFrame:
    """A column per name. The names are given, so no job looks for them."""
    out = df.groupBy(*keys).pivot(names, columns).agg(how(value))
    out = out.select(*keys, *(F.col(f"`{c}`").alias(f"{prefix}{c}") for c in columns))
    return out if fill is None else out.na.fill(fill, [f"{prefix}{c}" for c in columns])


def padded_to(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """The columns of a schema in its order; those that df lacks are null."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in schema.items()))


def zipped(df: DataFrame, ids: list[str], values: str, names: list[str]) -> DataFrame:
    """Values of an array as rows with fixed names, place by place."""
    pairs = F.arrays_zip(F.array(*(F.lit(x) for x in names)).alias("name"), F.col(values).alias("value"))
    return df.select(*ids, F.explode(pairs).alias("z")).select(*ids, "z.name", "z.value")


def stacked(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def nested(df: DataFrame, keys: list[str], order: list[str], fields: list[str], name: str = "details") -> DataFrame:
    """One row per key with an array of structs, sorted by `order`."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *(f for f in fields if f not in order)))).alias(name))


def conjunction(conditions: dict[str, object]) -> Column:
    """Equality with each parameter that is given."""
    out = F.lit(True)
    for c, v in conditions.items():
        if v is not None and v != "":
            out = out & (F.col(c) == v)
    return out


def matrix(df: DataFrame, keys: list[str], names: str, value: str, columns: list, prefix: str = "") -> DataFrame:
    """A column per name from rows that are one for each key and name; a second one is an error, which the job that reads
    the result raises."""
    single = F.when(F.count(value) <= 1, F.first(value, ignorenulls=True)).otherwise(F.raise_error(F.lit("a cell of the matrix has several rows")).cast("double"))
    cells = df.groupBy(*keys, names).agg(single.alias(value))
    return wide_form(cells, keys, names, value, columns, F.max, prefix)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 5000) -> DataFrame:
    """A page of an ordered listing; limits outside 1..most and negative offsets are errors."""
    if not 1 <= limit <= most or offset < 0:
        raise ValueError(f"limit must be 1 to {most}, offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)
