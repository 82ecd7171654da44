"""Registration of queries, and how the domain's tables are read off the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with the SQL for the same rows; {name} stands for a table defined below."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            used, text = [], sql
            while any("{" + k + "}" in text for k in TABLES):
                for k in TABLES:
                    if "{" + k + "}" in text:
                        text = text.replace("{" + k + "}", k)
                        used.append(k)
            needed = [k for k in TABLES if k in used or any(k in DEPENDS.get(u, ()) for u in used)]
            head = ", ".join(f"{k} as ({TABLES[k]})" for k in needed)
            ORACLE_SQL[f.__name__] = (f"with {head}{', ' if text.lstrip().startswith('with ') else ' '}" + (text.lstrip()[5:] if text.lstrip().startswith("with ") else text)) if head else text
        return f

    return register


#: The domain's tables as SQL over the test tables.
TABLES = {
    "monthly": "select strftime(o_orderdate, '%Y-%m') as period, year(o_orderdate)::int as y, c_nationkey as dept, o_orderpriority as indicator, sum(o_totalprice) as v from orders join customer on o_custkey = c_custkey group by all",
    "totals": "select period, y, dept, sum(v) as v from monthly group by all",
    "wide": "select year(l_shipdate)::int as y, s_nationkey as dept, sum(l_quantity) as POP, count(*)::double as ACT, count(*) filter (where l_returnflag = 'R')::double as CHOM from lineitem join supplier on l_suppkey = s_suppkey group by all",
    "macro": "select y, dept, 'POP' as code, POP as v from wide union all select y, dept, 'ACT', ACT from wide union all select y, dept, 'CHOM', CHOM from wide",
    "observed": "select event_id as id, 'department' as lvl, (user_id % 25)::varchar as code, event_type as indicator, case when event_id % 13 = 0 then 'other' else 'u' end as unit, case when event_id % 17 = 0 then 'nan'::double else value end as v, case when day(ts) <= 15 then '2024-01' else '2024-02' end as period, case when event_id % 7 = 0 then null else (event_id % 10) / 10.0::double end as confidence, (event_id % 3)::int as updated, ts as created from events where not (user_id % 25 >= 20 and event_type in ('click', 'view', 'error')) and not (user_id % 25 between 15 and 19 and event_type = 'error')",
    "configs": "select * from (values (0, 'click', 0.30::double, 'positive', 'u'), (1, 'view', 0.25::double, 'negative', 'u'), (2, 'purchase', 0.20::double, 'positive', 'u'), (3, 'signup', 0.15::double, 'negative', 'u'), (4, 'error', 0.10::double, 'positive', 'u')) t(ord, indicator, weight, direction, expected_unit)",
    "picked": "select o.*, weight, direction, ord from observed o join configs c using (indicator) where not isnan(v) and unit = 'u' qualify row_number() over (partition by lvl, period, code, indicator order by confidence desc nulls last, updated desc nulls last, created desc nulls last, id desc) = 1",
    "detail": "select *, case when lo = hi then 0.5::double when direction = 'negative' then 1 - (v - lo) / nullif(hi - lo, 0) else (v - lo) / nullif(hi - lo, 0) end as normalized from (select *, min(v) over (partition by lvl, period, indicator) as lo, max(v) over (partition by lvl, period, indicator) as hi, sum(weight) over (partition by lvl, period, code) as available from picked)",
    "scored": "select u.lvl, u.period, u.code, coalesce(d.have, 0) / 1.0::double as coverage, case when coalesce(d.have, 0) >= 0.6 then least(greatest(d.raw, 0), 100) end as score, seen from (select distinct lvl, period, code from observed) u left join (select lvl, period, code, sum(weight) as have, sum(normalized * weight / available * 100) as raw, list(indicator) as seen from detail group by all) d using (lvl, period, code)",
}
DEPENDS = {"totals": ("monthly",), "macro": ("wide",), "picked": ("observed", "configs"), "detail": ("picked", "observed", "configs"), "scored": ("detail", "picked", "observed", "configs")}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(c: Column | str, name: str | None = None, digits: int = 6) -> Column:
    """Sums differ in their last digits with the order of rows; both engines round. A zero has no sign."""
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col.cast("double"), digits) + F.lit(0.0)).alias(name or c)


def long(c: Column | str, name: str | None = None) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long").alias(name or c)


def monthly(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.year("o_orderdate").alias("y"), F.col("c_nationkey").alias("dept"), F.col("o_orderpriority").alias("indicator")).agg(F.sum("o_totalprice").alias("v"))


def totals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.year("o_orderdate").alias("y"), F.col("c_nationkey").alias("dept")).agg(F.sum("o_totalprice").alias("v"))


def wide(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_returnflag").join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy(F.year("l_shipdate").alias("y"), F.col("s_nationkey").alias("dept")).agg(F.sum("l_quantity").alias("POP"), F.count("*").cast("double").alias("ACT"), F.count_if(F.col("l_returnflag") == "R").cast("double").alias("CHOM"))


def macro(spark: SparkSession, d: str) -> DataFrame:
    return wide(spark, d).unpivot(["y", "dept"], ["POP", "ACT", "CHOM"], "code", "v")


def territories(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("dept"), "n_name", F.col("r_regionkey").alias("region_code"), "r_name")


def observed(spark: SparkSession, d: str) -> DataFrame:
    e, user = table(spark, d, "events"), F.col("user_id") % 25
    e = e.where(~((user >= 20) & F.col("event_type").isin("click", "view", "error")) & ~(user.between(15, 19) & (F.col("event_type") == "error")))
    return e.select(
        F.col("event_id").alias("id"), F.lit("department").alias("level"), user.cast("string").alias("code"), F.col("event_type").alias("indicator"),
        F.when(F.col("event_id") % 13 == 0, "other").otherwise("u").alias("unit"), F.when(F.col("event_id") % 17 == 0, float("nan")).otherwise(F.col("value")).alias("value"),
        F.when(F.dayofmonth("ts") <= 15, "2024-01").otherwise("2024-02").alias("period"), F.when(F.col("event_id") % 7 == 0, None).otherwise((F.col("event_id") % 10) / F.lit(10.0)).alias("confidence"), (F.col("event_id") % 3).cast("int").alias("updated"), F.col("ts").alias("created"))


def configs(spark: SparkSession) -> DataFrame:
    rows = [(0, "click", 0.30, "positive", "u"), (1, "view", 0.25, "negative", "u"), (2, "purchase", 0.20, "positive", "u"), (3, "signup", 0.15, "negative", "u"), (4, "error", 0.10, "positive", "u")]
    return spark.createDataFrame(rows, "ord int, indicator string, weight double, direction string, expected_unit string")
