"""Star schema, views, joins and reshaping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from territoria.catalogue.registry import long, macro, monthly, query, rounded, table, territories, totals, wide
from territoria.functions.keys import indicator_key
from territoria.functions.numbers import guarded_ratio, zscore
from territoria.functions.rules import aggregation_rule, cascade, reference_year
from territoria.functions.text import label
from territoria.operators import aggregates, joins, ranks, reshape, windows
from territoria.plans import imports, star
from territoria.sinks import absent, overlaid, upserted

PAIRS = [("UNEMPLOYMENT", "CHOM", "ACT"), ("ACTIVITY", "ACT", "POP")]


@query("""with base as (select m.y, n_regionkey as region_code, code, sum(v) as v from {macro} m join nation on dept = n_nationkey group by all),
pairs(result, a, b) as (values ('UNEMPLOYMENT', 'CHOM', 'ACT'), ('ACTIVITY', 'ACT', 'POP'))
select y, region_code, code, 'sum' as rule, round(v, 6) as value from base
union all select t.y, t.region_code, result, 'derived_ratio', round(100 * t.v / nullif(u.v, 0), 6) from pairs join base t on t.code = a join base u on u.code = b and t.y = u.y and t.region_code = u.region_code""")
def region_ratio_rollup(spark, d):
    rows = macro(spark, d).join(territories(spark, d), "dept")
    out = star.regional(rows, ["y", "region_code"], "code", "v", spark.createDataFrame(PAIRS, "result string, top string, bottom string"))
    return out.select("y", "region_code", "code", "rule", rounded("v", "value"))


@query("""select m.period, m.dept, n_name, r_name, indicator, round(v, 6) as value from {monthly} m join nation on dept = n_nationkey join region on n_regionkey = r_regionkey
where indicator = '1-URGENT' and r_name = 'ASIA' order by period, dept limit 50 offset 10""")
def star_fact_listing(spark, d):
    dim = table(spark, d, "orders").select(F.col("o_orderpriority").alias("indicator")).distinct()
    rows = star.facts(monthly(spark, d), dim, territories(spark, d), "indicator", "dept").where(reshape.conjunction({"indicator": "1-URGENT", "r_name": "ASIA", "n_name": None}))
    return reshape.page(rows.select("period", "dept", "n_name", "r_name", "indicator", rounded("v", "value")), [F.col("period"), F.col("dept")], 50, 10)


@query("select t.period, t.dept, n_name as territory, round(t.v, 6) as value from {totals} t join nation on dept = n_nationkey")
def total_deposits_view(spark, d):
    return totals(spark, d).join(territories(spark, d), "dept").select("period", "dept", F.col("n_name").alias("territory"), rounded("v", "value"))


@query("""select t.period, t.dept, s.yy as snapshot_year, m.code, round(t.v, 6) as deposits, round(m.v, 6) as value
from {totals} t join (select a.y, max(b.y) as yy from (select distinct y from totals) a join (select distinct y from {macro}) b on b.y <= a.y + 1 group by a.y) s on s.y = t.y join macro m on m.dept = t.dept and m.y = s.yy""")
def deposits_with_macro_asof(spark, d):
    left = totals(spark, d).withColumnsRenamed({"v": "deposits", "y": "reference_year"})
    out = star.deposits_with_macro(left, macro(spark, d).withColumnRenamed("y", "macro_year"), ["dept"])
    return out.select("period", "dept", "snapshot_year", "code", rounded("deposits"), rounded("v", "value"))


BRIDGE = """select {key} as {name}, p.period, s.yy as snapshot_year, round(case when sum(ACT) > 0 then sum(CHOM) / sum(ACT) * 100 end, 6) as value
from (select distinct period, y from {{totals}}) p join (select a.y, max(b.y) as yy from (select distinct y from totals) a join (select distinct y from {{wide}}) b on b.y <= a.y group by a.y) s using (y) join wide w on w.y = s.yy join nation on w.dept = n_nationkey group by all"""


def _bridge(spark, d, key):
    rows = wide(spark, d).withColumnRenamed("y", "year").join(territories(spark, d), "dept")
    return imports.unemployment(rows, totals(spark, d).select("period").distinct(), [key]).select(key, "period", "snapshot_year", rounded("value"))


@query(BRIDGE.format(key="dept", name="dept").replace("{{", "{").replace("}}", "}"))
def bridge_unemployment_dept(spark, d):
    return _bridge(spark, d, "dept")


@query(BRIDGE.format(key="n_regionkey", name="region_code").replace("{{", "{").replace("}}", "}"))
def bridge_unemployment_region(spark, d):
    return _bridge(spark, d, "region_code")


@query("""with best as (select n_regionkey as region_code, strftime(ts, '%Y-%m-%d') as period, value, event_id from events join nation on user_id % 25 = n_nationkey where event_type = 'purchase'
  qualify row_number() over (partition by n_regionkey, strftime(ts, '%Y-%m-%d') order by (event_id % 10) desc, ts desc, event_id desc) = 1),
pop as (select n_regionkey as region_code, sum(POP) as pop from {wide} join nation on dept = n_nationkey where y = 2000 group by all)
select region_code, period, event_id, round(value / pop * 1000, 6) as value from best join pop using (region_code)""")
def bridge_dossiers_per_1000(spark, d):
    t = territories(spark, d)
    e = table(spark, d, "events").where("event_type = 'purchase'").withColumn("dept", (F.col("user_id") % 25).cast("int")).join(t, "dept")
    best = windows.first_by(e.withColumn("period", F.date_format("ts", "yyyy-MM-dd")), ["region_code", "period"], F.col("event_id") % 10, "ts", "event_id", descending=True)
    pop = wide(spark, d).where("y = 2000").join(t, "dept").groupBy("region_code").agg(F.sum("POP").alias("pop"))
    return best.join(pop, "region_code").select("region_code", "period", "event_id", rounded(guarded_ratio(F.col("value"), F.col("pop"), 1000.0), "value"))


@query("""with a as (select n_nationkey as k, n_name as name from nation where n_nationkey < 20), b as (select distinct c_nationkey as k, 'c' || c_nationkey as name from customer where c_nationkey >= 5), c as (select distinct s_nationkey as k, 's' || s_nationkey as name from supplier)
select coalesce(a.k, b.k, c.k) as dept, coalesce(a.name, b.name, c.name) as name, ((a.k is not null)::int + (b.k is not null)::int + (c.k is not null)::int)::bigint as sources from a full join b using (k) full join c on c.k = coalesce(a.k, b.k)""")
def conformed_departments(spark, d):
    a = table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("dept"), F.col("n_name").alias("name"))
    b = table(spark, d, "customer").where("c_nationkey >= 5").select(F.col("c_nationkey").alias("dept")).distinct().withColumn("name", F.concat(F.lit("c"), "dept"))
    c = table(spark, d, "supplier").select(F.col("s_nationkey").alias("dept")).distinct().withColumn("name", F.concat(F.lit("s"), "dept"))
    return joins.conformed([a, b, c], "dept", "name")


@query("""with k as (select distinct strftime(o_orderdate, '%Y-%m') as period_key from orders union select distinct strftime(l_shipdate, '%Y') from lineitem union select distinct strftime(ts, '%Y-%m') from events)
select period_key, substr(period_key, 1, 4)::int as reference_year, case when length(period_key) = 7 then substr(period_key, 6, 2)::int end as reference_month_number, case when length(period_key) = 7 then 'month' else 'year' end as granularity from k""")
def conformed_periods(spark, d):
    key = lambda name, col, fmt: table(spark, d, name).select(F.date_format(col, fmt).alias("period_key")).distinct()
    return star.periods(key("orders", "o_orderdate", "yyyy-MM"), key("lineitem", "l_shipdate", "yyyy"), key("events", "ts", "yyyy-MM"))


@query("""with s as (select distinct 'bdf' as source_system, o_orderpriority as indicator_code, 'p ' || o_orderstatus as indicator_name from orders union all select distinct 'insee', p_type, p_brand from part union all select distinct 'obs', event_type, event_type from events)
select source_system || ':' || indicator_code as indicator_key, source_system, indicator_code, min(indicator_name) as indicator_name from s group by all""")
def indicator_dimension(spark, d):
    part = lambda name, system, code, text: table(spark, d, name).select(F.lit(system).alias("source_system"), F.col(code).alias("indicator_code"), text.alias("indicator_name")).distinct()
    out = star.indicators(part("orders", "bdf", "o_orderpriority", F.concat(F.lit("p "), "o_orderstatus")), part("part", "insee", "p_type", F.col("p_brand")), part("events", "obs", "event_type", F.col("event_type")))
    return out.select("indicator_key", "source_system", "indicator_code", "indicator_name")


@query("""select t.period, t.dept, round(t.v, 6) as value, round(w.POP, 6) as "macro_POP", round(w.ACT, 6) as "macro_ACT", round(w.CHOM, 6) as "macro_CHOM" from {totals} t left join {wide} w on w.dept = t.dept and w.y = t.y - 1""")
def macro_mart_pivot(spark, d):
    m = reshape.wide_form(macro(spark, d), ["y", "dept"], "code", "v", ["POP", "ACT", "CHOM"], how=F.min, prefix="macro_").withColumn("y", F.col("y") + 1)
    return totals(spark, d).join(m, ["y", "dept"], "left").select("period", "dept", rounded("v", "value"), *(rounded(f"macro_{c}") for c in ("POP", "ACT", "CHOM")))


@query("""select c_custkey, c_nationkey, code as indicator_code, round(v, 6) as value from (select c_custkey, c_nationkey, unnest(['bal', 'neg', 'odd']) as code, unnest([c_acctbal, case when c_acctbal < 0 then c_acctbal end, case when c_custkey % 7 = 0 then null else c_custkey::double end]) as v from customer) where v is not null""")
def unpivot_commune_long(spark, d):
    c = table(spark, d, "customer")
    w = c.select("c_custkey", "c_nationkey", F.col("c_acctbal").alias("bal"), F.when(F.col("c_acctbal") < 0, F.col("c_acctbal")).alias("neg"), F.when(F.col("c_custkey") % 7 == 0, None).otherwise(F.col("c_custkey")).alias("odd"))
    out = reshape.long_form(w, ["c_custkey", "c_nationkey"], ["bal", "neg", "odd"])
    return out.select("c_custkey", "c_nationkey", "indicator_code", rounded("value"))


@query("""with x as (select s_nationkey as dept, year(l_shipdate)::int as y, unnest(['qty_total', 'taux_discount', 'part_tax']) as code, unnest([l_quantity, l_discount, case when l_orderkey % 5 = 0 then null else l_tax end]) as v from lineitem join supplier on l_suppkey = s_suppkey)
select y, dept, code, case when code in ('taux_discount', 'part_tax') then 'mean' else 'sum' end as rule, round(case when code in ('taux_discount', 'part_tax') then avg(v) else sum(v) end, 6) as value, count(v)::bigint as n from x where v is not null group by y, dept, code""")
def rule_driven_aggregate(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    w = rows.select(F.col("s_nationkey").alias("dept"), F.year("l_shipdate").alias("y"), F.col("l_quantity").alias("qty_total"), F.col("l_discount").alias("taux_discount"), F.when(F.col("l_orderkey") % 5 == 0, None).otherwise(F.col("l_tax")).alias("part_tax"))
    out = reshape.long_form(w, ["y", "dept"], ["qty_total", "taux_discount", "part_tax"], "code").withColumn("rule", aggregation_rule(F.col("code")))
    return aggregates.by_rule(out, ["y", "dept", "code"], "rule", "value").select("y", "dept", "code", "rule", rounded("value"), "n")


@query("""with s as (select period, sum(v) as v from {totals} group by all) select a.period, round(b.v, 6) as before, round((a.v / b.v - 1) * 100, 6) as rate from s a join s b on b.period = (substr(a.period, 1, 4)::int - 1)::varchar || substr(a.period, 5, 3) where b.v <> 0""")
def inflation_yoy(spark, d):
    s = totals(spark, d).groupBy("period").agg(F.sum("v").alias("v"))
    return joins.year_over_year(s, "period", "v").select("period", rounded("before"), rounded("rate"))


@query("""with s as (select period, sum(v) as v from {totals} group by all), m as (select a.period, (a.v / b.v - 1) * 100 as rate from s a join s b on b.period = (substr(a.period, 1, 4)::int - 1)::varchar || substr(a.period, 5, 3) where b.v <> 0),
r as (select period, rate from m union all select substr(period, 1, 4), avg(rate) from m group by 1) select r.period, n_nationkey as dept, round(rate, 6) as rate from r cross join nation""")
def inflation_annual(spark, d):
    s = totals(spark, d).groupBy("period").agg(F.sum("v").alias("value"))
    rates = imports.inflation(s)
    return rates.crossJoin(territories(spark, d).select("dept")).select("period", "dept", rounded("rate"))


@query("""with p as (select distinct period from {totals} union select distinct y::varchar from totals) select w.dept, w.y, p.period, round(w.POP, 6) as value from {wide} w join p on p.period >= w.y::varchar || '-01' where w.y >= 1999""")
def annual_value_propagation(spark, d):
    t = totals(spark, d)
    p = t.select("period").distinct().union(t.select(F.col("y").cast("string")).distinct())
    return joins.propagated(wide(spark, d).where("y >= 1999"), p, "y", "period").select("dept", "y", "period", rounded("POP", "value"))


@query("""with m as (select distinct period from {totals} where y <= 1997) select w.dept, w.y, coalesce(m.period, w.y::varchar) as period_key, round(w.ACT, 6) as value from {wide} w left join m on substr(m.period, 1, 4) = w.y::varchar""")
def conditional_period_fanout(spark, d):
    m = totals(spark, d).where("y <= 1997").select("period").distinct()
    return joins.months_or_year(wide(spark, d), m, "y", "period").select("dept", "y", "period_key", rounded("ACT", "value"))


@query("""select coalesce(f.dept, m.dept) as dept, f.y, round(f.v, 6) as filings, round(coalesce(m.v, 0), 6) as macro from (select dept, y, sum(v) as v from {totals} group by all) f left join (select dept, y, avg(v) as v from {macro} where dept % 3 <> 0 group by all) m on f.dept = m.dept and f.y = m.y""")
def filings_on_macro(spark, d):
    f = totals(spark, d).groupBy("dept", "y").agg(F.sum("v").alias("filings"))
    m = macro(spark, d).where("dept % 3 <> 0").groupBy("dept", "y").agg(F.avg("v").alias("macro"))
    return f.join(m, ["dept", "y"], "left").select("dept", "y", rounded("filings"), rounded(F.coalesce("macro", F.lit(0.0)), "macro"))


@query("""select indicator, round(coalesce(sum(v) filter (where y = 1996), 0), 2) as y1996, round(coalesce(sum(v) filter (where y = 1997), 0), 2) as y1997, round(coalesce(sum(v) filter (where y = 2050), 0), 2) as y2050 from {monthly} group by indicator order by sum(v) desc, indicator limit 3""")
def indicator_year_heatmap(spark, d):
    m = monthly(spark, d)
    top = m.groupBy("indicator").agg(F.sum("v").alias("t")).orderBy(F.desc("t"), "indicator").limit(3)
    out = reshape.wide_form(m.join(F.broadcast(top), "indicator"), ["indicator"], "y", "v", [1996, 1997, 2050], prefix="y", fill=0.0)
    return out.select("indicator", *(rounded(c, digits=2) for c in ("y1996", "y1997", "y2050")))


@query("select y, round(sum(v), 2) as total, round(avg(v), 6) as mean from {totals} group by y")
def chart_aggregates(spark, d):
    return totals(spark, d).groupBy("y").agg(rounded(F.sum("v"), "total", 2), rounded(F.avg("v"), "mean"))


@query("""with s as (select period, sum(v) as v from {totals} group by all), x as (select *, lag(v) over (order by period) as b, substr(period, 1, 4)::int * 12 + substr(period, 6, 2)::int - lag(substr(period, 1, 4)::int * 12 + substr(period, 6, 2)::int) over (order by period) = 1 as ok from s where substr(period, 6, 2) <> '05')
select period, round(v, 6) as value, coalesce(ok, false) as consecutive, round(case when ok then v - b end, 6) as change, round(case when ok then (v - b) / nullif(b, 0) * 100 end, 6) as percent from x""")
def monthly_consecutive_change(spark, d):
    s = totals(spark, d).where("substr(period, 6, 2) <> '05'").groupBy("period").agg(F.sum("v").alias("v"))
    return windows.consecutive_change(s, "period", "v").select("period", rounded("v", "value"), "consecutive", rounded("change"), rounded("percent"))


@query("""with s as (select period, sum(v) as v from {totals} group by all), x as (select period, v - lag(v) over (order by period) as c from s) select period, round(c, 6) as change from x where c is not null order by abs(c) desc, period limit 5""")
def top_breaks(spark, d):
    s = totals(spark, d).groupBy("period").agg(F.sum("v").alias("v"))
    out = windows.consecutive_change(s, "period", "v").where("change is not null")
    return out.orderBy(F.abs("change").desc(), "period").limit(5).select("period", rounded("change"))


@query("select dept, round(v, 6) as value from {totals} where period = (select max(period) from totals) order by v desc, dept limit 10")
def top_departments_latest(spark, d):
    t = totals(spark, d)
    last = t.agg(F.max("period").alias("period"))
    return t.join(F.broadcast(last), "period").orderBy(F.desc("v"), "dept").limit(10).select("dept", rounded("v", "value"))


@query("""with m as (select substr(period, 6, 2) as month, sum(v) filter (where y = 1997) as a, sum(v) filter (where y = 2001) as b from {totals} group by 1) select month, round(a, 6) as before, round(b, 6) as after, round(b - a, 6) as delta, round((b - a) / nullif(a, 0) * 100, 6) as percent from m where a is not null and b is not null""")
def year_over_year_pivot(spark, d):
    t = totals(spark, d).withColumn("month", F.substring("period", 6, 2))
    p = reshape.wide_form(t, ["month"], "y", "v", [1997, 2001], prefix="y").where("y1997 is not null and y2001 is not null")
    change = F.col("y2001") - F.col("y1997")
    return p.select("month", rounded("y1997", "before"), rounded("y2001", "after"), rounded(change, "delta"), rounded(change / F.nullif("y1997", F.lit(0.0)) * 100, "percent"))


@query("""select dept, code, y, round((v - avg(v) over w) / nullif(stddev_samp(v) over w, 0), 6) as z from {macro} window w as (partition by code, y)""")
def zscore_profile(spark, d):
    return macro(spark, d).select("dept", "code", "y", rounded(zscore("v", Window.partitionBy("code", "y")), "z"))


@query("""select dept, code, y, round(coalesce((v / nullif(lag(v) over w, 0) - 1) * 100, 0), 6) as percent from {macro} window w as (partition by dept, code order by y)""")
def pct_change_by_key(spark, d):
    return macro(spark, d).select("dept", "code", "y", rounded(windows.percent_change("v", ["dept", "code"], "y"), "percent"))


@query("""select dept, code, y, round(avg(v) over (partition by y, code), 6) as national, round(v - avg(v) over (partition by y, code), 6) as gap from {macro}""")
def national_means(spark, d):
    mean = F.avg("v").over(Window.partitionBy("y", "code"))
    return macro(spark, d).select("dept", "code", "y", rounded(mean, "national"), rounded(F.col("v") - mean, "gap"))


@query("""select n_regionkey as region_code, code, array_to_string(list_slice(list_sort(list(distinct n_name)), 1, 8), ' | ') as examples from {macro} join nation on dept = n_nationkey group by all""")
def label_examples(spark, d):
    return macro(spark, d).join(territories(spark, d), "dept").transform(aggregates.examples, ["region_code", "code"], "n_name")


@query("""select count(*)::bigint as n, count(distinct o_custkey)::bigint as customers, round(min(o_totalprice), 6) as lowest, round(max(o_totalprice), 6) as highest, round(sum(o_totalprice), 2) as total, round(avg(o_totalprice), 6) as mean, round(median(o_totalprice), 6) as median, round(100.0::double * avg(case when o_orderkey % 9 = 0 then 1 else 0 end), 2) as missing from orders""")
def kpi_summary(spark, d):
    v = F.col("o_totalprice")
    o = table(spark, d, "orders")
    median = ranks.percentiles(o, [], "o_totalprice", {"median": 0.5}).select(rounded("median"))
    figures = o.agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), rounded(F.min(v), "lowest"), rounded(F.max(v), "highest"), rounded(F.sum(v), "total", 2), rounded(F.avg(v), "mean"), rounded(F.avg(F.when(F.col("o_orderkey") % 9 == 0, 1).otherwise(0)) * 100, "missing", 2))
    return figures.crossJoin(F.broadcast(median))


@query("""with x as (select case when contains(p_name, 'red') then 'warm' when contains(p_name, 'blue') or contains(p_name, 'green') then 'cold' when contains(p_name, 'ring') then 'ring' else 'other' end as family, * from part)
select family, count(*)::bigint as n, count(distinct p_brand)::bigint as brands, count(distinct p_type)::bigint as types, round(sum(p_retailprice), 4) as total from x group by all""")
def family_rollup(spark, d):
    family = cascade(F.col("p_name"), [("red", "warm"), ("blue", "cold"), ("green", "cold"), ("ring", "ring")], "other")
    return table(spark, d, "part").groupBy(family.alias("family")).agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("brands"), F.count_distinct("p_type").alias("types"), rounded(F.sum("p_retailprice"), "total", 4))


@query("""with c as (select region_code, corr_x, corr_y from (select n_regionkey as region_code, y, avg(POP) as corr_x, avg(CHOM) as corr_y from {wide} join nation on dept = n_nationkey group by all)), e as (select region_code, count(*) as n, case when stddev_pop(corr_x) = 0 or stddev_pop(corr_y) = 0 then null else covar_pop(corr_x, corr_y) / (stddev_pop(corr_x) * stddev_pop(corr_y)) end as r from c group by all) select region_code, n::bigint as n, round(r, 6) as r from e""")
def correlation_matrix(spark, d):
    from territoria.functions.numbers import correlation

    rows = wide(spark, d).join(territories(spark, d), "dept").groupBy("region_code", "y").agg(F.avg("POP").alias("x"), F.avg("CHOM").alias("z"))
    return rows.groupBy("region_code").agg(F.count("*").alias("n"), rounded(correlation(F.col("x"), F.col("z")), "r"))


@query("""select dept, y, round(v, 6) as value from (select *, row_number() over (partition by dept order by period desc, v desc) as n from {totals}) where n = 1""")
def latest_value_per_territory(spark, d):
    return windows.first_by(totals(spark, d), ["dept"], "period", "v", descending=True).select("dept", "y", rounded("v", "value"))


@query("""with x as (select dept, period, v - lag(v) over (partition by dept order by period) as c from {totals}), p as (select dept, sum(v) filter (where period = '1998-02') - sum(v) filter (where period = '1998-01') as c from totals group by all)
select x.dept, round(x.c, 6) as by_lag, round(p.c, 6) as by_pivot from x join p using (dept) where period = '1998-02'""")
def previous_period_delta(spark, d):
    t = totals(spark, d)
    lagged = t.withColumn("by_lag", windows.change("v", ["dept"], "period")).where("period = '1998-02'")
    p = reshape.wide_form(t, ["dept"], "period", "v", ["1998-01", "1998-02"])
    return lagged.join(p, "dept").select("dept", rounded("by_lag"), rounded(F.col("`1998-02`") - F.col("`1998-01`"), "by_pivot"))


@query("""select o_orderkey, name, round(v, 6) as value from (select o_orderkey, unnest(['net', 'tax', 'total']) as name, unnest([o_totalprice * 0.8, o_totalprice * 0.2, o_totalprice]) as v from orders)""")
def fixed_indicator_zip(spark, d):
    p = F.col("o_totalprice")
    rows = table(spark, d, "orders").select("o_orderkey", F.array(p * 0.8, p * 0.2, p).alias("parsed"))
    return reshape.zipped(rows, ["o_orderkey"], "parsed", ["net", "tax", "total"]).select("o_orderkey", "name", rounded("value"))


@query("""with log as (select dept, y, row_number() over (partition by dept, y order by period) as version, case when v::bigint % 5 = 0 then null else v end as nv from {totals} where dept % 2 = 0), last as (select dept, y, nv from log where nv is not null qualify row_number() over (partition by dept, y order by version desc) = 1)
select w.dept, w.y, last.nv is not null as overridden, round(coalesce(last.nv, w.POP), 6) as value from {wide} w left join last using (dept, y)""")
def override_overlay(spark, d):
    t = totals(spark, d).where("dept % 2 = 0").withColumn("version", F.row_number().over(Window.partitionBy("dept", "y").orderBy("period")))
    log = t.select("dept", "y", "version", F.when(F.floor(F.round("v")).cast("long") % 5 == 0, None).otherwise(F.col("v")).alias("POP"))
    return overlaid(wide(spark, d).select("dept", "y", "POP"), log, ["dept", "y"], "POP", "version").select("dept", "y", "overridden", rounded("POP", "value"))


@query("""with a as (select o_orderkey as k, o_totalprice as v from orders where o_orderkey % 3 = 0), b as (select o_orderkey as k, -o_totalprice as v from orders where o_orderkey % 2 = 0) select k, round(v, 6) as value from b union all select k, round(v, 6) from a where k not in (select k from b)""")
def upsert_latest(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return upserted(o.where("k % 3 = 0"), o.where("k % 2 = 0").withColumn("v", -F.col("v")), ["k"]).select("k", rounded("v", "value"))


@query("""select o_orderkey as k, round(min(o_totalprice), 6) as value from orders where o_orderkey % 2 = 0 and o_orderkey % 3 <> 0 group by 1""")
def insert_if_absent(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    new = o.where("k % 2 = 0")
    return absent(new.unionByName(new), o.where("k % 3 = 0"), ["k"]).select("k", rounded("v", "value"))


@query("""with m as (select p_partkey, 'IND_' || lpad((p_partkey % 90)::varchar, 2, '0') as code, case when p_partkey % 4 = 0 then 'Label ' || (1990 + p_partkey % 30) else 'Label' end as label from part), once as (select code, label from m qualify row_number() over (partition by code order by p_partkey) = 1)
select code, label, case when regexp_matches(label, '(19|20)\\d{2}') then regexp_extract(label, '((19|20)\\d{2})', 1)::int else ('20' || regexp_extract(code, '(\\d{2})', 1))::int end as year from once""".replace("\\\\", "\\"))
def indicator_metadata_lookup(spark, d):
    k = F.col("p_partkey")
    m = table(spark, d, "part").select(k, F.concat(F.lit("IND_"), F.lpad((k % 90).cast("string"), 2, "0")).alias("code"), F.when(k % 4 == 0, F.concat(F.lit("Label "), (F.lit(1990) + k % 30).cast("string"))).otherwise("Label").alias("label"))
    return windows.first_by(m, ["code"], "p_partkey").select("code", "label", reference_year(F.col("label"), F.col("code")).alias("year"))


@query("""with y as (select distinct year(o_orderdate)::int as year from orders), i as (select distinct o_orderpriority as indicator from orders)
select year, printf('D%02d', n_nationkey) as dept, indicator, round((year - 1990) * 100 + n_nationkey * 10 + length(indicator), 6)::double as value from y cross join nation cross join i""")
def sample_grid(spark, d):
    """A made-up value for each year, department and indicator that the tables have."""
    o, n = table(spark, d, "orders"), table(spark, d, "nation")
    years, names = joins.different(o, F.year("o_orderdate")), joins.different(o, "o_orderpriority")
    grid = n.select(F.col("n_nationkey").alias("k"), years.alias("years"), names.alias("names")).select("k", "names", F.explode("years").alias("year")).select("k", "year", F.explode("names").alias("indicator"))
    return grid.select("year", F.format_string("D%02d", "k").alias("dept"), "indicator", rounded((F.col("year") - 1990) * 100 + F.col("k") * 10 + F.length("indicator"), "value"))


@query("select o_orderkey, null::varchar as region, null::double as note, o_orderstatus from orders where o_orderstatus = 'P'")
def schema_padding(spark, d):
    return reshape.padded_to(table(spark, d, "orders").where("o_orderstatus = 'P'"), {"o_orderkey": "long", "region": "string", "note": "double", "o_orderstatus": "string"})


@query("""select n_nationkey as dept, coalesce(case when n_nationkey % 4 = 0 then null else n_name end, n_nationkey::varchar) || ' (' || n_nationkey || ')' as label, r_name as region, case when n_nationkey % 4 = 0 then 'unnamed' else 'named' end as kind from nation join region on n_regionkey = r_regionkey""")
def flattened_levels(spark, d):
    name = F.when(F.col("dept") % 4 == 0, None).otherwise(F.col("n_name"))
    t = territories(spark, d).select("dept", F.struct(F.col("r_name").alias("name"), "region_code").alias("region"), name.alias("n"))
    return t.select("dept", label(F.col("n"), F.col("dept").cast("string")).alias("label"), F.col("region.name").alias("region"), F.when(F.col("n").isNull(), "unnamed").otherwise("named").alias("kind"))


@query("""select event_id, event_type, d.source, d.lang, round(value, 6) as value from events e join documents d on d.doc_id = e.event_id % (select count(*) from documents) join (select distinct event_type from events where event_type <> 'error') i using (event_type) where strftime(ts, '%Y-%m-%d') between '2024-01-05' and '2024-01-20'""")
def observation_listing(spark, d):
    e = table(spark, d, "events").where(F.date_format("ts", "yyyy-MM-dd").between("2024-01-05", "2024-01-20"))
    e = e.crossJoin(F.broadcast(table(spark, d, "documents").agg(F.count("*").alias("n")))).withColumn("doc_id", F.col("event_id") % F.col("n"))
    kinds = e.select("event_type").where("event_type <> 'error'").distinct()
    return e.join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id").join(kinds, "event_type").select("event_id", "event_type", "source", "lang", rounded("value"))


@query("""select rule, count(distinct code)::bigint as indicators from (select distinct p_type || '_' || p_size as code, case when p_size % 3 = 0 then 'mean' else 'sum' end as rule from part) group by rule""")
def rule_cardinality(spark, d):
    p = table(spark, d, "part").select(F.concat_ws("_", "p_type", "p_size").alias("code"), aggregation_rule(F.when(F.col("p_size") % 3 == 0, "taux").otherwise("nombre")).alias("rule"))
    return p.groupBy("rule").agg(F.count_distinct("code").alias("indicators"))


@query("""select 'orders' as name, count(*)::bigint as n from orders union all select 'customer', count(*) from customer union all select 'events', count(*) from events""")
def table_counts(spark, d):
    return reshape.stacked(*(table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("orders", "customer", "events")))


@query("""select p_partkey, round(p_retailprice * 1000 / nullif(p_size, 0), 6) as per_case, round(p_retailprice / 100, 6) as per_1000 from part where p_retailprice > 0 and p_size > 0""")
def unit_conversions(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("thousands"), F.col("p_size").cast("double").alias("cases"))
    return imports.mean_debt(p).select("p_partkey", rounded("value", "per_case"), rounded(F.col("thousands") / 100.0, "per_1000"))


@query("""with k as (select c_custkey, case when c_custkey % 25 = 20 then '2A' when c_custkey % 25 = 21 then '2B' when c_custkey % 25 = 22 then 'ZZ' else lpad((c_custkey % 25)::varchar, 2, '0') end as code from customer) select c_custkey, code, row_number() over (order by case when code in ('2A', '2B') then 20 when regexp_matches(code, '^[0-9]+$') then code::int else 999 end, code, c_custkey)::bigint as place from k""")
def custom_code_sort(spark, d):
    r = F.col("c_custkey") % 25
    code = F.when(r == 20, "2A").when(r == 21, "2B").when(r == 22, "ZZ").otherwise(F.lpad(r.cast("string"), 2, "0"))
    k = table(spark, d, "customer").select("c_custkey", code.alias("code"))
    rank = F.when(F.col("code").isin("2A", "2B"), 20).otherwise(F.coalesce(F.when(F.col("code").rlike("^[0-9]+$"), F.col("code").try_cast("int")), F.lit(999)))
    return ranks.places(k.withColumn("rank", rank), ["rank", "code"], "c_custkey").select("c_custkey", "code", "place")


@query("select 'x:' || p_brand as key, count(*)::bigint as n from part group by 1")
def indicator_keys(spark, d):
    return table(spark, d, "part").groupBy(indicator_key(F.lit("x"), F.col("p_brand")).alias("key")).agg(F.count("*").alias("n"))


@query("""select dept, y, coalesce(a, false) or coalesce(b, false) as flagged from (select dept, y, case when dept % 3 = 0 then null else POP > 2000 end as a, case when dept % 2 = 0 then null else CHOM > 60 end as b from {wide}) where coalesce(a, false) or coalesce(b, false)""")
def any_flag(spark, d):
    w = wide(spark, d).select("dept", "y", F.when(F.col("dept") % 3 == 0, None).otherwise(F.col("POP") > 2000).alias("a"), F.when(F.col("dept") % 2 == 0, None).otherwise(F.col("CHOM") > 60).alias("b"))
    flag = joins.either(F.col("a"), F.col("b"))
    return w.where(flag).select("dept", "y", flag.alias("flagged"))
