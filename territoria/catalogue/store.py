"""Answers over the store, reports and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from territoria import serving
from territoria.catalogue.registry import configs, macro, monthly, observed, query, rounded, table, territories, totals
from territoria.functions import dates
from territoria.operators import reshape
from territoria.plans import analysis, governance, reports, scoring
from territoria.reference_data import DEPARTMENTS, SCENARIOS, SCORE_MODEL


def _store(spark, d):
    m = monthly(spark, d).select(F.col("dept").cast("string").alias("department_code"), F.col("indicator").alias("indicator_code"), F.col("period").alias("reference_period"), F.col("v").alias("value"))
    w = macro(spark, d).select(F.col("dept").cast("string").alias("department_code"), F.col("code").alias("indicator_code"), F.col("y").alias("reference_year"), F.col("v").alias("value"))
    return {"deposits": m, "macro": w}


@query("select n_nationkey::varchar as department_code, n_name as department_name, r_name as region_name from nation join region on n_regionkey = r_regionkey where r_name = 'EUROPE' order by n_nationkey::varchar limit 3 offset 1")
def department_listing(spark, d):
    dim = territories(spark, d).select(F.col("dept").cast("string").alias("department_code"), F.col("n_name").alias("department_name"), F.col("r_name").alias("region_name"))
    return serving.departments(dim, "EUROPE", 3, 1)


@query("select 'insee:' || p_type as indicator_key, 'insee' as source_system, p_type as indicator_code, min(p_type) as indicator_name, min(p_brand) as indicator_group from part where contains(lower(p_type), 'm') group by p_type order by 1 limit 20")
def indicator_listing(spark, d):
    dim = table(spark, d, "part").groupBy(F.col("p_type").alias("indicator_code")).agg(F.min("p_brand").alias("indicator_group"))
    dim = dim.select(F.concat(F.lit("insee:"), "indicator_code").alias("indicator_key"), F.lit("insee").alias("source_system"), "indicator_code", F.col("indicator_code").alias("indicator_name"), "indicator_group")
    return serving.indicators(dim, "insee", None, "M", 20)


@query("""select 'deposits' as kind, dept::varchar as department_code, indicator as indicator_code, period as time, round(v, 6) as value from {monthly} where dept = 7 and period between '1997-03' and '1997-09' order by period, indicator limit 20""")
def deposit_facts(spark, d):
    return serving.facts(_store(spark, d), "deposits", "7", None, "1997-03", "1997-09", 20).withColumn("value", rounded("value"))


@query("""select 'macro' as kind, dept::varchar as department_code, code as indicator_code, y::varchar as time, round(v, 6) as value from {macro} where code = 'POP' and y >= 2000 order by time, department_code limit 30""")
def macro_facts(spark, d):
    return serving.facts(_store(spark, d), "macro", None, "POP", 2000, None, 30).withColumn("value", rounded("value"))


@query("""select y as reference_year, n_regionkey as region_code, code as indicator_code, round(sum(v), 6) as value from {macro} join nation on dept = n_nationkey where n_regionkey = 2 and code = 'ACT' group by all order by y limit 5 offset 1""")
def region_macro_listing(spark, d):
    view = macro(spark, d).join(territories(spark, d), "dept").groupBy(F.col("y").alias("reference_year"), "region_code", F.col("code").alias("indicator_code")).agg(F.sum("v").alias("value"))
    return serving.region_macro(view, 2, "ACT", None, 5, 1).select("reference_year", "region_code", "indicator_code", rounded("value"))


@query("""select t.period as period, t.dept as code, n_name as name, n_name as label, round(t.v, 6) as deposits, round(w.POP, 6) as population from {totals} t join nation on t.dept = n_nationkey left join {wide} w on w.dept = t.dept and w.y = t.y where t.period = '1998-04' order by t.dept limit 40""".replace("order by t.dept limit 40", ""))
def dashboard_listing(spark, d):
    """The joined view under a dashboard's names, one column under two of them."""
    joined = totals(spark, d).withColumnRenamed("period", "reference_period").join(territories(spark, d), "dept").join(macro(spark, d).where("code = 'POP'").select("dept", "y", F.col("v").alias("macro_population")), ["dept", "y"], "left")
    joined = joined.withColumn("v", rounded("v")).withColumn("macro_population", rounded("macro_population"))
    return serving.dashboard(joined, {"code": "dept", "period": "reference_period", "name": "n_name", "label": "n_name", "deposits": "v", "population": "macro_population"}, "1998-04", 40)


@query("""select event_id as id, 'department' as level, (user_id % 25)::varchar as code, strftime(ts, '%Y-%m') as period, event_type as indicator, round(value, 6) as value, 'u' as unit, source as title, lang as url from events left join documents on doc_id = event_id where event_type = 'purchase' and user_id % 25 = 3 order by event_id limit 25""")
def observation_page(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.lit("department").alias("level"), (F.col("user_id") % 25).cast("string").alias("code"), F.date_format("ts", "yyyy-MM").alias("period"), F.col("event_type").alias("indicator"), rounded("value"), F.lit("u").alias("unit"), F.col("event_id").alias("document_id"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("title"), F.col("lang").alias("url"))
    return serving.observations(e, docs, "department", "3", "purchase", None, 25)


def _scores(spark, d):
    return scoring.scores(observed(spark, d), configs(spark)).withColumn("model", F.lit("default"))


def _details(spark, d):
    return scoring.details(scoring.picked(observed(spark, d), configs(spark)), configs(spark)).withColumn("model", F.lit("default"))


@query("""with d as (select period, code, indicator, normalized * weight / available * 100 as c from {detail}), t as (select period, code, count(*)::bigint as n, arg_max(indicator, c) as first from d group by all)
select s.period, s.code, '1.0' as version, round(score, 6) as score, n, first from {scored} s left join t using (period, code) where s.code in ('4', '22') and s.period = '2024-01'""")
def score_with_details(spark, d):
    """A territory's score with its model and its parts, the largest first."""
    models = spark.createDataFrame([("default", "1.0"), ("other", "2.0")], "model string, version string")
    two = _scores(spark, d).where(F.col("code").isin("4", "22"))
    out = serving.score_of(two, _details(spark, d), models, "default", "department", None, "2024-01")
    return out.select("period", "code", "version", rounded("score"), F.when(F.col("details").isNotNull(), F.size("details")).cast("long").alias("n"), F.get("details", F.lit(0))["indicator"].alias("first"))


@query("""select period, code, round(score, 6) as score from {scored} where period = '2024-02' and score is not null and coverage >= 0.9""")
def score_filters(spark, d):
    return serving.latest_scores(_scores(spark, d), "department", None, None, "2024-02", True, 0.9).select("period", "code", rounded("score"))


@query("""select p.period, p.code, p.indicator, p.id as observation_id, d.source as title, round(normalized * weight / available * 100, 6) as contribution from {detail} p join documents d on d.doc_id = p.id""")
def score_provenance(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("title"), F.col("lang").alias("url"))
    parts = _details(spark, d).select("period", "code", "indicator", F.col("id").alias("observation_id"), "contribution")
    rows = observed(spark, d).select("id", F.col("id").alias("document_id"), "unit", "confidence")
    return serving.provenance(parts, rows, docs).select("period", "code", "indicator", "observation_id", "title", rounded("contribution"))


@query("select 'orders' as name, count(*)::bigint as rows, 'ok' as status from orders union all select 'none', 0, 'empty' union all select 'absent', 0, 'missing'")
def store_health(spark, d):
    o = table(spark, d, "orders")
    return serving.health(spark, {"orders": o, "none": o.limit(0)}, ["orders", "none", "absent"])


@query("""with x as (select event_type as status, count(*) as n from events group by 1), l as (select event_type as status from events order by ts desc, event_type desc limit 1)
select 'last_run' as name, status as value from l union all select 'documents:' || coalesce(lang, 'unknown'), count(*)::varchar from documents group by lang union all select 'observations', count(*)::varchar from events union all select 'latest_period', max(strftime(ts, '%Y-%m')) from events union all select 'territories', count(distinct user_id)::varchar from events""")
def observability_report(spark, d):
    e = table(spark, d, "events")
    runs = e.select(F.struct("ts", "event_type").alias("at"), F.col("event_type").alias("status"))
    return serving.observability(runs, table(spark, d, "documents").select(F.col("lang").alias("status")), e.select(F.date_format("ts", "yyyy-MM").alias("period"), F.col("user_id").alias("code")))


@query("""with r as (select c_nationkey::varchar as departement_code, case when o_orderkey % 9 = 0 then null else o_orderpriority end as indicator_code, strftime(o_orderdate, '%Y-%m') as reference_period, case when o_orderkey % 8 = 0 then null else o_totalprice end as value, o_orderkey % 1000 as k from orders join customer on o_custkey = c_custkey where c_nationkey <> 9)
select count(*)::bigint as rows, count(distinct departement_code)::bigint as departments, count(*) filter (where indicator_code is null)::bigint as unknown_indicators, count(*) filter (where value is null)::bigint as without_value, min(reference_period) as first_period, max(reference_period) as last_period,
(select count(*) from nation where n_nationkey::varchar not in (select departement_code from r))::bigint as missing_departments, (select sum(n - 1) from (select count(*) as n from r group by departement_code, k))::bigint as duplicates, false as complete from r""")
def validation_summary(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").where("c_nationkey <> 9"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    rows = o.select(F.col("c_nationkey").cast("string").alias("departement_code"), F.when(k % 9 != 0, F.col("o_orderpriority")).alias("indicator_code"), F.date_format("o_orderdate", "yyyy-MM").alias("reference_period"), F.when(k % 8 != 0, F.col("o_totalprice")).alias("value"), (k % 1000).alias("k"))
    known = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("departement_code"))
    return reports.validation_summary(rows, known, 25, ["departement_code", "k"])


@query("""select case when t = 'returned' then 'error' else 'warning' end as severity, t as name, n from (select 'returned' as t, count(*) filter (where l_returnflag = 'R')::bigint as n from lineitem union all select 'open', count(*) filter (where l_linestatus = 'O')::bigint from lineitem union all select 'negative', count(*) filter (where l_quantity < 0)::bigint from lineitem) where n > 0""")
def observability_alerts(spark, d):
    one = table(spark, d, "lineitem").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_linestatus") == "O").alias("open"), F.count_if(F.col("l_quantity") < 0).alias("negative"))
    return reports.alerts(one.unpivot([], one.columns, "name", "n"), {"returned": "error"})


@query("""with s as (select code, score from {scored} where period = '2024-01' and score is not null), c as (select (user_id % 25)::varchar as code, event_type as indicator, avg(value) as v from events group by all), j as (select * from s join c using (code)),
r as (select indicator, score, v, rank() over (partition by indicator order by score) + (count(*) over (partition by indicator, score) - 1) / 2.0::double as a, rank() over (partition by indicator order by v) + (count(*) over (partition by indicator, v) - 1) / 2.0::double as b from j)
select indicator, count(*)::bigint as n, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) as spearman, round(covar_pop(score, v) / nullif(stddev_pop(score) * stddev_pop(v), 0), 6) as pearson from r group by indicator""")
def score_validation_report(spark, d):
    outside = table(spark, d, "events").groupBy((F.col("user_id") % 25).cast("string").alias("code"), F.col("event_type").alias("indicator")).agg(F.avg("value").alias("value")).withColumn("period", F.lit("2024-01"))
    return reports.score_validation(_scores(spark, d).where("period = '2024-01'"), outside).select("indicator", "n", rounded("spearman"), rounded("pearson"))


#: The score's six indicators and three scenarios over six measures of each nation's parts of the orders.
MEASURES = "select c_nationkey::varchar as code, unnest(['dossiers_per_1000', 'unemployment_rate', 'poverty_rate', 'median_income', 'mean_debt', 'inflation']) as indicator, unnest([count(*), avg(o_totalprice), count(distinct o_custkey), min(o_totalprice), max(o_totalprice), sum(o_totalprice)]::double[]) as v from orders join customer on o_custkey = c_custkey group by c_nationkey"
SCENARIO_ROWS = ", ".join(f"('{s}', '{i}', {w}::double, '{direction}')" for s, weights in SCENARIOS.items() for (i, _, direction), w in zip(SCORE_MODEL, weights, strict=True))
SENSITIVITY = f"""m as ({MEASURES}), l as (select indicator, quantile_cont(v, 0.05) as lo, quantile_cont(v, 0.95) as hi from m group by 1), w(scenario, indicator, weight, direction) as (values {SCENARIO_ROWS}),
n as (select scenario, code, weight, case when lo = hi then 0.5::double when direction = 'negative' then 1 - least(greatest((v - lo) / nullif(hi - lo, 0), 0), 1) else least(greatest((v - lo) / nullif(hi - lo, 0), 0), 1) end as x from m join l using (indicator) join w using (indicator)),
s as (select scenario, code, sum(x * weight) / sum(weight) * 100 as score from n group by all), p as (select *, rank() over (partition by scenario order by round(score, 9) desc) as place from s),
j as (select p.scenario, p.code, p.score, p.place::bigint as place, p.score - b.score as delta, (p.place - b.place)::bigint as moved from p join p b on b.code = p.code and b.scenario = 'baseline')"""


def _sensitivity(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    v, names = F.col("o_totalprice"), [i for i, _, _ in SCORE_MODEL]
    wide = o.groupBy(F.col("c_nationkey").cast("string").alias("code")).agg(*(x.cast("double").alias(n) for n, x in zip(names, (F.count("*"), F.avg(v), F.count_distinct("o_custkey"), F.min(v), F.max(v), F.sum(v)), strict=True)))
    values = wide.unpivot(["code"], names, "indicator", "value")
    limits = governance.reference_bounds(values.withColumn("period", F.lit("x")), ["x"])
    rows = [(s, i, float(w), direction) for s, weights in SCENARIOS.items() for (i, _, direction), w in zip(SCORE_MODEL, weights, strict=True)]
    return reports.sensitivity(values, limits, spark.createDataFrame(rows, "scenario string, indicator string, weight double, direction string"))


@query(f"with {SENSITIVITY} select scenario, code, round(score, 6) as score, place, round(delta, 6) as delta, moved from j")
def sensitivity_rows(spark, d):
    return _sensitivity(spark, d).select("scenario", "code", rounded("score"), "place", rounded("delta"), "moved")


@query(f"with {SENSITIVITY} select scenario, count(*)::bigint as territories, round(avg(abs(delta)), 6) as mean_abs_delta, round(max(abs(delta)), 6) as max_abs_delta, count(*) filter (where moved <> 0)::bigint as moved from j group by scenario")
def sensitivity_summary(spark, d):
    return reports.sensitivity_summary(_sensitivity(spark, d)).select("scenario", "territories", rounded("mean_abs_delta"), rounded("max_abs_delta"), "moved")


WHITELIST = ", ".join(f"'{x}'" for x in DEPARTMENTS)


@query(f"select code, count(*)::bigint as n from (select case when c_custkey % 120 = 20 then '2A' when c_custkey % 120 = 100 then '2B' else printf('%02d', c_custkey % 120) end as code from customer) where code in ({WHITELIST}) group by 1")
def metropolitan_whitelist(spark, d):
    k = F.col("c_custkey") % 120
    code = F.when(k == 20, "2A").when(k == 100, "2B").otherwise(F.format_string("%02d", k))
    return table(spark, d, "customer").select(code.alias("code")).where(F.col("code").isin(DEPARTMENTS)).groupBy("code").agg(F.count("*").alias("n"))


@query("""with x as (select n_regionkey as region_code, code, avg(v) as v from {macro} join nation on dept = n_nationkey group by all) select region_code, round(max(v) filter (where code = 'POP'), 6) as mean_POP, round(max(v) filter (where code = 'ACT'), 6) as mean_ACT, round(max(v) filter (where code = 'CHOM'), 6) as mean_CHOM from x group by 1""")
def region_mean_matrix(spark, d):
    x = macro(spark, d).join(territories(spark, d), "dept").groupBy("region_code", "code").agg(F.avg("v").alias("v"))
    return reshape.matrix(x, ["region_code"], "code", "v", ["POP", "ACT", "CHOM"], "mean_").select("region_code", *(rounded(f"mean_{c}") for c in ("POP", "ACT", "CHOM")))


@query("""with a as (select n_regionkey as region_code, sum(v) filter (where y = 1996) as d96, sum(v) filter (where y = 1997) as d97 from {totals} join nation on dept = n_nationkey group by 1), b as (select n_regionkey as region_code, sum(POP) as pop from {wide} join nation on dept = n_nationkey where y = 1997 group by 1)
select region_code, round(d96, 6) as d96, round(d97, 6) as d97, round(pop, 6) as pop from a join b using (region_code)""")
def joined_pivots(spark, d):
    t = territories(spark, d)
    a = reshape.wide_form(totals(spark, d).join(t, "dept"), ["region_code"], "y", "v", [1996, 1997], prefix="d").select("region_code", F.col("d1996").alias("d96"), F.col("d1997").alias("d97"))
    b = reshape.wide_form(macro(spark, d).where("y = 1997").join(t, "dept"), ["region_code"], "code", "v", ["POP"]).withColumnRenamed("POP", "pop")
    return a.join(b, "region_code").select("region_code", rounded("d96"), rounded("d97"), rounded("pop"))


@query("""with m as (select dept, y, POP, ACT, CHOM from {wide}) select x || '/' || z as pair, round(case when x = 'POP' then corr(POP, b) else corr(ACT, b) end, 6) as r from (select 'POP' as x, 'v' as z, POP, ACT, v as b from m join (select dept, y, sum(v) as v from {totals} group by all) t using (dept, y) union all select 'ACT', 'v', POP, ACT, v from m join (select dept, y, sum(v) as v from totals group by all) t using (dept, y) union all select 'POP', 'CHOM', POP, ACT, CHOM from m union all select 'ACT', 'CHOM', POP, ACT, CHOM from m) group by x, z""")
def cross_correlations(spark, d):
    """Correlations of each measure of one block with each of another, pairs without nulls only."""
    w = reshape.wide_form(macro(spark, d), ["dept", "y"], "code", "v", ["POP", "ACT", "CHOM"])
    t = totals(spark, d).groupBy("dept", "y").agg(F.sum("v").alias("v"))
    rows = w.join(t, ["dept", "y"], "left")
    one = rows.agg(*(governance.correlation(F.col(a), F.col(b)).alias(f"{a}/{b}") for a in ("POP", "ACT") for b in ("v", "CHOM")))
    return one.unpivot([], one.columns, "pair", "r").select("pair", rounded("r"))


@query("""select period, round(100.0::double * avg(case when v < 100000 then 1 else 0 end), 2) as small_share, printf('%+.1f', sum(v) / 1000000 - 20) as shown from (select period, v from {totals}) group by 1""")
def quality_percentages(spark, d):
    t = totals(spark, d).groupBy("period").agg(F.round(F.avg((F.col("v") < 100000).cast("double")) * 100, 2).alias("small_share"), dates.signed(F.sum("v") / 1e6 - 20).alias("shown"))
    return t.select("period", rounded("small_share", digits=2), "shown")


@query("""with s as (select period, sum(v) as v from {totals} group by all), x as (select period, v - lag(v) over (order by period) as c from s) select period, round(c, 6) as change from x where abs(c) >= 1000000""")
def breaks_over_threshold(spark, d):
    from territoria.operators import windows

    s = totals(spark, d).groupBy("period").agg(F.sum("v").alias("v"))
    return windows.consecutive_change(s, "period", "v").where(F.abs("change") >= 1_000_000).select("period", rounded("change"))


@query("""with f as (select 'deposits_' || strftime(case when o_orderkey % 50 = 0 then o_orderdate + interval 40 day else o_orderdate end, '%Y%m') || '.pdf' as file, strftime(o_orderdate, '%Y-%m') as period from orders)
select file, max(period) as last_period from f where substr(file, 10, 2) = '20' and substr(file, 10, 4) || '-' || substr(file, 14, 2) <> period group by file""")
def source_period_last(spark, d):
    """Files of this century whose name tells another period than their rows, with the last such period."""
    from territoria.functions.periods import period_of_file

    o = table(spark, d, "orders")
    at = F.when(F.col("o_orderkey") % 50 == 0, F.col("o_orderdate") + F.expr("interval 40 days")).otherwise(F.col("o_orderdate"))
    o = o.select(F.concat(F.lit("deposits_"), F.date_format(at, "yyyyMM"), F.lit(".pdf")).alias("file"), F.date_format("o_orderdate", "yyyy-MM").alias("period")).distinct()
    return o.where(period_of_file(F.col("file")) != F.col("period")).groupBy("file").agg(F.max("period").alias("last_period"))


@query("""with t as (select period, dept, sum(v) as v from {totals} group by all), s as (select period, sum(v) as v from t group by all),
m as (select *, lag(v) over (order by period) as b, substr(period, 1, 4)::int * 12 + substr(period, 6, 2)::int - lag(substr(period, 1, 4)::int * 12 + substr(period, 6, 2)::int) over (order by period) = 1 as ok from s),
c as (select period, v, case when ok then b end as b, case when ok then v - b end as ch from m),
d as (select dept, v from t where period = (select max(period) from s)),
y as (select a.period, a.v, b.v as b from s a join s b on substr(a.period, 6, 2) = substr(b.period, 6, 2) where substr(a.period, 1, 4) = '1997' and substr(b.period, 1, 4) = '1996'),
o as (select 'summary' as section, 1 as place, min(period) || ' ' || max(period) as label, arg_max(v, period) as v, arg_min(v, period) as b, arg_max(v, period) - arg_min(v, period) as ch from s
union all select 'month', row_number() over (order by period), period, v, b, ch from c
union all select 'break', row_number() over (order by abs(ch) desc, period), period, v, b, ch from c where ch is not null qualify row_number() over (order by abs(ch) desc, period) <= 5
union all select 'department', row_number() over (order by v desc, dept), printf('%02d', dept) || ' ' || n_name, v, null, null from d join nation on n_nationkey = dept qualify row_number() over (order by v desc, dept) <= 10
union all select 'comparison', row_number() over (order by period), substr(period, 6, 2), v, b, v - b from y)
select section, place::int as place, label, round(v, 4) as value, round(b, 4) as before, round(ch, 4) as change, round(ch / nullif(b, 0) * 100, 6) as percent from o""")
def business_analysis(spark, d):
    """The analysis of deposits: months, the largest breaks, the largest departments, two years compared."""
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("dept"), F.col("n_name").alias("name"))
    t = totals(spark, d).groupBy("period", "dept").agg(F.sum("v").alias("value")).join(names, "dept").select("period", F.format_string("%02d", "dept").alias("code"), "name", "value")
    return analysis.business_analysis(t, (1996, 1997)).select("section", "place", "label", *(rounded(c, digits=4) for c in ("value", "before", "change")), rounded("percent"))


@query("""with f as (select dept, y, sum(v) as filings from {totals} where dept % 7 <> 3 group by all), m as (select dept, y, code, v from {macro}),
r as (select m.y as year, m.dept::varchar as code, m.code as indicator, case m.code when 'POP' then 'Population' when 'ACT' then 'ACT' else ' ' end as name, m.v as macro_value, coalesce(f.filings, 0) as filings from m left join f using (dept, y)),
x as (select *, lag(filings) over (partition by code, indicator order by year) as b from r)
select year, code, indicator, case when indicator = 'POP' then 'Population' else 'Indicateur INSEE non libellé (' || indicator || ')' end as macro_indicator_label, round(macro_value, 6) as macro_value, round(filings, 4) as filings,
round(avg(filings) over (partition by year), 4) as national_filings_mean, round(avg(macro_value) over (partition by year, indicator), 6) as national_macro_mean, round(coalesce((filings - b) / nullif(b, 0), 0) * 100, 6) as annual_change_pct from x""")
def dashboard_final(spark, d):
    """Macro indicators with filings, some without; an indicator without a name, and one whose name is its code."""
    f = totals(spark, d).where("dept % 7 <> 3").groupBy("dept", "y").agg(F.sum("v").alias("filings"))
    name = F.when(F.col("code") == "POP", "Population").when(F.col("code") == "ACT", "ACT").otherwise(" ")
    rows = macro(spark, d).join(f, ["dept", "y"], "left").select(F.col("y").alias("year"), F.col("dept").cast("string").alias("code"), F.col("code").alias("indicator"), name.alias("indicator_name"), F.col("v").alias("macro_value"), "filings")
    out = analysis.finalised(rows)
    return out.select("year", "code", "indicator", "macro_indicator_label", rounded("macro_value"), rounded("filings", digits=4), rounded("national_filings_mean", digits=4), rounded("national_macro_mean"), rounded("annual_change_pct"))
