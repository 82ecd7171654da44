"""Scores, their versions and their sensitivity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from territoria.catalogue.registry import configs, long, observed, query, rounded, table
from territoria.functions.numbers import scaled
from territoria.operators import aggregates, reshape, windows
from territoria.plans import governance, scoring


def _picked(spark, d):
    return scoring.picked(observed(spark, d), configs(spark))


def _details(spark, d):
    return scoring.details(_picked(spark, d), configs(spark))


def _scores(spark, d):
    return scoring.scores(observed(spark, d), configs(spark))


@query("select lvl as level, period, code, indicator, id, round(v, 6) as value from {picked}")
def best_observation_pick(spark, d):
    return _picked(spark, d).select("level", "period", "code", "indicator", "id", rounded("value"))


@query("""select case when isnan(v) then 'non_finite_value:' || indicator else 'incompatible_unit:' || indicator || ':expected=u:actual=' || unit end as warning, count(*)::bigint as n from {observed} where isnan(v) or unit <> 'u' group by 1""")
def score_warnings(spark, d):
    return scoring.gated(observed(spark, d), configs(spark)).where("warning is not null").groupBy("warning").agg(F.count("*").alias("n"))


@query("select period, indicator, round(min(v), 6) as lo, round(max(v), 6) as hi, count(*)::bigint as n from {picked} group by all")
def cohort_bounds_minmax(spark, d):
    return aggregates.bounds(_picked(spark, d), ["period", "indicator"], "value").select("period", "indicator", rounded("lo"), rounded("hi"), "n")


@query("select period, indicator, round(quantile_cont(v, 0.05), 6) as lo, round(quantile_cont(v, 0.95), 6) as hi, count(*)::bigint as n from {picked} group by all")
def cohort_bounds_winsorized(spark, d):
    return aggregates.bounds(_picked(spark, d), ["period", "indicator"], "value", winsorized=True).select("period", "indicator", rounded("lo"), rounded("hi"), "n")


@query("select period, code, indicator, round(normalized, 6) as normalized, round(weight / available, 6) as effective_weight, round(normalized * weight / available * 100, 6) as contribution from {detail}")
def score_details(spark, d):
    return _details(spark, d).select("period", "code", "indicator", rounded("normalized"), rounded("effective_weight"), rounded("contribution"))


RISK = "case when score < 20 then 'very_low' when score < 40 then 'low' when score < 60 then 'moderate' when score < 80 then 'high' when score is not null then 'very_high' end"
STATUS = "case when coverage < 0.6 then 'insufficient_data' when coverage >= 1 - 1e-12 then 'valid' else 'partial' end"


@query(f"select period, code, round(coverage, 6) as coverage, round(score, 6) as score, {RISK} as risk, {STATUS} as status from {{scored}}")
def territory_scores(spark, d):
    return _scores(spark, d).select("period", "code", rounded("coverage"), rounded("score"), "risk", "status")


@query("""select period, code, array_to_string(list_filter(['click', 'view', 'purchase', 'signup', 'error'], lambda x: not list_contains(coalesce(seen, []), x)), ',') as missing from {scored}""")
def score_missing_indicators(spark, d):
    return _scores(spark, d).select("period", "code", F.array_join("missing", ",").alias("missing"))


@query(f"select period, count(*) filter (where s = 'valid')::bigint as valid, count(*) filter (where s = 'partial')::bigint as partial, count(*) filter (where s = 'insufficient_data')::bigint as insufficient_data, count(*)::bigint as territories from (select *, {STATUS} as s from {{scored}}) group by all")
def score_summary_counters(spark, d):
    return scoring.summary(_scores(spark, d)).drop("level")


@query("select period, code, round(score, 6) as score, row_number() over (order by score desc nulls last, period, code)::bigint as place from {scored} order by place limit 30 offset 5")
def score_listing_nulls_last(spark, d):
    order = [F.col("score").desc_nulls_last(), F.col("period"), F.col("code")]
    page = reshape.page(_scores(spark, d).select("period", "code", "score"), order, 30, 5)
    return page.select("period", "code", rounded("score"), long(F.row_number().over(Window.orderBy(*order)) + 5, "place"))  # over the page's rows


@query("select code, period, round(score, 6) as score, round(score - lag(score) over (partition by code order by period), 6) as change from {scored} where code in ('1', '7', '16')")
def score_series(spark, d):
    rows = _scores(spark, d).where(F.col("code").isin("1", "7", "16"))
    return rows.select("code", "period", rounded("score"), rounded(windows.change("score", ["code"], "period"), "change"))


@query("select period, code, indicator, place::bigint as place, round(c, 6) as contribution from (select *, normalized * weight / available * 100 as c, row_number() over (partition by period, code order by normalized * weight / available * 100 desc, indicator) as place from {detail}) where place <= 2")
def score_factors(spark, d):
    place = F.row_number().over(Window.partitionBy("period", "code").orderBy(F.col("contribution").desc(), "indicator"))
    return _details(spark, d).withColumn("place", long(place, "place")).where("place <= 2").select("period", "code", "indicator", "place", rounded("contribution"))


VERSIONS = "a as (select code, period, score as a from {scored} where score is not null), b as (select code, period, round(avg(normalized) * 100, 6) as b from {detail} group by all), j as (select code, period, a, b, b - a as d, rank() over (partition by period order by a desc) + (count(*) over (partition by period, a) - 1) / 2.0::double as ra, rank() over (partition by period order by b desc) + (count(*) over (partition by period, b) - 1) / 2.0::double as rb from a join b using (code, period))"


def _versions(spark, d):
    a = _scores(spark, d).select("code", "period", "score")
    b = _details(spark, d).groupBy("code", "period").agg(rounded(F.avg("normalized") * 100, "score"))
    return governance.comparison_rows(a, b)


@query(f"with {VERSIONS} select period, code, round(a, 6) as score_a, round(b, 6) as score_b, round(d, 6) as delta, ra as rank_a, rb as rank_b from j")
def model_comparison_rows(spark, d):
    return _versions(spark, d).select("period", "code", rounded("score_a"), rounded("score_b"), rounded("delta"), "rank_a", "rank_b")


@query(f"with {VERSIONS} select count(*)::bigint as compared, round(covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0), 6) as spearman, round(avg(abs(d)), 6) as mean_abs_delta, round(max(abs(d)), 6) as max_abs_delta, count(*) filter (where ra <> rb)::bigint as rank_changes from j")
def model_comparison(spark, d):
    return governance.comparison(_versions(spark, d)).select("compared", rounded("spearman"), rounded("mean_abs_delta"), rounded("max_abs_delta"), "rank_changes")


@query("""with x as (select s.score, d.v from {scored} s join {picked} d on d.code = s.code and d.period = s.period and d.indicator = 'purchase' where score is not null), r as (select rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0::double as a, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0::double as b from x)
select count(*)::bigint as n, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) as spearman from r""")
def score_validation_spearman(spark, d):
    p = _picked(spark, d).where("indicator = 'purchase'").select("code", "period", "value")
    return governance.spearman(_scores(spark, d).where("score is not null").join(p, ["code", "period"]), "score", "value").select("n", rounded("spearman"))


@query("""with s as (select user_id::varchar as code, strftime(ts, '%Y-%m-%d') as period, avg(value) as score from events group by all), x as (select code, abs(score - lag(score) over (partition by code order by period)) as d from s) select code, round(avg(d), 6) as volatility from x group by code having avg(d) is not null order by avg(d) desc, code limit 10""")
def score_volatility_top10(spark, d):
    s = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("code"), F.date_format("ts", "yyyy-MM-dd").alias("period")).agg(F.avg("value").alias("score"))
    return governance.volatility(s).orderBy(F.desc("volatility"), "code").limit(10).select("code", rounded("volatility"))


@query("select period, code, round(avg(normalized) * 100, 6) as score from {detail} group by all")
def equal_weight_sensitivity(spark, d):
    return _details(spark, d).groupBy("period", "code").agg(rounded(F.avg("normalized") * 100, "score"))


@query("select indicator, round(quantile_cont(v, 0.05), 6) as lo, round(quantile_cont(v, 0.95), 6) as hi, count(*)::bigint as n from {observed} where not isnan(v) and unit = 'u' and period in ('2024-01', '2024-02') group by 1")
def reference_bounds(spark, d):
    rows = scoring.gated(observed(spark, d), configs(spark)).where("warning is null")
    return governance.reference_bounds(rows, ["2024-01", "2024-02"]).select("indicator", rounded("lo"), rounded("hi"), "n")


@query("""with b as (select indicator, quantile_cont(v, 0.05) as lo, quantile_cont(v, 0.95) as hi from {observed} where not isnan(v) and unit = 'u' group by 1), f as (select code, indicator, v from {picked} where period = '2024-01'),
s(scenario, indicator, w) as (select 'baseline', indicator, weight from configs union all select 'equal', indicator, 0.2::double from configs)
select scenario, code, round(sum(case when lo = hi then 0.5::double when direction = 'negative' then 1 - least(greatest((v - lo) / (hi - lo), 0), 1) else least(greatest((v - lo) / (hi - lo), 0), 1) end * w) / sum(w) * 100, 6) as score from f join b using (indicator) join s using (indicator) join {configs} c using (indicator) group by all""")
def weight_scenarios(spark, d):
    rows = scoring.gated(observed(spark, d), configs(spark)).where("warning is null")
    limits = governance.reference_bounds(rows, ["2024-01", "2024-02"])
    c = configs(spark).select("indicator", "weight", "direction")
    scenarios = c.withColumn("scenario", F.lit("baseline")).unionByName(c.withColumn("scenario", F.lit("equal")).withColumn("weight", F.lit(0.2)))
    values = _picked(spark, d).where("period = '2024-01'").select("code", "indicator", "value")
    return governance.scenario_scores(values, limits, scenarios, scaled).select("scenario", "code", rounded("score"))


@query("""with x as (select period, code, list(indicator) as have from {detail} group by all) select period, code from x where list_contains(have, 'click') and list_contains(have, 'error')""")
def required_indicator_filter(spark, d):
    have = _details(spark, d).groupBy("period", "code").agg(F.collect_set("indicator").alias("have"))
    return have.where(F.size(F.array_except(F.array(F.lit("click"), F.lit("error")), "have")) == 0).select("period", "code")


@query("""select period, code, to_json(list({'place': place, 'indicator': indicator, 'weight': printf('%.2f', weight)} order by place)) as details
from (select period, code, indicator, weight, row_number() over (partition by period, code order by round(normalized * weight / available * 100, 6) desc, indicator) as place from {detail}) group by all""")
def nested_documents(spark, d):
    parts = _details(spark, d).withColumn("k", -F.round("contribution", 6))
    nested = reshape.nested(parts, ["period", "code"], ["k", "indicator"], ["weight"])
    rows = F.transform("details", lambda x, k: F.struct((k + 1).alias("place"), x["indicator"].alias("indicator"), F.format_string("%.2f", x["weight"]).alias("weight")))
    return nested.select("period", "code", F.to_json(rows).alias("details"))


@query("""with w as (select p_brand as model, p_type as indicator, count(*) as n, min(p_size) as floor from part group by all), o as (select *, row_number() over (partition by model order by n desc, indicator) as ord from w)
select model, min(floor) / 100.0::double as floor, count(*)::bigint as n, to_json(list({'ord': ord, 'indicator': indicator, 'weight': n, 'direction': case when ord % 2 = 0 then 'negative' else 'positive' end} order by ord)) as configs from o group by model""")
def model_with_configs(spark, d):
    """A model for each brand, with the types of its parts as indicators by how many there are, and settings as JSON."""
    w = table(spark, d, "part").groupBy(F.col("p_brand").alias("model"), F.col("p_type").alias("indicator")).agg(F.count("*").alias("weight"), F.min("p_size").alias("least"))
    ord_ = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("weight"), "indicator"))
    c = w.withColumn("ord", ord_.cast("long")).withColumn("direction", F.when(F.col("ord") % 2 == 0, "negative").otherwise("positive"))
    c = c.withColumn("settings", F.to_json(F.struct((F.min("least").over(Window.partitionBy("model")) / 100.0).alias("floor"))))
    one = reshape.nested(c, ["model", "settings"], ["ord", "indicator"], ["weight", "direction"], "configs")
    return one.select("model", F.from_json("settings", "floor double")["floor"].alias("floor"), F.size("configs").cast("long").alias("n"), F.to_json("configs").alias("configs"))


@query(f"""with t as (select period, code, string_agg(printf('%s (%.1f)', indicator, c), ', ' order by c desc, indicator) as words from (select period, code, indicator, normalized * weight / available * 100 as c, row_number() over (partition by period, code order by normalized * weight / available * 100 desc, indicator) as n from {{detail}}) where n <= 3 group by all)
select period, code, printf('Score %.1f (%s), mainly from %s.', score, {RISK}, words) as text from {{scored}} join t using (period, code) where score is not null""")
def score_narrative(spark, d):
    s = _scores(spark, d).where("score is not null")
    return scoring.explained(s, _details(spark, d), 3).select("period", "code", "text")
