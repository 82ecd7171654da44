"""Quality, completeness and observability."""

from __future__ import annotations

from pyspark.sql import functions as F

from territoria.catalogue.registry import monthly, query, rounded, table, territories, totals, wide
from territoria.functions.numbers import parsed
from territoria.functions.periods import months_between, period_of_file
from territoria.functions.text import token_set
from territoria.operators import aggregates, joins, windows
from territoria.plans import conformed, gates, imports, quality, reports, star


@query("""with p as (select distinct strftime(ts, '%Y-%m-%d') as period from events), h as (select distinct user_id % 25 as dept, strftime(ts, '%Y-%m-%d') as period from events where event_type = 'signup') select n_nationkey as dept, p.period from nation cross join p where not exists (select 1 from h where h.dept = n_nationkey and h.period = p.period)""")
def missing_region_months(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 25).cast("int").alias("dept"), F.date_format("ts", "yyyy-MM-dd").alias("period"), "event_type")
    return joins.missing_pairs(table(spark, d, "nation").select(F.col("n_nationkey").alias("dept")), e.select("period").distinct(), e.where("event_type = 'signup'").select("dept", "period"))


@query("""select y, array_to_string(list_sort(list_filter(range(1, 13), lambda m: not list_contains(have, m))), ',') as missing from (select y, list(distinct month(o_orderdate)) as have from (select year(o_orderdate)::int as y, o_orderdate from orders where month(o_orderdate) <> 4 or year(o_orderdate) % 2 = 0) group by y) where len(have) < 12""")
def missing_months_per_year(spark, d):
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).where("m <> 4 or y % 2 = 0")
    return aggregates.missing_months(o, "y", "m").select("y", F.array_join(F.array_sort("missing"), ",").alias("missing"))


@query("""select m as month from (select month(o_orderdate)::int as m, year(o_orderdate) as y from orders where month(o_orderdate) <> 4 or year(o_orderdate) <> 1997) group by m having count(distinct y) = (select count(distinct year(o_orderdate)) from orders)""")
def common_months(spark, d):
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("month"))
    years = o.agg(F.count_distinct("y").alias("n"))
    return o.where("month <> 4 or y <> 1997").groupBy("month").agg(F.count_distinct("y").alias("have")).join(F.broadcast(years), F.col("have") == F.col("n")).select("month")


@query("select sum(n - 1)::bigint as duplicates, sum(n)::bigint as total from (select count(*) as n from lineitem group by l_suppkey, l_returnflag, l_quantity)")
def duplicate_business_keys(spark, d):
    return aggregates.duplicates(table(spark, d, "lineitem"), ["l_suppkey", "l_returnflag", "l_quantity"])


@query("""with x as (select count(*) filter (where o_orderkey % 7 = 0) as o_totalprice, count(*) filter (where o_custkey % 11 = 0) as o_orderdate from orders) select 'o_totalprice' as column_name, o_totalprice::bigint as nulls from x where o_totalprice > 0 union all select 'o_orderdate', o_orderdate from x where o_orderdate > 0""")
def null_counts(spark, d):
    o = table(spark, d, "orders")
    return aggregates.null_counts(o.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.col("o_totalprice")).alias("o_totalprice"), F.when(F.col("o_custkey") % 11 == 0, None).otherwise(F.col("o_orderdate")).alias("o_orderdate")))


@query("""select count(*) filter (where o_custkey % 5 = 0)::bigint as no_key, count(*) filter (where o_orderkey % 6 = 0)::bigint as no_value, count(*)::bigint as n from orders""")
def join_quality_counts(spark, d):
    o = table(spark, d, "orders").select(F.when(F.col("o_custkey") % 5 == 0, None).otherwise(F.col("o_custkey")).alias("k"), F.when(F.col("o_orderkey") % 6 == 0, None).otherwise(F.col("o_totalprice")).alias("v"))
    return o.agg(F.count_if(F.col("k").isNull()).alias("no_key"), F.count_if(F.col("v").isNull()).alias("no_value"), F.count("*").alias("n"))


@query("select source, count(*)::bigint as rows from documents group by source having count(*) <> 31")
def incomplete_sources(spark, d):
    return quality.incomplete(table(spark, d, "documents"), "source", 31)


@query("select indicator, count(*)::bigint as rows, count(distinct dept)::bigint as territories, min(period) as first_period, max(period) as last_period from {monthly} group by 1")
def freshness_report(spark, d):
    return quality.freshness(monthly(spark, d), "indicator", "period", "dept")


@query("select source, count(*)::bigint as documents, count(quality)::bigint as labelled, round(avg(quality), 4) as quality, count(*) filter (where toxic = 1)::bigint as toxic from documents left join labels using (doc_id) group by 1")
def status_rollup(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("documents"), F.count("quality").alias("labelled"), rounded(F.avg("quality"), "quality", 4), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query("select lang, count(*)::bigint as n, min(doc_id) as first_id, max(doc_id) as last_id from documents group by 1")
def version_rollup(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("select period, indicator, count(distinct dept)::bigint as territories, count(distinct dept) = 25 as passed from {monthly} group by all")
def completeness_gate(spark, d):
    return quality.gate(monthly(spark, d), ["period", "indicator"], "dept", 25)


@query("""select count(*) filter (where a <> b)::bigint as mismatches, count(*)::bigint as n from (select o_orderpriority as a, case when o_orderkey % 10 = 0 then 'x' else o_orderpriority end as b from orders join customer on o_custkey = c_custkey)""")
def indicator_mismatch(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    b = F.when(F.col("o_orderkey") % 10 == 0, "x").otherwise(F.col("o_orderpriority"))
    return o.agg(F.count_if(F.col("o_orderpriority") != b).alias("mismatches"), F.count("*").alias("n"))


@query("select doc_id, source from documents where source not in (select distinct source from documents where doc_id % 97 = 0)")
def ingest_only_new(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return docs.join(docs.where("doc_id % 97 = 0").select("source").distinct(), "source", "left_anti").select("doc_id", "source")


@query("select count(*)::bigint as kept, (select count(*) from customer)::bigint - count(*) as skipped from customer where c_nationkey in (select s_nationkey from supplier where s_acctbal > 5000)")
def universe_semijoin(spark, d):
    c = table(spark, d, "customer")
    known = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("c_nationkey")).distinct()
    kept = c.join(known, "c_nationkey", "left_semi").agg(F.count("*").alias("kept"))
    return kept.crossJoin(F.broadcast(c.agg(F.count("*").alias("n")))).select("kept", (F.col("n") - F.col("kept")).alias("skipped"))


@query("""with e as (select unnest(range(0, 30))::int as k), o as (select distinct s_nationkey + 2 as k from supplier) select k, 'missing' as status from e where k not in (select k from o) union all select k, 'unexpected' from o where k not in (select k from e)""")
def expected_vs_observed(spark, d):
    return joins.compared_sets(spark.range(30).select(F.col("id").cast("int").alias("k")), table(spark, d, "supplier").select((F.col("s_nationkey") + 2).alias("k")).distinct(), "k")


@query("""select file, strftime(o_orderdate, '%Y-%m') as period, count(*)::bigint as n from (select *, 'deposits_' || strftime(case when o_orderkey % 50 = 0 then o_orderdate + interval 40 day else o_orderdate end, '%Y%m') || '.pdf' as file from orders) where regexp_extract(file, '(20\\d{2})(0[1-9]|1[0-2])', 1) <> '' and regexp_extract(file, '(20\\d{2})(0[1-9]|1[0-2])', 1) || '-' || regexp_extract(file, '(20\\d{2})(0[1-9]|1[0-2])', 2) <> strftime(o_orderdate, '%Y-%m') group by all""".replace("\\\\", "\\"))
def source_period_mismatch(spark, d):
    o = table(spark, d, "orders")
    at = F.when(F.col("o_orderkey") % 50 == 0, F.col("o_orderdate") + F.expr("interval 40 days")).otherwise(F.col("o_orderdate"))
    o = o.select(F.concat(F.lit("deposits_"), F.date_format(at, "yyyyMM"), F.lit(".pdf")).alias("file"), F.date_format("o_orderdate", "yyyy-MM").alias("period"))
    return o.where(period_of_file(F.col("file")) != F.col("period")).groupBy("file", "period").agg(F.count("*").alias("n"))


@query("select text_id, n from (select max(doc_id) as text_id, count(*)::bigint as n from documents group by text)")
def document_dedupe_latest(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("k"), F.xxhash64("text").alias("k2")).agg(F.max("doc_id").alias("text_id"), F.count("*").alias("n")).select("text_id", "n")


@query("select o_orderkey, o_orderstatus from orders order by o_orderkey desc limit 20")
def last_runs(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderkey")).limit(20).select("o_orderkey", "o_orderstatus")


@query("""select strftime(m, '%Y-%m') as period from (select unnest(generate_series((select date_trunc('month', min(o_orderdate)) from orders), (select date_trunc('month', max(o_orderdate)) from orders), interval 1 month)) as m)""")
def month_sequence(spark, d):
    lim = table(spark, d, "orders").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM").alias("a"), F.date_format(F.max("o_orderdate"), "yyyy-MM").alias("b"))
    return lim.select(F.explode(months_between(F.col("a"), F.col("b"))).alias("period"))


@query("""with g as (select strftime(m, '%Y-%m') as period, r_name from (select unnest(generate_series(timestamp '2001-03-01', timestamp '2002-02-01', interval 1 month)) as m) cross join region), k as (select lower(replace(r_name, ' ', '-')) || '/' || period as url, period, 1 as pri from g union all select 'asia/2001-05', 'override', 0), o as (select url, period, row_number() over (partition by url order by pri desc) as n from k) select url, period from o where n = 1""")
def candidate_key_grid(spark, d):
    months = spark.range(1).select(F.explode(months_between(F.lit("2001-03"), F.lit("2002-02"))).alias("period"))
    g = months.crossJoin(F.broadcast(table(spark, d, "region"))).select(F.concat(F.lower(F.replace("r_name", F.lit(" "), F.lit("-"))), F.lit("/"), "period").alias("url"), "period", F.lit(1).alias("pri"))
    fixed = spark.createDataFrame([("asia/2001-05", "override", 0)], "url string, period string, pri int")
    return windows.first_by(g.unionByName(fixed), ["url"], "pri", descending=True).select("url", "period")


@query("""with t as (select p_partkey, list_distinct(string_split(lower(p_name), ' ')) as w from part), c as (select distinct p_name as cand, list_distinct(string_split(lower(p_name), ' ')) as cw from part) select p_partkey, cand, n::bigint as overlap, place::bigint as place from (select p_partkey, cand, len(list_intersect(w, cw)) as n, row_number() over (partition by p_partkey order by len(list_intersect(w, cw)) desc, cand) as place from t cross join c where len(list_intersect(w, cw)) > 0) where place <= 3""")
def candidate_ranking(spark, d):
    p = table(spark, d, "part")
    c = p.select(F.col("p_name").alias("cand")).distinct().withColumn("cw", token_set(F.col("cand")))
    return joins.best_matches(c.select(F.col("cand").alias("name"), F.col("cw").alias("w")), c, 3).join(p.select("p_partkey", F.col("p_name").alias("name")), "name").select("p_partkey", "cand", "overlap", "place")


@query("""select column_name, round(share, 6) as share from (select 'p_name' as column_name, 0.0::double as share union all select 'p_brand', 0.0 union all select 'size_text', 1.0 union all select 'mixed', (select avg(case when p_partkey % 3 = 0 then 0 else 1 end) from part))""")
def adaptive_role_stats(spark, d):
    p = table(spark, d, "part").select("p_name", "p_brand", F.col("p_size").cast("string").alias("size_text"), F.when(F.col("p_partkey") % 3 == 0, F.lit("12d")).otherwise(F.col("p_retailprice").cast("string")).alias("mixed"))
    return aggregates.numeric_shares(p, parsed).select("column_name", rounded("share"))


@query("select n_name, coalesce(round(v, 6), 0) as value from nation left join (select dept, sum(v) as v from {totals} where y = 1998 and dept % 5 <> 0 group by 1) on dept = n_nationkey")
def zero_filled(spark, d):
    v = totals(spark, d).where("y = 1998 and dept % 5 <> 0").groupBy("dept").agg(F.sum("v").alias("v"))
    return table(spark, d, "nation").join(v, F.col("n_nationkey") == F.col("dept"), "left").select("n_name", rounded(F.coalesce("v", F.lit(0.0)), "value"))


GATES = [("urgent_1996", "error", "1996", "1-URGENT", 25), ("urgent_1997", "error", "1997", "1-URGENT", 24), ("low_1996", "warning", "1996", "5-LOW", 26), ("urgent_2050", "error", "2050", "1-URGENT", 25), ("low_2051", "warning", "2051", "5-LOW", 25)]
GATES_SQL = ", ".join(f"('{n}', '{s}', '{y}', '{i}', {e})" for n, s, y, i, e in GATES)
CHECKS = f"""with w(name, severity, period, indicator, expected) as (values {GATES_SQL}),
c as (select y::varchar as period, indicator, count(distinct dept) as found from {{monthly}} group by all),
a as (select case when count(*) filter (where o_orderkey % 9 = 0) > 0 then 'error' end as severity, count(*) filter (where o_orderkey % 9 = 0) as n, count(*) filter (where o_totalprice < 0) as negative, count(*) filter (where o_orderkey % 7 = 0) as late from orders),
checks as (select name, severity, coalesce(found, 0)::bigint as found, expected::bigint as expected, case when found is null then 'missing' when found = expected then 'passed' else 'failed' end as status from w left join c using (period, indicator)
  union all select 'no_integrity_errors', 'error', (n > 0)::int + (negative > 0)::int, 0, case when (n > 0)::int + (negative > 0)::int = 0 then 'passed' else 'failed' end from a union all select 'late', 'warning', late, 0, 'failed' from a where late > 0)
"""


def _checks(spark, d):
    wanted = spark.createDataFrame(GATES, "name string, severity string, period string, indicator string, expected int")
    m = monthly(spark, d).select(F.col("y").cast("string").alias("period"), "indicator", F.col("dept").alias("code"))
    o = table(spark, d, "orders").agg(F.count_if(F.col("o_orderkey") % 9 == 0).alias("unknown"), F.count_if(F.col("o_totalprice") < 0).alias("negative"), F.count_if(F.col("o_orderkey") % 7 == 0).alias("late"))
    counts = o.unpivot([], ["unknown", "negative", "late"], "name", "n")
    return gates.coverage_checks(m, wanted).unionByName(gates.alert_checks(reports.alerts(counts, {"unknown": "error", "negative": "error"})))


@query(CHECKS + "select * from checks")
def quality_checks(spark, d):
    """Coverage of two years and two indicators, and alerts, as rows; a year that no order has is missing."""
    return _checks(spark, d)


@query(CHECKS + """select count(*) filter (where severity = 'error' and status <> 'passed') = 0 as passed, count(*)::bigint as checks, coalesce(string_agg(name, ',' order by name) filter (where severity = 'error' and status = 'failed'), '') as failed,
coalesce(string_agg(name, ',' order by name) filter (where severity = 'error' and status = 'missing'), '') as missing, coalesce(string_agg(name, ',' order by name) filter (where severity <> 'error' and status <> 'passed'), '') as warnings from checks""")
def quality_verdict(spark, d):
    one = gates.verdict(_checks(spark, d))
    return one.select("passed", "checks", *(F.array_join(c, ",").alias(c) for c in ("failed", "missing", "warnings")))


RATES = """rates as (select y as year, dept::varchar as code, round(POP / 7, 6) as value from {wide} where y between 1995 and 1999), months as (select distinct period from {totals} where y <= 1996),
obs as (select coalesce(period, year::varchar) as period, code, value from rates left join months on substr(period, 1, 4) = year::varchar),
keyed as (select *, sha256('department-rates-1|' || code || '|' || period || '|' || printf('%.6f', value)) as key from obs)"""


def _rates(spark, d):
    r = wide(spark, d).where("y between 1995 and 1999").select(F.col("y").alias("year"), F.col("dept").cast("string").alias("code"), F.round(F.col("POP") / 7, 6).alias("value")).join(table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name")), "code")
    rows = imports.replicated(r, totals(spark, d).where("y <= 1996").select("period").distinct(), "department-rates-1", "rate", "per 1000")
    return imports.imported(rows, rows.where(F.col("code").cast("int") % 3 == 0).select("key"))


@query(f"with {RATES} select period, code, n_name as name, 'rate' as indicator, value, 'per 1000' as unit, case when length(period) = 7 then 'annual_replicated_monthly' else 'annual' end as observation_type, key, case when code::int % 3 = 0 then 'unchanged' else 'inserted' end as status from keyed join nation on n_nationkey = code::int")
def department_rate_import(spark, d):
    """Annual rates at the months of their year, or at the year; a third of the keys is there already."""
    return _rates(spark, d).select("period", "code", "name", "indicator", "value", "unit", "observation_type", "key", "status")


@query(f"with {RATES} select count(distinct code)::bigint as departments, count(*) filter (where code::int % 3 <> 0)::bigint as inserted, count(*) filter (where code::int % 3 = 0)::bigint as unchanged from keyed join nation on n_nationkey = code::int")
def department_import_report(spark, d):
    return imports.import_report(_rates(spark, d))


@query("""with l as (select year(o_orderdate)::int as year, case when c_nationkey % 4 = 3 then 'Region ' || c_nationkey else c_nationkey::varchar end as region, case o_orderpriority when '1-URGENT' then 'filed' when '5-LOW' then 'accepted' else 'other' end as indicator_name, case when o_orderkey % 50 = 0 then 'nan'::double else o_totalprice end as value from orders join customer on o_custkey = c_custkey),
o as (select year::varchar as period, lpad(region, 2, '0') as code, case indicator_name when 'filed' then 'dossiers_deposes' else 'dossiers_recevables' end as indicator, max(value) as value from l where regexp_matches(region, '^[0-9]{1,2}$') and not isnan(value) and indicator_name <> 'other' and region::int % 5 <> 4 group by all)
select code, n_name as name, indicator, period, round(value, 6) as value, sha256('income-1|department|' || code || '|' || period || '|' || indicator || '|' || printf('%.6f', value)) as key, 'inserted' as status from o join nation on n_nationkey = code::int""")
def legacy_observations(spark, d):
    """Old rows of which some name a region, some have no number, some an indicator that nothing replaces."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    region = F.when(F.col("c_nationkey") % 4 == 3, F.concat(F.lit("Region "), F.col("c_nationkey").cast("string"))).otherwise(F.col("c_nationkey").cast("string"))
    name = F.when(F.col("o_orderpriority") == "1-URGENT", "filed").when(F.col("o_orderpriority") == "5-LOW", "accepted").otherwise("other")
    rows = o.select(F.year("o_orderdate").alias("year"), region.alias("region"), name.alias("indicator_name"), F.when(F.col("o_orderkey") % 50 == 0, float("nan")).otherwise(F.col("o_totalprice")).alias("value"))
    known = table(spark, d, "nation").where("n_nationkey % 5 <> 4").select(F.format_string("%02d", "n_nationkey").alias("code"), F.col("n_name").alias("name"))
    out = imports.legacy_import(rows, known, {"filed": "dossiers_deposes", "accepted": "dossiers_recevables"}, rows.select(F.lit("x").alias("key")).limit(0))
    return out.select("code", "name", "indicator", "period", rounded("value"), "key", "status")


@query("""select n_nationkey::varchar as code, n_name as name, case when n_nationkey % 6 = 5 then 'Unknown' else upper(r_name) || '!' end as region_name, case when n_nationkey % 6 = 5 then case when n_nationkey % 4 = 1 then 'old' end else 'R' || r_regionkey end as region_code from nation join region on n_regionkey = r_regionkey""")
def conformed_region_codes(spark, d):
    """Regions by their names in other spellings; one that nothing knows keeps the code it had."""
    t = territories(spark, d)
    unknown = F.col("dept") % 6 == 5
    depts = t.select(F.col("dept").cast("string").alias("code"), F.col("n_name").alias("name"), F.when(unknown, "Unknown").otherwise(F.concat(F.upper("r_name"), F.lit("!"))).alias("region_name"), F.when(F.col("dept") % 4 == 1, "old").alias("region_code"))
    return conformed.with_region_codes(depts, table(spark, d, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("region_code"), F.initcap("r_name").alias("region_name"))).select("code", "name", "region_name", "region_code")


@query("""with k as (select distinct strftime(o_orderdate, '%Y-%m') as p from orders), y as (select distinct strftime(l_shipdate, '%Y') as p from lineitem),
wrong as (select count(*) as n from orders where o_orderkey % 10 = 0)
select 'periods' as name, (select count(*) from k)::bigint as before, (select count(*) from (select p from k union select p from y))::bigint as after, (select count(*) from (select p from k union select p from y))::bigint - (select count(*) from k)::bigint as added
union all select 'regions', 0, count(*), count(*) from region union all select 'deprecations', 1, 3, 2 union all select 'mismatches', 0, n, n from wrong""")
def conformed_migration(spark, d):
    """Dimensions before and after a migration, objects that go out of use, and rows whose code isn't their dimension's."""
    months = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("period_key")).distinct()
    years = table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy").alias("period_key")).distinct()
    names = table(spark, d, "region").select(F.concat(F.lit("fact_"), "r_name").alias("object_name"), F.lit("table").alias("object_type"), F.lit("observations").alias("replacement"), F.lit("empty").alias("reason"))
    first = names.where("object_name = 'fact_ASIA'")
    after = conformed.deprecated(first, names.where("object_name in ('fact_ASIA', 'fact_AFRICA', 'fact_EUROPE')"))
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, "x").otherwise(F.col("o_orderpriority")).alias("code"))
    wrong = conformed.mismatches(o, table(spark, d, "orders"), "o_orderkey", "code", "o_orderpriority")
    return conformed.migration_report({"periods": star.periods(months), "deprecations": first}, {"periods": star.periods(months, years), "regions": table(spark, d, "region"), "deprecations": after}, wrong)


@query("""with o as (select o_orderkey as id, o_custkey::varchar as code, strftime(o_orderdate, '%Y-%m-%d') as period, o_orderpriority as indicator, round(o_totalprice, 6) as value from orders),
k as (select *, sha256('mean-debt-1|' || code || '|' || period || '|' || printf('%.6f', value)) as k1, sha256('historical-harmonisation-1|' || period || '|' || code || '|' || indicator || '|' || printf('%.6f', value)) as k2 from o)
select id, case when id % 5 = 0 then 'broken' else k2 end as key, case when id % 5 = 0 then 'mean-debt-1' else 'historical-harmonisation-1' end as version, id % 2 = 0 and id % 5 <> 0 as moved from k""")
def rekeyed_observations(spark, d):
    """Half of the rows have a key of an old version; a key that its version didn't make is left alone."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("code"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("period"), F.col("o_orderpriority").alias("indicator"), F.round("o_totalprice", 6).alias("value"))
    old, odd = F.col("id") % 2 == 0, F.col("id") % 5 == 0
    rows = conformed.keyed(conformed.keyed(o, "mean-debt-1", "k1"), "historical-harmonisation-1", "k2")
    rows = rows.select("id", "code", "period", "indicator", "value", F.when(odd, "broken").when(old, F.col("k1")).otherwise(F.col("k2")).alias("key"), F.when(odd | old, "mean-debt-1").otherwise("historical-harmonisation-1").alias("version"))
    return conformed.rekeyed(rows, "mean-debt-1", "historical-harmonisation-1").select("id", "key", "version", "moved")
