"""Text, numbers, periods, keys, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from territoria.catalogue.registry import query, rounded, table
from territoria.functions import numbers, periods, text
from territoria.functions.keys import idempotence_key
from territoria.sources import files, pages


@query("select o_orderkey, sha256(o_orderstatus || '|' || o_orderpriority || '|' || coalesce(case when o_orderkey % 3 = 0 then null else o_custkey end::varchar, '') || '|' || strftime(o_orderdate, '%Y-%m')) as k from orders")
def idempotence_keys(spark, d):
    maybe = F.when(F.col("o_orderkey") % 3 == 0, None).otherwise(F.col("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", idempotence_key(F.col("o_orderstatus"), F.col("o_orderpriority"), maybe, F.date_format("o_orderdate", "yyyy-MM")).alias("k"))


#: Codes as sources write them, from the nation's key.
CODES_SQL = "select c_custkey, case c_custkey % 8 when 0 then c_nationkey::varchar when 1 then printf('%02d', c_nationkey) when 2 then ' 2a' when 3 then '97' || c_nationkey % 10 when 4 then c_nationkey || '.0' when 5 then '' when 6 then '2a.0' else c_mktsegment end as c from customer"


def _codes(spark, d):
    k, n = F.col("c_custkey") % 8, F.col("c_nationkey")
    two = F.format_string("%02d", n)
    forms = [n.cast("string"), two, F.lit(" 2a"), F.concat(F.lit("97"), (n % 10).cast("string")), F.concat(n.cast("string"), F.lit(".0")), F.lit(""), F.lit("2a.0"), F.col("c_mktsegment")]
    return table(spark, d, "customer").select("c_custkey", F.element_at(F.array(*forms), (k + 1).cast("int")).alias("c"))


@query(f"""with c as ({CODES_SQL}), x as (select *, upper(trim(c)) as u from c), p as (select *, replace(replace(u, '.0', ''), '.', '') as a, replace(u, '.0', '') as k from x)
select c_custkey, c, case when regexp_matches(a, '^[0-9]$') then '0' || a else a end as d1, case when regexp_matches(u, '^[0-9]$') then '0' || u else u end as d2, case when regexp_matches(k, '^[0-9]$') then '0' || k else nullif(k, '') end as d3, case when u in ('2A', '2B') or regexp_matches(u, '^[0-9]{{1,2}}$') then case when length(u) = 1 then '0' || u else u end end as d4, substr(c, 1, 2) as d5 from p""")
def department_code_normalise(spark, d):
    c = F.col("c")
    return _codes(spark, d).select("c_custkey", "c", text.code_any(c).alias("d1"), text.code_upper(c).alias("d2"), text.code_clean(c).alias("d3"), text.code_strict(c).alias("d4"), text.code_of_commune(c).alias("d5"))


LABELS = ["Année Réf.", "Île-de-France", "Côte d’Or", "  Saint  Étienne ", "N/A", "--"]


@query("""with t(t) as (select n_name from nation union all values {labels}), f as (select t, translate(t, 'àâäéèêëîïôöùûüçÀÂÄÉÈÊËÎÏÔÖÙÛÜÇ', 'aaaeeeeiioouuucAAAEEEEIIOOUUUC') as f from t)
select t, trim(regexp_replace(lower(f), '\\s+', ' ', 'g')) as plain, regexp_replace(lower(f), '[^a-z0-9]', '', 'g') as name_key, regexp_replace(regexp_replace(regexp_replace(lower(replace(f, '’', '''')), '[^a-z0-9]+', '-', 'g'), '^-+', ''), '-+$', '') as slug,
trim(regexp_replace(regexp_replace(lower(replace(f, '’', '''')), '[^a-z0-9''\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as page_text, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '_', 'g'), '^_+', ''), '_+$', ''), ''), 'unknown') as legacy, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(t), '[^\\p{L}\\p{N}]+', '_', 'g'), '^_+', ''), '_+$', ''), ''), 'unknown') as code, trim(regexp_replace(lower(regexp_replace(f, '\\p{P}', ' ', 'g')), '\\s+', ' ', 'g')) as words from f""".replace("{labels}", ", ".join(f"('{x}')" for x in LABELS)).replace("\\\\", "\\"))
def text_normalise(spark, d):
    t = F.col("t")
    rows = table(spark, d, "nation").select(F.col("n_name").alias("t")).union(spark.createDataFrame([(x,) for x in LABELS], "t string"))
    return rows.select("t", text.plain_text(t).alias("plain"), text.name_key(t).alias("name_key"), text.slug(t).alias("slug"), text.page_text(t).alias("page_text"), text.legacy_slug(t).alias("legacy"), text.code_slug(t).alias("code"), text.name_words(t).alias("words"))


#: Figures of orders as French reports print them, with marks for what is missing.
@query("""with o as (select o_orderkey as k, floor(o_totalprice * 10)::bigint as tenths from orders),
t as (select k, tenths, case when k % 6 = 0 then null when k % 6 = 4 then -tenths else tenths end as signed, (tenths // 10000) as thousands, printf('%03d', (tenths // 10) % 1000) as units, (tenths % 10)::varchar as tenth from o),
w as (select *, case when thousands > 0 then thousands || ' ' || units else ((tenths // 10) % 1000)::varchar end as whole from t)
select k as o_orderkey, case k % 6 when 0 then 'n.d.' when 1 then whole || ',' || tenth || ' %' when 2 then whole || ' dossiers' when 3 then (tenths // 10) || '.' || tenth when 4 then '(' || whole || ',' || tenth || ')' else '' || whole || ',' || tenth end as figure,
case when k % 6 = 3 or k % 6 = -1 then tenths / 10.0::double end as plain,
case k % 6 when 0 then null when 2 then (tenths // 10)::double else tenths / 10.0::double end as loose,
case k % 6 when 0 then null when 2 then null when 4 then -tenths / 10.0::double else tenths / 10.0::double end as french from w""")
def french_number_parse(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey"), F.expr("floor(o_totalprice * 10)").alias("tenths"))
    k = F.col("o_orderkey") % 6
    units, tenth = F.expr("tenths div 10"), (F.col("tenths") % 10).cast("string")
    whole = F.when(units >= 1000, F.concat(F.expr("tenths div 10000").cast("string"), F.lit(" "), F.format_string("%03d", units % 1000))).otherwise(units.cast("string"))
    with_tenth = F.concat(whole, F.lit(","), tenth)
    forms = [F.lit("n.d."), F.concat(with_tenth, F.lit(" %")), F.concat(whole, F.lit(" dossiers")), F.concat(units.cast("string"), F.lit("."), tenth), F.concat(F.lit("("), with_tenth, F.lit(")")), with_tenth]
    rows = o.select("o_orderkey", F.element_at(F.array(*forms), (k + 1).cast("int")).alias("figure"))
    t = F.col("figure")
    return rows.select("o_orderkey", "figure", numbers.parsed(t).alias("plain"), numbers.parsed_loose(t).alias("loose"), numbers.parsed_french(t).alias("french"))


FILE_MONTHS = ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "decembre"]


@query("""with n as (select o_orderkey, o_orderdate as o_at, case o_orderkey % 4 when 0 then 'deposits_20' || printf('%02d', day(o_orderdate)) || strftime(o_orderdate, '%m') || '.pdf' when 1 then 'report ' || year(o_orderdate) || ' and 2021' when 2 then 'bilan-2023-2024' || strftime(o_orderdate, '%m') else 'nothing' end as f from orders)
select o_orderkey, f, nullif(regexp_extract(f, '((?:19|20)[0-9]{2})', 1), '')::int as first_year, list_max(list_transform(regexp_extract_all(f, '(20[0-9]{2})', 1), lambda x: x::int)) as last_year,
case when regexp_matches(f, '(20[0-9]{2})(0[1-9]|1[0-2])') then regexp_extract(f, '(20[0-9]{2})(0[1-9]|1[0-2])', 1) || '-' || regexp_extract(f, '(20[0-9]{2})(0[1-9]|1[0-2])', 2) end as file_period, month(o_at)::int as month, strftime(o_at, '%Y-%m') as period from n""")
def period_parse(spark, d):
    o, k, at = table(spark, d, "orders"), F.col("o_orderkey") % 4, F.col("o_orderdate")
    mm = F.date_format(at, "MM")
    forms = [F.concat(F.lit("deposits_20"), F.date_format(at, "dd"), mm, F.lit(".pdf")), F.concat(F.lit("report "), F.year(at).cast("string"), F.lit(" and 2021")), F.concat(F.lit("bilan-2023-2024"), mm), F.lit("nothing")]
    named = F.element_at(F.array(*(F.lit(m) for m in FILE_MONTHS)), F.month(at))
    written = F.when(k % 2 == 0, F.initcap(named)).otherwise(F.upper(named))
    rows = o.select("o_orderkey", F.element_at(F.array(*forms), (k + 1).cast("int")).alias("f"), F.when(k == 3, F.month(at).cast("string")).otherwise(written).alias("m"), F.year(at).alias("y"))
    f, month = F.col("f"), periods.month_number(F.col("m"))
    return rows.select("o_orderkey", "f", periods.first_year(f).alias("first_year"), periods.last_year(f).alias("last_year"), periods.period_of_file(f).alias("file_period"), month.alias("month"), periods.period_key(F.col("y"), month).alias("period"))


LINKS = """links as (select page_id, absolute, min(place) as place, arg_min(href, place) as href from (select page_id, href, place, regexp_replace(case when regexp_matches(href, '^https?://') then href else regexp_extract(url, '^(https?://[^/?#]+)', 1) || href end, '#.*$', '') as absolute from (select page_id, url, unnest(hrefs) as href, unnest(range(len(hrefs))) as place from (select page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) as hrefs from pages))) group by all)"""


@query(f"with {LINKS} select page_id, href, absolute, regexp_extract(lower(regexp_replace(absolute, '[?#].*$', '')), '\\.([a-z0-9]{{1,5}})$', 1) as extension, list_max(list_transform(regexp_extract_all(absolute, '(20[0-9]{{2}})', 1), lambda x: x::int)) as year, place::bigint as place from links")
def page_links(spark, d):
    return pages.links(table(spark, d, "pages"))


@query(f"with {LINKS} select page_id, href, place::bigint as place from (select *, row_number() over (partition by page_id order by place) as n from links where length(href) % 2 = 1) where n = 1")
def candidate_file_choice(spark, d):
    found = pages.links(table(spark, d, "pages")).where("length(href) % 2 = 1")
    return pages.chosen_file(found, 2031, 2031).select("page_id", "href", "place")


@query(r"""with h as (select page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) as base, unnest(list_distinct(regexp_extract_all(html, '(/t[a-z]+)"', 1))) as hit from pages), u as (select distinct page_id, base || hit as url from h)
select page_id, url, row_number() over (partition by page_id order by url desc)::bigint as place from u""")
def publication_links(spark, d):
    """Slugs with a t, some of them in JSON with escaped slashes."""
    p = table(spark, d, "pages")
    html = F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise(F.replace("html", F.lit("/"), F.lit("\\/")))
    return pages.publications(p.select("page_id", "url", html.alias("html")), '/t[a-z]+(?=")')


@query(f"""with {LINKS}, l as (select page_id, (page_id + place) % 4 as k, absolute || case (page_id + place) % 4 when 0 then '/depots-regions.CSV' when 1 then '/surendettement_inclusion.pdf?v=1.2' when 2 then '/emploi.html' else '' end as absolute from links)
select page_id, absolute, case when contains(lower(absolute), 'and') then 'AND' when contains(lower(absolute), 'the') then 'the' end as region, case k when 0 then 'deposits' when 1 then 'filings' when 2 then 'employment' else 'other' end as kind, k < 2 as relevant from l""")
def classified_links(spark, d):
    """Links that lead to files of three kinds, and others; a link that names two kinds is of the first."""
    found = pages.links(table(spark, d, "pages"))
    k = (F.col("page_id") + F.col("place")) % 4
    ends = F.when(k == 0, "/depots-regions.CSV").when(k == 1, "/surendettement_inclusion.pdf?v=1.2").when(k == 2, "/emploi.html").otherwise("")
    found = found.withColumn("absolute", F.concat("absolute", ends)).withColumn("extension", text.extension(F.col("absolute")))
    return pages.classified(found, ["AND", "the"]).select("page_id", "absolute", "region", "kind", "relevant")


@query("select event_id, regexp_extract(props, '\"k\": ?(-?[0-9]+)', 1)::bigint as k, '{\"k\":' || regexp_extract(props, '\"k\": ?(-?[0-9]+)', 1) || '}' as again from events")
def json_roundtrip(spark, d):
    parsed = F.from_json("props", "k long")
    return table(spark, d, "events").select("event_id", parsed["k"].alias("k"), F.to_json(parsed).alias("again"))


@query("""select doc_id, substr(text, 1, 500) as head, regexp_extract(text, '([0-9]+)[.,]([0-9]+)', 0) as number_text, case when regexp_matches(text, '([0-9]+)[.,]([0-9]+)') then try_cast(regexp_extract(text, '([0-9]+)[.,]([0-9]+)', 1) || '.' || regexp_extract(text, '([0-9]+)[.,]([0-9]+)', 2) as double) end as number from documents where contains(text, '@')""")
def regex_fragments(spark, d):
    t, p = F.col("text"), r"([0-9]+)[.,]([0-9]+)"
    number = F.concat_ws(".", F.regexp_extract(t, p, 1), F.regexp_extract(t, p, 2)).try_cast("double")
    return table(spark, d, "documents").where(F.contains("text", F.lit("@"))).select("doc_id", F.substring("text", 1, 500).alias("head"), F.regexp_extract(t, p, 0).alias("number_text"), F.when(t.rlike(p), number).alias("number"))


@query("select doc_id, round(n_chars / 1024.0::double, 6) as kilobytes, case when n_chars < 500 then 'short' when contains(text, 'password=') then 'secret' when lang in ('fr', 'de', 'es') then 'foreign' else 'plain' end as verdict from documents")
def response_validation(spark, d):
    verdict = F.when(F.col("n_chars") < 500, "short").when(F.contains("text", F.lit("password=")), "secret").when(F.col("lang").isin("fr", "de", "es"), "foreign").otherwise("plain")
    return table(spark, d, "documents").select("doc_id", rounded(F.col("n_chars") / F.lit(1024.0), "kilobytes"), verdict.alias("verdict"))


@query("""select 'https://data/' || n_regionkey as source_url, 'D' || n_regionkey as dataset_code, (2000 + n_regionkey)::varchar as dataset_year, r_name as dataset_label, case when n_regionkey <> 2 then 'Census & more' end as dataset_source,
case when n_nationkey % 5 <> 4 then 'DEP' end as geo_level, case when n_nationkey % 5 <> 4 then printf('%02d', n_nationkey) end as departement_code, 'POP' as measure_code, 'Population' as measure_label,
'[{"variable_code":"SEX","variable_label":"Sexe","modality_code":"' || (n_nationkey % 2) || '","modality_label":"' || case n_nationkey % 2 when 0 then 'Hommes' else 'Femmes, ' || r_name end || '"},{"variable_code":"AGE","variable_label":null,"modality_code":"x","modality_label":null}]' as modalities_json,
case when n_nationkey % 7 <> 3 then n / 2.0::double end as value
from (select n_nationkey, n_regionkey, r_name, count(c_custkey) as n from nation join region on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by all)""")
def local_data_cells(spark, d):
    """A document for each region: a variable that is named twice, one that isn't, a zone that is lacking, a value that is no
    number."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n")), "n_nationkey", "left")
    k = F.col("n_nationkey")
    zone = F.when(k % 5 != 4, F.concat(F.lit("<Zone codgeo='"), F.format_string("%02d", k), F.lit("' nivgeo='DEP'/>"))).otherwise("")
    value = F.when(k % 7 != 3, (F.coalesce("n", F.lit(0)) / F.lit(2.0)).cast("string")).otherwise("s")
    cell = F.concat(F.lit("<Cellule>"), zone, F.lit("<Mesure code='POP'>Population</Mesure><Modalite code='"), (k % 2).cast("string"), F.lit("' variable='SEX'/><Modalite code='x' variable='AGE'/><Valeur>"), value, F.lit("</Valeur></Cellule>"))
    docs = n.groupBy("n_regionkey", "r_name").agg(F.array_join(F.sort_array(F.collect_list(cell)), "").alias("cells"))
    key = F.col("n_regionkey").cast("string")
    xml = F.concat(
        F.lit("<Donnees><JeuDonnees code='D"), key, F.lit("'><Annee>"), (F.col("n_regionkey") + 2000).cast("string"), F.lit("</Annee><Libelle>"), F.col("r_name"), F.lit("</Libelle>"), F.when(F.col("n_regionkey") != 2, "<Source>Census &amp; more</Source>").otherwise(""),
        F.lit("</JeuDonnees><Variable code='SEX'><Libelle>Old</Libelle><Modalite code='1'><Libelle>Old</Libelle></Modalite></Variable><Variable code='SEX'><Libelle>Sexe</Libelle><Modalite code='0'><Libelle>Hommes</Libelle></Modalite><Modalite code='1'><Libelle>Femmes, "), F.col("r_name"), F.lit("</Libelle></Modalite></Variable>"), F.col("cells"), F.lit("</Donnees>"))
    return files.local_data(docs.select(F.concat(F.lit("https://data/"), key).alias("url"), xml.alias("xml")), "xml", "url")
