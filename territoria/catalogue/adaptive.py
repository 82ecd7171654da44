"""Frames of any layout, pages of lines, grids of cells and dated texts, built from the test tables and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from territoria.catalogue.registry import query, rounded, table
from territoria.functions import dates
from territoria.operators import roles
from territoria.plans import harmonise, layout, tables
from territoria.reference_data import MONTHS

LONG = ["departement", "year", "indicator_name", "value", "source_file"]


def _long(df):
    return df.select("departement", "year", "indicator_name", rounded("value"), "source_file")


@query("""select c_mktsegment as departement, (2018 + c_custkey % 7)::int as year, name as indicator_name, round(v, 6) as value, 'filings.csv' as source_file
from (select c_mktsegment, c_custkey, unnest(['dossiers_deposes', 'dossiers_recevables']) as name, unnest([c_acctbal, c_nationkey::double]) as v from customer)""")
def adaptive_several_values(spark, d):
    c = table(spark, d, "customer").select((F.col("c_custkey") % 7 + 2018).alias("Année"), F.col("c_mktsegment").alias("Département"), F.col("c_acctbal").alias("Dossiers déposés"), F.lit(None).cast("string").alias("Vide"), F.col("c_nationkey").alias("Dossiers recevables"))
    return _long(roles.normalised(c, "filings.csv"))


@query("select p_type as departement, 2021 as year, 'prix' as indicator_name, round(p_retailprice, 6) as value, 'stock_2021.csv' as source_file from part")
def adaptive_inferred_place(spark, d):
    """No column is named for a place or year: the text column is the place, the file's name tells the year."""
    return _long(roles.normalised(table(spark, d, "part").select(F.col("p_retailprice").alias("Prix"), F.col("p_type").alias("Zone")), "stock_2021.csv"))


@query("""select null::varchar as departement, null::int as year, 'code' as indicator_name, p_partkey::double as value, 'odd.csv' as source_file from part where p_partkey % 2 = 0""")
def adaptive_first_column(spark, d):
    """Half of the column are numbers: too few for a numeric one, so it is the last resort."""
    return _long(roles.normalised(table(spark, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string")).otherwise("x").alias("Code")), "odd.csv"))


@query("""select 'Bretagne' as departement, 2020 as year, coalesce(case when o_orderkey % 3 <> 0 then o_orderstatus end, 'filings') as indicator_name, round(o_totalprice, 6) as value, 'f.csv' as source_file from orders""")
def adaptive_filled_down(spark, d):
    """Defaults take effect where a column has nothing (place), or where single rows have nothing (indicator)."""
    o = table(spark, d, "orders").select(F.lit(None).cast("string").alias("year"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("Indicateur"), F.col("o_totalprice").alias("Valeur"))
    return _long(roles.normalised(o, "f.csv", year=2020, region="Bretagne", dataset="filings"))


@query("select c_nationkey::varchar as departement, c_acctbal as value, c_mktsegment as variable, 2022 as year, 'x' as source from customer")
def standardised_columns(spark, d):
    c = table(spark, d, "customer").select(F.lit("old").alias("DEP_1"), F.col("c_nationkey").alias("CODE_DEPART"), F.lit(0).alias("VALEUR"), F.col("c_acctbal").alias("VALUE_2"), F.lit("a").alias("LIBELLE"), F.col("c_mktsegment").alias("TYPE"))
    return roles.standardised(c, 2022, "x")


@query(r"""with c as (select unnest(['p_size', 'p_type', 'p_name', 'mixed']) as column_name, unnest([p_size::varchar, p_type, p_name, case when p_partkey % 2 = 0 then '12' when p_partkey % 7 = 0 then '' else 'x' end]) as v, unnest(range(4)) as pos from part),
s as (select column_name, pos, avg((trim(v) <> '')::int) as text, avg(regexp_matches(regexp_replace(replace(replace(v, ' ', ''), ',', '.'), '[^0-9.\-]', '', 'g'), '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$')::int) as number from c group by all)
select column_name, round(text, 6) as text, round(number, 6) as number, number >= 0.6 as is_number, number > 0 as has_numbers, coalesce(pos = (select min(pos) from s where text >= 0.7 and number <= 0.4), false) as place from s""".replace(2 * chr(92), chr(92)))
def column_roles(spark, d):
    """Which columns are numbers, which hold any, and which is the place: the first of much text and few numbers."""
    p = table(spark, d, "part")
    mixed = F.when(F.col("p_partkey") % 2 == 0, "12").when(F.col("p_partkey") % 7 == 0, "").otherwise("x")
    return roles.told(p.select("p_size", "p_type", "p_name", mixed.alias("mixed"))).select("column_name", rounded("text"), rounded("number"), "is_number", "has_numbers", "place")


NAMES = [m for m in MONTHS]
MONTH_SQL = "list_value(" + ", ".join(f"'{m}'" for m in NAMES) + ")[month(o_orderdate)::int]"


def _month(c):
    return F.element_at(F.array(*(F.lit(m) for m in NAMES)), F.month(c))


@query("""select o_orderkey, case when o_orderkey % 3 <> 2 then strftime(o_orderdate, '%Y-%m') end as period, strftime(o_orderdate, '%Y-%m-%d') as published, case when o_orderkey % 2 = 0 then '1999-01' else strftime(o_orderdate, '%Y-%m') end as stated,
case when o_orderkey % 4 <> 0 then (o_orderkey % 90)::varchar || ',5 Mo' end as size, case when o_orderkey % 4 <> 0 then (((o_orderkey % 90) + 0.5) * 1048576)::bigint end as bytes from orders""")
def dated_texts(spark, d):
    """Periods of titles and addresses, dates of pages, statement dates before publication dates, announced sizes."""
    o, k, m, y = table(spark, d, "orders"), F.col("o_orderkey"), _month("o_orderdate"), F.year("o_orderdate").cast("string")
    title = F.when(k % 3 == 0, F.concat(F.lit("Inclusion financière : Bretagne - "), F.initcap(m), F.lit(" "), y)).otherwise("Bulletin")
    url = F.when(k % 3 == 1, F.concat(F.lit("https://x.fr/bulletin-"), m, F.lit("-"), y, F.lit("#top"))).otherwise("https://x.fr/")
    page = F.concat(F.lit("Accueil. Mise en ligne le "), F.dayofmonth("o_orderdate").cast("string"), F.lit(" "), m, F.lit(" "), y)
    text = F.when(k % 2 == 0, F.concat(F.lit("Publié en "), m, F.lit(" "), y, F.lit(". Situation à fin janvier 1999"))).otherwise(F.concat(F.lit("Dépôts "), m, F.lit(" "), y))
    link = F.when(k % 4 != 0, F.concat(F.lit("PDF ("), (k % 90).cast("string"), F.lit(",5 Mo)"))).otherwise("PDF")
    return o.select("o_orderkey", dates.publication_period(title, url).alias("period"), dates.iso_date(page, "mise en ligne").alias("published"), dates.statement_period(text, F.lit("a.pdf")).alias("stated"), dates.announced_size(link).alias("size"), dates.announced_bytes(link).alias("bytes"))


@query("""select doc_id, case when doc_id % 11 = 0 then 'invalid status' when doc_id % 7 = 0 then 'wrong type' when doc_id % 5 = 0 then 'wrong signature' when octet_length(encode(text)) + 5 < 400 then 'too small' when octet_length(encode(text)) + 5 > 20000 then 'too large' end as fault from documents""")
def response_faults(spark, d):
    k, c = F.col("doc_id"), F.encode("text", "utf-8")
    status, mime = F.when(k % 11 == 0, 404).otherwise(200), F.when(k % 7 == 0, "text/html").when(k % 2 == 0, "").otherwise("application/PDF")
    content = F.when(k % 5 == 0, c).otherwise(F.concat(F.encode(F.lit("%PDF-"), "utf-8"), c))
    return table(spark, d, "documents").select("doc_id", dates.response_fault(status, mime, content, 400, 20_000).alias("fault"))


#: One page a month: a line for each region and department, with three figures.
FIGURES = "select strftime(o_orderdate, '%Y-%m') as page, n_regionkey as r, r_name as region, n_nationkey as k, n_name as name, count(*)::bigint as a, (sum(o_totalprice) / 100)::bigint as b, count(distinct o_custkey)::bigint as c from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all"
STATED = f"with f as ({FIGURES}) select page, region, printf('%02d', k) as departement_code, name as departement_name, unnest(['count', 'total', 'customers']) as indicator_name, unnest([a, b, c]) / 10.0::double as value from f"


def _figures(spark, d):
    """SQL's cast takes halves to the even number; sums are of cents, so what they differ from these by is noise."""
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("page"), F.col("n_regionkey").alias("r"), F.col("r_name").alias("region"), F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).agg(
        F.count("*").alias("a"), F.expr("cast(rint(round(sum(o_totalprice), 2) / 100) as bigint)").alias("b"), F.count_distinct("o_custkey").alias("c"))


def _tenth(c):
    return F.concat(F.expr(f"cast({c} div 10 as string)"), F.lit(","), (F.col(c) % 10).cast("string"))


@query(STATED)
def statement_lines(spark, d):
    """Pages of text lines, some of whose labels stand on a line of their own."""
    f, three = _figures(spark, d), F.concat_ws(" ", _tenth("a"), _tenth("b"), _tenth("c"))
    code = F.format_string("%02d", "k")
    two = F.concat_ws("\n", F.concat_ws(" - ", code, "name"), three)
    line = F.when(F.col("k") % 3 == 0, two).otherwise(F.concat_ws(" ", code, "name", three))
    dept = f.select("page", "r", F.col("k").alias("at"), line.alias("line"))
    region = f.select("page", "r", F.lit(-1).alias("at"), F.concat_ws(" ", "region", F.lit("1,0 2,0 3,0")).alias("line")).distinct()
    whole = dept.unionByName(region).select("page", F.posexplode(F.split("line", "\n")).alias("part", "line"), (F.col("r") * 100000 + F.col("at") * 10).alias("at")).select("page", (F.col("at") + F.col("part")).alias("line_no"), "line")
    regions = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    return tables.statement_rows(whole, ["page"], regions, ["count", "total", "customers"])


ODD_CODE = "case when k % 5 = 0 then '97' || k % 10 when k = 7 then '2A' when k = 8 then '2B' else printf('%02d', k) end"


@query(f"with f as ({FIGURES}) select page, region, {ODD_CODE} as departement_code, name as departement_name, unnest(['count', 'total']) as indicator_name, unnest([a, b]) / 10.0::double as value from f")
def statement_odd_codes(spark, d):
    """Codes of three digits and of a letter, dashes, points in figures, and lines that begin like a code and aren't one."""
    f, k = _figures(spark, d), F.col("k")
    code = F.when(k % 5 == 0, F.concat(F.lit("97"), (k % 10).cast("string"))).when(k == 7, "2a").when(k == 8, "2B").otherwise(F.format_string("%02d", "k"))
    label = F.when(k % 3 == 0, F.concat(code, F.lit("-"), "name")).when(k % 3 == 1, F.concat(code, F.lit(" – "), "name")).otherwise(F.concat_ws(" ", code, "name"))
    point = lambda c: F.replace(_tenth(c), F.lit(","), F.when(k % 2 == 0, F.lit(".")).otherwise(F.lit(",")))
    at = F.col("r") * 1000 + k * 10
    dept = f.select("page", at.alias("line_no"), F.concat_ws(" ", label, point("a"), point("b")).alias("line"))
    noise = f.select("page", (at + 1).alias("line_no"), F.when(k % 2 == 0, "100 km 1,0 2,0").otherwise("1234 Total 3.0 4.0").alias("line"))
    region = f.select("page", (F.col("r") * 1000 - 1).alias("line_no"), F.concat_ws(" ", "region", F.lit("1,0 2.0")).alias("line")).distinct()
    return tables.statement_rows(dept.unionByName(noise).unionByName(region), ["page"], ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"], ["count", "total"])


@query(f"with f as ({FIGURES}) select page, region, printf('%02d', k) as departement_code, name as departement_name, unnest(['Count of orders', 'Total', 'Customers']) as indicator_name, unnest([a, b, c]) / 10.0::double as value from f")
def statement_tables(spark, d):
    """Tables with headers over two rows, rows of regions, and columns without a header."""
    f = _figures(spark, d)
    dept = f.select("page", (F.col("r") * 1000 + F.col("k") + 10).alias("row_no"), F.array(F.concat_ws(" ", F.format_string("%02d", "k"), "name"), _tenth("a"), _tenth("b"), F.lit("9"), _tenth("c")).alias("cells"))
    region = f.select("page", (F.col("r") * 1000 + 9).alias("row_no"), F.array(F.concat("region", F.lit(" *")), *(F.lit(x) for x in ("1", "2", "3", "4"))).alias("cells")).distinct()
    top = f.select("page").distinct()
    one = top.select("page", F.lit(0).alias("row_no"), F.array(*(F.lit(x) for x in ("", "Count", "Total", "", "Customers"))).alias("cells"))
    two = top.select("page", F.lit(1).alias("row_no"), F.array(*(F.lit(x) for x in ("", "of\norders", "Total", " ", ""))).alias("cells"))
    return tables.table_rows(dept.unionByName(region).unionByName(one).unionByName(two), ["page"])


@query(f"""with f as ({FIGURES}), t as (select page, 'Territoire|Nombre|Total|Clients' as cells, -1 as k from f union select page, printf('%02d', k) || ' ' || name || '|' || a || '|' || b || '|' || c, k from f)
select page, case substr(page, 6, 2)::int % 3 when 0 then '0 lines lines' when 1 then '1 lines text' else '2 text text' end as strategy, (row_number() over (partition by page order by k) - 1)::int as row_no, cells from t""")
def positioned_tables(spark, d):
    """Pages of words that have places: of every three months one has a grid of rules, one has upright rules only, one none.
    A title far above is no table."""
    f, month = _figures(spark, d), F.substring("page", 6, 2).cast("int") % 3
    at = F.row_number().over(Window.partitionBy("page").orderBy("k"))
    label = F.concat_ws(" ", F.format_string("%02d", "k"), "name")
    head = f.select("page").distinct().select("page", F.lit(0).alias("at"), *(F.lit(x).alias(c) for c, x in zip("labc", ("Territoire", "Nombre", "Total", "Clients"), strict=True)))
    rows = head.unionByName(f.select("page", at.alias("at"), label.alias("l"), *(F.col(c).cast("string") for c in "abc")))
    top = 100.0 + F.col("at") * 14 + F.col("at") % 3
    words = rows.select("page", top.alias("top"), "a", "b", "c", F.split("l", " ").alias("w"))
    left = words.select("page", "top", "w", F.posexplode("w").alias("n", "text")).withColumn("x0", 20.0 + 5 * F.length(F.array_join(F.slice("w", F.lit(1), F.col("n")), " ")) + F.when(F.col("n") > 0, 5).otherwise(0)).withColumn("x1", F.col("x0") + 5 * F.length("text"))
    right = words.select("page", "top", F.explode(F.array(*(F.struct(F.lit(x).alias("x1"), F.col(c).alias("text")) for c, x in zip("abc", (220.0, 320.0, 420.0), strict=True)))).alias("e")).select("page", "top", "e.x1", "e.text").withColumn("x0", F.col("x1") - 5 * F.length("text"))
    title = head.select("page", F.lit(20.0).alias("top"), F.lit(20.0).alias("x0"), F.lit(300.0).alias("x1"), F.lit("Situation").alias("text"))
    placed = left.select("page", "x0", "x1", "top", "text").unionByName(right.select("page", "x0", "x1", "top", "text")).unionByName(title).withColumn("bottom", F.col("top") + 10)
    size = rows.groupBy("page").agg((98.0 + 14 * F.count("*")).alias("end")).withColumn("kind", month)
    upright = size.where("kind < 2").select("page", F.explode(F.array(*(F.lit(x) for x in (15.0, 150.0, 250.0, 350.0, 430.0)))).alias("x0"), F.lit(98.0).alias("top"), F.col("end").alias("bottom")).withColumn("x1", F.col("x0") + 1)
    flat = size.where("kind = 0").select("page", F.explode(F.expr("transform(sequence(0, cast((end - 98) / 14 as int)), r -> 98.0D + 14 * r)")).alias("top")).select("page", F.lit(15.0).alias("x0"), F.lit(431.0).alias("x1"), "top", (F.col("top") + 0.5).alias("bottom"))
    found = tables.first_tables(layout.page_tables(placed, upright.unionByName(flat), ["page"]), ["page"])
    return found.select("page", "strategy", "row_no", F.array_join("cells", "|").alias("cells"))


@query("""select n_regionkey as page, n_nationkey as row_no, unnest(['name', 'col_1']) as name, unnest([n_name, n_nationkey::varchar]) as value from nation""")
def text_tables(spark, d):
    n = table(spark, d, "nation")
    body = n.select(F.col("n_regionkey").alias("page"), (F.col("n_nationkey") + 1).alias("row_no"), F.array(F.concat(F.lit(" "), "n_name", F.lit("\n")), F.col("n_nationkey").cast("string"), F.lit(" ")).alias("cells"))
    head = n.select(F.col("n_regionkey").alias("page"), F.lit(0).alias("row_no"), F.array(F.lit("name"), F.lit(None).cast("string"), F.lit("none")).alias("cells")).distinct()
    return tables.tabled(body.unionByName(head), ["page"]).withColumn("row_no", F.col("row_no") - 1)


@query("""select n_regionkey as page, case when n_regionkey = 1 then 'text' else 'lines' end as strategy, count(*)::bigint as rows from nation group by all""")
def best_page_tables(spark, d):
    """Three readings of each page: the one with most departments and numbers counts."""
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("page"), F.col("n_nationkey").alias("row_no"), "n_name")
    label = F.concat_ws(" ", F.format_string("%02d", "row_no"), "n_name")
    reading = lambda s, first, *rest: n.select("page", F.lit(s).alias("strategy"), F.lit(0).alias("table_no"), "row_no", F.array(first, *rest).alias("cells"))
    rows = reading("lines", F.when(F.col("page") == 1, F.col("n_name")).otherwise(label), F.lit("1")).unionByName(reading("text", F.when(F.col("page") == 1, label).otherwise("n_name"), F.lit("2"), F.lit("x"))).unionByName(reading("none", F.lit(None).cast("string"), F.lit("3")))
    return tables.best_tables(rows, ["page"]).groupBy("page", "strategy").agg(F.count("*").alias("rows"))


@query("""select n_regionkey as page, 'a' as strategy, count(*)::bigint as rows from nation where n_regionkey % 2 = 0 group by all union all select n_regionkey, 'b', 2 * count(*)::bigint from nation where n_regionkey % 2 = 1 group by all""")
def first_page_tables(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("page"), F.col("n_nationkey").alias("row_no"), F.array("n_name").alias("cells"))
    reading = lambda s, t, rows: rows.select("page", F.lit(s).alias("strategy"), F.lit(t).alias("table_no"), "row_no", "cells")
    rows = reading("a", 0, n.where("page % 2 = 0")).unionByName(reading("b", 0, n)).unionByName(reading("b", 1, n.where("page % 2 = 1")))
    return tables.first_tables(rows, ["page"]).groupBy("page", "strategy").agg(F.count("*").alias("rows"))


@query("select y as sheet, n_nationkey::varchar as code, n_name as name, (n_nationkey * 10 + y) / 100.0::double as rate from nation cross join (select unnest(range(2020, 2024)) as y) where n_nationkey % 6 <> 5")
def nearest_cell_rates(spark, d):
    """Sheets of scattered cells: a rate belongs to the department nearest above; too far or too far aside, to none."""
    n = table(spark, d, "nation").crossJoin(spark.range(2020, 2024).withColumnRenamed("id", "sheet"))
    k = F.col("n_nationkey")
    row, col = F.floor(k / 5).cast("int") * 20, (k % 5).cast("int") * 6 + 3
    name = n.select("sheet", row.alias("row"), col.alias("col"), F.concat(F.lit(" "), "n_name").alias("value"))
    decoy = n.select("sheet", (row - 3).alias("row"), (col - 1).alias("col"), F.lit("Total").alias("value"))
    further = n.select("sheet", (row + F.when(k % 6 == 5, 8).otherwise(k % 6 + 1)).alias("row"), (col + k % 4 - 2).alias("col"), F.concat((k * 10 + F.col("sheet")).cast("string"), F.lit(" dépôts de dossiers pour 100 000")).alias("value"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"))
    return harmonise.filing_rates(name.unionByName(decoy).unionByName(further), ["sheet"], names).select("sheet", "code", "name", rounded("rate"))


@query("""with p as (select p_partkey, string_split(p_name, ' ') as w from part), k as (select distinct p_name as name from part where p_partkey % 5 = 0 union select distinct w[1] from (select string_split(p_name, ' ') as w from part)),
g as (select p_partkey, s, e, array_to_string(w[s + 1:e], ' ') as name from p, range(0, 8) a(s), range(1, 9) b(e) where s < e and e <= len(w)), f as (select p_partkey, s, e, name from g join k using (name))
select p_partkey, s::int as start, e::int as "end", name from f where not exists (select 1 from f o where o.p_partkey = f.p_partkey and o.s <= f.s and o.e >= f.e and o.e - o.s > f.e - f.s)""")
def longest_known_names(spark, d):
    p = table(spark, d, "part")
    names = p.where("p_partkey % 5 = 0").select(F.col("p_name").alias("name")).union(p.select(F.get(F.split("p_name", " "), F.lit(0)))).distinct()
    return tables.longest_names(p.select("p_partkey", F.col("p_name").alias("text")), "p_partkey", names, 8).select("p_partkey", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "name")


HISTORY = "select (user_id % 25)::varchar as code, strftime(ts, '%Y-%m-%d') as period, event_id as id, value from events where event_type = 'purchase'"


@query(f"""with y as (select unnest([2023, 2024]) as year), c as (select year, n_nationkey::varchar as code, (n_nationkey + 5) + 0.7::double as u, 10.0::double + n_nationkey as p from nation cross join y),
h as (select code, value from ({HISTORY}) qualify row_number() over (partition by code order by period desc, id desc) = 1)
select year::varchar as period, code, indicator, round(v, 6) as value, unit from (select year, c.code, unnest(['taux_chomage', 'taux_pauvrete', 'revenu_median']) as indicator, unnest([u, p, h.value]) as v, unnest(['%', '%', 'euros']) as unit from c left join h using (code)) where v is not null and not (year = 2023 and code = '7' and indicator = 'taux_pauvrete')""")
def historical_harmonisation(spark, d):
    """Context blocks of two years, the latest income of each department, and one observation that is there already."""
    n = table(spark, d, "nation")
    text = F.concat_ws(" ", F.lower("n_name"), (F.col("n_nationkey") + 5).cast("string"), F.lit("7 de chomage et"), (F.col("n_nationkey") + 10).cast("string"), F.lit("des menages sous le seuil de pauvrete"))
    pages = n.crossJoin(spark.range(2023, 2025).withColumnRenamed("id", "year")).groupBy("year", "n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(text)), " ").alias("text"))
    names = n.select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("code"))
    context = harmonise.context(harmonise.blocks(pages, ["year", "n_regionkey"], names, 3))
    e = table(spark, d, "events").where("event_type = 'purchase'")
    history = e.select((F.col("user_id") % 25).cast("string").alias("code"), F.date_format("ts", "yyyy-MM-dd").alias("period"), F.col("event_id").alias("id"), F.lit("revenu_median").alias("indicator"), "value")
    nothing = spark.createDataFrame([], "key string")
    first = harmonise.harmonised(names, context, history, nothing, [2023]).where("code = '7' and indicator = 'taux_pauvrete'").select("key")
    return harmonise.harmonised(names, context, history, first, [2023, 2024]).select("period", "code", "indicator", rounded("value"), "unit")
