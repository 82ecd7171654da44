"""Every query that has SQL gives the same rows as that SQL, on the smallest tables."""

import math

import duckdb
import pytest

from territoria.catalogue import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name in ORACLE_SQL:
        rel = duck.sql(ORACLE_SQL[name])
        at = [rel.columns.index(c) for c in columns]
        wanted = [tuple(plain(r[k]) for k in at) for r in rel.fetchall()]
        order = lambda r: tuple((x is None, str(x)) for x in r)
        assert sorted(got, key=order) == sorted(wanted, key=order)


def test_entry_works_without_the_optional_subpackage(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["statement_lines", "statement_odd_codes"])
def test_statements_of_thousands_and_halves(spark, tmp_path, name):
    """Figures of three digits beside names that end in one, and totals halfway between two numbers."""
    c = duckdb.connect()
    for t, sql in {
        "orders": "select k as o_orderkey, k % 5 as o_custkey, 0.25::double as o_totalprice, timestamp '2001-08-02' as o_orderdate from range(5000) r(k)",
        "customer": "select k as c_custkey, k::int as c_nationkey from range(5) r(k)",
        "nation": f"select * from '{DIR}/nation.parquet'",
        "region": f"select * from '{DIR}/region.parquet'",
    }.items():
        c.sql(f"copy ({sql}) to '{tmp_path}/{t}.parquet' (format parquet)")
        c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    got, wanted = QUERIES[name](spark, str(tmp_path)), c.sql(ORACLE_SQL[name])
    assert sorted(tuple(r[x] for x in wanted.columns) for r in got.collect()) == sorted(wanted.fetchall())
