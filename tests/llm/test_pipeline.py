"""Queries against their SQL, and the pipeline's stages against brute force on what each gets."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from tests.llm.test_links import ODD, clashing, components, grams
from tests.test_queries import TABLES, plain
from territoria.llm import queries, toxicity

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    rel = c.sql(queries.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(x) for x in columns]
    order = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(plain(r[x]) for x in columns) for r in df.collect()), key=order) == sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=order)


def test_all_are_registered(spark):
    import __spark_entry__

    assert {n.split("_")[0] for n in queries.QUERIES} == {*(f"op{k}" for k in range(1, 14)), "pipeline"}
    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(queries.ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
    labels = queries.op4_sharding(spark, DIR)
    assert labels.count() == spark.read.parquet(f"{DIR}/documents.parquet").count() and set(r["shard"] for r in labels.collect()) <= set(queries.SHARDS)


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = toxicity.train(docs, queries.table(spark, DIR, "labels"))
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, DIR)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == columns
    before, after = kept["toxicity"]
    assert Counter(after) == Counter(r for r in before if toxicity.score(r["text"], model) < 0.5) and after
    before, after = kept["line_dedup"]
    was = {r["doc_id"]: (r["text"] or "").split("\n") for r in before}
    for r in after:
        left = iter(was[r["doc_id"]])
        assert all(x in left for x in (r["text"] or "").split("\n"))  # lines of the text, in its order
    seen = Counter(x.strip(" ").lower() for r in after for x in (r["text"] or "").split("\n") if x.strip(" "))
    assert max(seen.values()) == 1
    before, after = kept["ngram_join"]
    sets = {r["doc_id"]: grams(r["text"]) for r in before}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert {r["doc_id"] for r in after} == set(components(sets, pairs).values()) and len(after) == len(set(sets) & {r["doc_id"] for r in after})
    before, after = kept["mixing"]
    n = Counter(r["doc_id"] for r in after)
    assert set(after) <= set(before) and max(n.values()) <= 2
    words, taken = sum(len((r["text"] or "").split()) for r in before), sum(len((r["text"] or "").split()) for r in after)
    assert 0.9 * 1.5 * words <= taken <= 1.05 * 1.5 * words
    before, after = kept["packing"]
    assert Counter(r["doc_id"] for r in after if r["start"] == 0) == Counter(r["doc_id"] for r in before)


def test_the_first_stage_rejects_what_scores_high(spark):
    d = "/root/testdata/sf0.01"  # the smallest table with enough toxic labels to learn from
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model, before = toxicity.train(docs, queries.table(spark, d, "labels")), docs.collect()
    after = corpus_pipeline.clean(spark, docs, d).collect()
    assert Counter(after) == Counter(r for r in before if toxicity.score(r["text"], model) < 0.5) and 0 < len(after) < len(before)


def test_stages_take_empty_and_odd_tables(spark, tmp_path):
    odd = clashing(spark, ODD)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, odd.limit(0), DIR)
        assert out.count() == 0 and out.columns == odd.columns
        full = stage(spark, odd, DIR)
        assert full.columns == odd.columns and {r["doc_id"] for r in full.collect()} >= {907, None if k in (0, 2) else 907}, name
    pack = corpus_pipeline.STAGES[4][1]
    assert pack(spark, odd.limit(0), DIR).count() == 0
    assert Counter(r["doc_id"] for r in pack(spark, odd, DIR).collect() if r["start"] == 0) == Counter(i for i, _ in ODD)
