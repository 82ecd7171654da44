"""The SQL of vector links where there are links: the given table with copies that carry a little noise."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from territoria.llm import queries, vector_links

DIR = "/root/testdata/sf0.001"


def test_links_of_noisy_copies_are_those_of_the_sql(spark, tmp_path):
    rng = np.random.default_rng(11)
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    ids, size = max(r[0] for r in rows) + 1, len(rows[0][2])
    made = []
    for k, (_, label, e) in enumerate(rows[:40]):
        base = np.array(e, float)
        for j in range(1 + k % 12):  # groups of one to twelve copies, of which some are near enough and some just aren't
            made.append((label if j % 5 else rows[(k + 1) % 40][1], base + rng.normal(0, (0.02 + 0.02 * (j % 6)) * np.linalg.norm(base) / np.sqrt(size), size)))
    step = np.array(rows[41][2], float)
    for j in range(30):  # a chain: neighbours are linked, its ends are not
        turned = step + j * 0.09 * np.linalg.norm(step) / np.sqrt(size) * np.sign(np.array(rows[42][2], float))
        made.append((rows[41][1], turned))
    odd = [(rows[0][1], None), (None, rows[0][2]), (rows[0][1], [0.0] * size), (rows[0][1], [float("nan")] * size), (rows[0][1], list(rows[0][2])), (rows[0][1], [2 * x for x in rows[0][2]])]
    every = rows + [(ids + k, label, None if e is None else [float(x) for x in e]) for k, (label, e) in enumerate(made + odd)]
    table = spark.createDataFrame(every, "vec_id long, label long, embedding array<double>")
    label = spark.read.parquet(f"{DIR}/embeddings.parquet").schema["label"].dataType
    table = table.withColumn("label", F.col("label").cast(label))
    table.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op1_vector_links(spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept").collect()
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet' where embedding is null or not list_contains(embedding, 'nan'::double) and list_sum(list_transform(embedding, lambda x: abs(x))) > 0")
    wanted = con.sql(queries.VECTOR_LINKS).fetchall()
    bad = {r[0] for r in every if r[2] is not None and (r[2][0] != r[2][0] or not any(r[2]))}
    assert sorted(tuple(r) for r in got if r["vec_id"] not in bad) == sorted(wanted)
    assert {(r["n_links"], r["component_id"] == r["vec_id"]) for r in got if r["vec_id"] in bad} == {(0, True)}
    assert sum(r["n_links"] > 0 for r in got) > 100 and max(r["n_links"] for r in got) > 5
    chain = [r for r in got if r["component_id"] == min(x["component_id"] for x in got if x["vec_id"] == rows[41][0])]
    assert len(chain) > 5 and max(r["n_links"] for r in chain) < len(chain) - 1  # a component that isn't a clique
    assert vector_links.near_vectors(table.limit(0), least=0.98).count() == 0
