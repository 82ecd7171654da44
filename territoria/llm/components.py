"""Distributed union-find over an edge table: alternating large-star and small-star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territoria.llm.common import batches_held, cut, dropped, giving_back

#: Edges that a task contracts at once before any shuffle.
LOCAL = 500_000


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index joined to each of n items by edges (a, b)."""
    label = np.arange(n)
    while len(a):
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A star for each component of the edges that a task holds, some at a time."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u = np.concatenate([x.column("u").to_numpy() for x in held])
        v = np.concatenate([x.column("v").to_numpy() for x in held])
        ids, both = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = roots(len(ids), both[: len(u)], both[len(u) :])
        leaf = root != np.arange(len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[leaf]), pa.array(ids[root[leaf]])], ["u", "v"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= LOCAL:
            yield stars(held)
            held, size = [], 0
    if size:
        yield stars(held)


def _starred(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step. Minima are combined before each shuffle and written before the joins,
    so a node with very many edges is split by the skew join and never meets in one task."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    oriented = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lower = oriented.groupBy("u").agg(F.min("v").alias("m"))
    hung = oriented.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(lower.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of the edges (src, dst; longs): component is the smallest id that can be reached.
    Tasks first contract the edges they hold, so few rounds remain. Loops and repeated edges count for nothing; no edges give no rows. Each round is
    written to the shared folder."""
    batches_held(edges.sparkSession)
    ordered = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    now = cut(ordered.mapInArrow(giving_back(_contracted), "u long, v long").distinct())
    state = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    seen = state(now)
    while seen[0]:
        after = cut(_starred(now))
        dropped(now)
        now, before, seen = after, seen, state(after)
        if seen == before:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
