"""Exact deduplication by composable polynomial fingerprints, with a chunkwise comparison of equal fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territoria.llm.common import batches_held, cut, documents_of, likely_in, tidy

#: Bytes of a chunk. Longer documents are hashed chunk by chunk on different tasks.
CHUNK = 1 << 16
#: Two primes below 2^31 and a base for each: a byte times a power fits 64 bits, and so does a chunk's sum.
PRIMES, BASES = (2147483647, 2147483629), (1103515245, 69621 * 7919)


@cache
def _powers(n: int) -> np.ndarray:
    """base^(n-1) ... base^0 modulo each prime."""
    out = np.empty((2, n), np.uint64)
    for k, (p, r) in enumerate(zip(PRIMES, BASES, strict=True)):
        x, part = 1, np.ones(1, np.uint64)
        while len(part) < n:  # doubling: the powers so far, then those times the next one
            x = pow(r, len(part), p)
            part = np.concatenate([part, part * np.uint64(x) % np.uint64(p)])
        out[k] = part[:n][::-1]
    return out


def chunk_hash(data: bytes) -> tuple[int, int]:
    """The polynomial hash of at most CHUNK bytes, modulo each prime; bytes count from 1, so zeros matter."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    w = _powers(CHUNK)[:, CHUNK - len(b) :]
    return int((b * w[0]).sum()) % PRIMES[0], int((b * w[1]).sum()) % PRIMES[1]


def combined(left: tuple[int, int], right: tuple[int, int], right_bytes: int) -> tuple[int, int]:
    """The hash of two byte strings in a row from theirs: the left one is shifted by the right one's length."""
    return tuple((a * pow(r, right_bytes, p) + b) % p for a, b, r, p in zip(left, right, BASES, PRIMES, strict=True))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's hash shifted by the bytes that follow it in its document; their sum is the document's hash."""
    for batch in batches:
        out = []
        for data, after in zip(batch.column("chunk").to_pylist(), batch.column("after").to_pylist(), strict=True):
            h = chunk_hash(data)
            out.append(combined(h, (0, 0), after) if after else h)
        keep = [c for c in batch.schema.names if c not in ("chunk", "after")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], [*keep, "t1", "t2"])


def fingerprints(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, h, n_bytes, f1, f2, text_sha256), a row per row of docs. h tells rows of one doc_id apart."""
    batches_held(docs.sparkSession)
    rows = documents_of(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))).select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"), F.encode("text", "utf-8").alias("data"))
    base = ["rid", "doc_id", "h", "n_bytes", "text_sha256"]
    schema = "rid long, doc_id long, h long, n_bytes long, text_sha256 string, t1 long, t2 long"
    small = rows.where(F.col("n_bytes") <= chunk).select(*base, F.col("data").alias("chunk"), F.lit(0).cast("long").alias("after"))
    small = small.mapInArrow(_terms, schema).select(*base[1:], F.col("t1").alias("f1"), F.col("t2").alias("f2"))
    at = F.explode(F.expr(f"sequence(0L, n_bytes - 1, {chunk}L)"))
    long = rows.where(F.col("n_bytes") > chunk).select(*base, "data", at.alias("at"))
    long = long.select(*base, F.expr(f"substring(data, cast(at + 1 as int), {chunk})").alias("chunk"), F.expr(f"greatest(n_bytes - at - {chunk}, 0L)").alias("after"))
    long = long.repartition("rid", "after").mapInArrow(_terms, schema)
    sums = [(F.sum(t) % p).alias(f) for t, f, p in (("t1", "f1", PRIMES[0]), ("t2", "f2", PRIMES[1]))]
    return small.unionByName(long.groupBy(*base).agg(*sums).drop("rid"))


def _unequal(docs: DataFrame, prints: DataFrame, key: list[str], chunk: int) -> DataFrame:
    """(doc_id, h) of rows whose text differs from that of their group's representative, by comparing chunk by chunk.
    Only rows of groups of two and more are shuffled; the representative's chunks are repeated once for each thousand
    members, so no task holds a whole group."""
    groups = cut(prints.groupBy(*key).agg(F.count("*").alias("size"), F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h")).alias("rep")).where("size > 1"))
    members = cut(prints.join(groups, key).select("doc_id", "h", "rep", F.xxhash64(*key).alias("gid"), F.ceil(F.col("size") / 1000).cast("int").alias("salts")).distinct())
    texts = documents_of(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    near = likely_in(texts, members, F.col("h"), F.col("h")).dropDuplicates(["doc_id", "h"])
    held = near.alias("t").join(members.alias("m"), F.expr("t.h = m.h and t.doc_id <=> m.doc_id")).select("gid", "t.doc_id", "t.h", "salts", "rep", F.encode("text", "utf-8").alias("data"))
    parts = held.withColumn("at", F.explode(F.expr(f"sequence(0L, greatest(cast(octet_length(data) as bigint) - 1, 0L), {chunk}L)")))
    parts = parts.withColumn("chunk", F.expr(f"substring(data, cast(at + 1 as int), {chunk})")).drop("data")
    is_rep = F.expr("rep.h = h and rep.doc_id <=> doc_id")
    reps = parts.where(is_rep).select("gid", "at", F.col("chunk").alias("theirs"), F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"))
    own = parts.where(~is_rep).withColumn("salt", F.expr("cast(pmod(xxhash64(doc_id, h), salts) as int)"))
    return own.join(reps, ["gid", "at", "salt"], "left").where(~F.col("chunk").eqNullSafe(F.col("theirs"))).select("doc_id", "h").distinct()


@tidy
def exact_duplicates(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Equal texts of a documents table (doc_id long, text string; other columns are ignored).

    Returns a row per row: doc_id, keep_id (the largest doc_id among equal texts), group_size (rows with that text),
    kept (doc_id is keep_id), text_sha256, n_bytes. A null text counts as empty, and empty texts are equal to each
    other. Rows that repeat a doc_id and its text count in group_size and are marked alike. A null doc_id is smaller
    than any other; a group of nothing else has keep_id null and is kept. An empty table gives no rows.
    """
    prints = cut(fingerprints(docs, chunk).withColumn("split", F.lit(0)))
    key = ["f1", "f2", "n_bytes", "split"]
    round_ = 0
    while True:
        odd = cut(_unequal(docs, prints, key, chunk))
        if odd.isEmpty():
            break
        round_ += 1  # texts that only share a fingerprint form a group of their own and are compared again
        odd = odd.withColumn("odd", F.lit(True))
        prints = cut(prints.alias("p").join(odd.alias("o"), F.expr("p.h = o.h and p.doc_id <=> o.doc_id"), "left").select("p.*", "odd").withColumn("split", F.when(F.col("odd"), F.lit(round_)).otherwise(F.col("split"))).drop("odd"))
    groups = cut(prints.groupBy(*key).agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id")))
    return prints.join(groups, key).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_bytes")
