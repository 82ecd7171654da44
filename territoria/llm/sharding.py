"""Placement of documents on shards by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A prime over a hundred times the usual number of shards; the table has so many rows whatever the size of the data.
SLOTS = 65537


def _number(name: str, seed: str) -> int:
    return int(hashlib.md5(f"{seed}:{name}".encode()).hexdigest()[:15], 16)


def filled_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """The shard (its index) of each slot. Each shard prefers the slots in an order of its own, offset + k * skip modulo
    the prime; the shards take turns, and each claims the first slot on its list that is free."""
    if not shards or len(shards) > slots or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("a prime number of slots, not below the number of shards, and at least one shard")
    offsets, skips = [_number(x, "offset") % slots for x in shards], [_number(x, "skip") % (slots - 1) + 1 for x in shards]
    table, at, left = np.full(slots, -1, np.int32), list(offsets), slots
    while left:
        for k, skip in enumerate(skips):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip) % slots
            table[at[k]] = k
            left -= 1
            if not left:
                break
    return table


def placed(docs: DataFrame, shards: list[str], slots: int = SLOTS, key: str = "doc_id") -> DataFrame:
    """Every row of docs with slot (long) and shard (string): the md5 of its key modulo the table's size, looked up in
    a broadcast table of `slots` rows, which is bounded. No shuffle; a hot source or repeated texts don't matter, as
    only the key counts. Rows with equal keys share a shard; a null key counts as the empty string. Columns named slot
    or shard are replaced; the others stay. An empty table gives no rows."""
    spark = docs.sparkSession
    table = spark.createDataFrame([(k, shards[x]) for k, x in enumerate(filled_table(shards, slots).tolist())], "slot long, shard string")
    slot = F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots))
    return docs.drop("slot", "shard").withColumn("slot", slot).join(F.broadcast(table), "slot")
