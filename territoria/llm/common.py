"""Small helpers that the operators of this subpackage share: lineage cuts, Arrow batches, reducers for joins."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache, wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches that go to Python end at so many rows or bytes, so a worker's memory doesn't follow the longest text.
BATCH_ROWS, BATCH_BYTES = 4000, 8 << 20
#: Bits of the table by which `likely_in` drops most rows before a shuffle; its size doesn't grow with the data.
REDUCER_BITS = 1 << 24


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a session in one process gets a
    temporary folder of its own; one with executors on other machines has no folder that they all see, which is an error."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.territoria.scratch", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.conf.set("spark.territoria.scratch", at := tempfile.mkdtemp(prefix="territoria-"))
    return at


def batches_held(spark: SparkSession) -> None:
    """Bounds the Arrow batches, and lets Python workers import this package from where the driver did."""
    root, env = str(Path(__file__).parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


@cache
def _trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)  # only glibc has it


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow whose worker, after its last batch, gives free memory back that Arrow and malloc would
    hold: Spark keeps workers for later tasks, of other stages too, and theirs adds to the executor's."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        _trim()(0)

    return whole


#: The tables that operators now at work have written, the innermost operator's last.
_SCOPES: list[list[str]] = []


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: what follows neither repeats its work nor depends on the
    executors that did it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/territoria/{uuid.uuid4().hex}"
    for scope in _SCOPES:
        scope.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def dropped(df: DataFrame) -> None:
    """Deletes those tables that a plan reads and that `cut` wrote, where nothing will read them again; others stay."""
    own = f"{shared_folder(df.sparkSession)}/territoria"
    for name in _read_by(df):
        if re.fullmatch("[0-9a-f]{32}", name):
            _deleted(df.sparkSession, f"{own}/{name}")


def _read_by(df: DataFrame) -> set[str]:
    """The names of the folders that a plan reads."""
    names, leaves = set(), df._jdf.queryExecution().analyzed().collectLeaves()
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() == "LogicalRelation":
            roots = leaf.relation().location().rootPaths()
            names.update(roots.apply(j).getName() for j in range(roots.size()))
    return names


def tidy(op: Callable) -> Callable:
    """An operator that deletes the tables it wrote on its way when it has made its result, but for those that the result's
    plan reads. These stay until the operator that it is a part of, if any, is done; the last ones are the caller's, who can
    delete them with `dropped` when the result is written."""

    @wraps(op)
    def run(*args, **options):
        _SCOPES.append(made := [])
        try:
            out = op(*args, **options)
        finally:
            _SCOPES.pop()
        needed = _read_by(out) if isinstance(out, DataFrame) else set()
        for path in made:
            if path.rpartition("/")[2] not in needed:
                _deleted(SparkSession.active(), path)
        return out

    return run


def documents_of(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns of a documents table, in this order, null where the table lacks one; ids of any integer type are
    longs."""
    kind = lambda c: "long" if c.endswith("_id") or c == "turn" else "string"
    return docs.select(*((F.col(f"`{c}`") if c in docs.columns else F.lit(None)).cast(kind(c)).alias(c) for c in columns))


def carried(docs: DataFrame) -> DataFrame:
    """docs as (row, doc_id, text): row is a struct of all its columns, so no name made later can clash with theirs."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text")


def likely_in(df: DataFrame, members: DataFrame, key: Column, member_key: Column, size: int = REDUCER_BITS, marked: bool = False) -> DataFrame:
    """The rows of df whose key may be among the members' keys: all that are, and a few others where bits coincide.
    The bits are a table of at most size / 64 rows, so it can be broadcast at any size of the data; an exact join must
    follow. marked: all rows, with a column `likely`."""
    slot = lambda k: F.pmod(F.xxhash64(k), F.lit(size))
    word = lambda s: F.shiftright(s, 6)
    bits = members.select(slot(member_key).alias("_s")).groupBy(word(F.col("_s")).alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_s & 63 as int))")).alias("_b"))
    placed = df.withColumn("_s", slot(key)).withColumn("_w", word(F.col("_s")))
    found = F.expr("(shiftrightunsigned(_b, cast(_s & 63 as int)) & 1) = 1")
    if marked:
        return placed.join(F.broadcast(bits), "_w", "left").withColumn("likely", F.coalesce(found, F.lit(False))).drop("_w", "_s", "_b")
    return placed.join(F.broadcast(bits), "_w").where(found).drop("_w", "_s", "_b")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of equal keys (long columns) in batches that are sorted by them. A group must fit in memory: callers
    split large ones into blocks first."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in keys])
        edges = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            now = tuple(k[:, a].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Groups as in `runs`, many at once: about a batch's, and the places where they begin, with the end of the last."""

    def edges(table: pa.Table) -> np.ndarray:
        k = np.stack([table.column(x).to_numpy() for x in keys])
        return np.r_[0, np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1, table.num_rows]

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = edges(pa.Table.from_batches([batch]))
        first = tuple(batch.column(x)[0].as_py() for x in keys)
        begun = int(at[-2])  # the last group may go on
        if held and (begun or first != last):
            if begun:
                held.append(batch.slice(0, begun))
            table = pa.Table.from_batches(held).combine_chunks()
            yield table, edges(table)
            held = []
        elif begun:
            table = pa.Table.from_batches([batch.slice(0, begun)])
            yield table, edges(table)
        held.append(batch.slice(begun))
        last = tuple(batch.column(x)[-1].as_py() for x in keys)
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, edges(table)


def floats(column: pa.ChunkedArray) -> np.ndarray:
    """A column of equally long float lists as a matrix."""
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def mixed(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h
