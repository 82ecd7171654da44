"""Idempotent writes on plain Parquet: insertion if absent, latest-wins upserts, overlays, journals, expectations."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from territoria.operators.windows import first_by


def absent(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose key isn't there yet, one per key."""
    return first_by(new, keys, *(c for c in new.columns if c not in keys)).join(old.select(*keys), keys, "left_anti")


def stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at a path, or an empty one where nothing is written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


#: Seconds after which a writer that hasn't ended counts as dead, and buckets that keyed tables are kept in.
LEASE, BUCKETS = 3600, 64


class Lease:
    """The right to write a table, until it expires: a file with a number, one more than that of the lease before, in a
    folder beside the table, in the table's own store. Only one writer can create a number. Who comes after a lease that
    expired takes the next number, and whoever holds an older one fails at `check`, which comes before each commit."""

    def __init__(self, spark: SparkSession, path: str, owner: str, seconds: float):
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.folder, self.what = f"{path.rstrip('/')}.leases", path
        self.fs = self.path(self.folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self.jvm, newest = jvm, self._newest()
        if newest and not self.fs.exists(self.path(f"{self._file(newest)}.ended")):
            until, who = self._read(newest)
            if time.time() < until:
                raise RuntimeError(f"another writer, {who}, is at {path}")
        self.token = newest + 1
        try:
            out = self.fs.create(self.path(self._file(self.token)), False)
        except Exception as e:
            raise RuntimeError(f"another writer was first at {path}") from e
        out.write(bytearray(f"{time.time() + seconds} {owner}".encode()))
        out.close()
        for old in range(max(1, newest - 8), newest):  # a few are kept to read
            for name in (self._file(old), f"{self._file(old)}.ended"):
                self.fs.delete(self.path(name), False)

    def _file(self, token: int) -> str:
        return f"{self.folder}/{token:012d}"

    def _newest(self) -> int:
        at = self.path(self.folder)
        names = [x.getPath().getName() for x in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _read(self, token: int) -> tuple[float, str]:
        stream = self.fs.open(self.path(self._file(token)))
        try:
            text = bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
        until, _, who = text.partition(" ")
        return (float(until), who) if until else (time.time() + 60, "unknown")  # created, not yet written

    def check(self) -> None:
        """An error if someone else has taken over."""
        if self._newest() != self.token:
            raise RuntimeError(f"the lease on {self.what} expired and is another writer's now")

    def end(self) -> None:
        if self._newest() == self.token:
            self.fs.createNewFile(self.path(f"{self._file(self.token)}.ended"))

    def moved(self, staged: str, path: str) -> None:
        """The files of a staged table into a table's folder, under names that tell the lease; the staged folder goes."""
        self.check()
        self.fs.mkdirs(self.path(path))
        for x in self.fs.listStatus(self.path(staged)):
            name = x.getPath().getName()
            if name.startswith("part-") and not self.fs.rename(x.getPath(), self.path(f"{path}/{name.replace('part-', f'part-{self.token}-', 1)}")):
                raise RuntimeError(f"{name} can't be moved to {path}")
        self.fs.delete(self.path(staged), True)


@contextmanager
def only_writer(spark: SparkSession, path: str, owner: str = "writer", seconds: float = LEASE) -> Iterator[Lease]:
    """Holds the lease on a table while it is read and written, so that two writers never insert the same key. A lease that
    is held is an error; one whose writer died is taken over when it has expired."""
    lease = Lease(spark, path, owner, seconds)
    try:
        yield lease
    finally:
        lease.end()


def refreshed(df: DataFrame, path: str, by: list[str] = ()) -> None:
    """A whole table anew, perhaps partitioned. df must not read the same path."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def exchanged(df: DataFrame, path: str, separator: str = ";") -> None:
    """A table as delimited text with a header, in as many files as it has partitions. Arrays and structs become JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("sep", separator).csv(path)


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def scores_replaced(scores: DataFrame, details: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> int:
    """Writes new scores and their parts: a score replaces that of its key, and all parts of the one before go with it.
    Both tables are kept in buckets by key, and only those buckets that a new score falls in are written, as files of the
    next version; a manifest that tells each bucket's version is written last, which is the commit. Tells the version.
    Readers take the newest (`current`); what a writer left that died isn't in any manifest."""
    spark = scores.sparkSession
    with only_writer(spark, path) as lease:
        version = stored(spark, f"{path}/versions", StructType.fromDDL("version int")).agg(F.max("version")).first()[0] or 0
        version += 1
        touched = [r[0] for r in scores.select(_bucket(keys, buckets)).distinct().collect()]  # a few numbers
        manifest = []
        for name, new in (("scores", scores), ("details", details)):
            old = current(spark, path, name, new.schema, touched)
            rest = old.join(scores.select(*keys).distinct(), keys, "left_anti")
            at = f"{path}/{name}/{version}"
            rows = rest.unionByName(new).withColumn("bucket", _bucket(keys, buckets))
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
            there = {r[0] for r in spark.read.parquet(at).select("bucket").distinct().collect()} if touched else set()
            manifest += [(version, name, b, b in there) for b in touched]
        lease.check()
        spark.createDataFrame(manifest, "version int, name string, bucket int, filled boolean").coalesce(1).write.mode("append").parquet(f"{path}/versions")
        return version


def current(spark: SparkSession, path: str, name: str, schema: StructType | None = None, only: list[int] | None = None) -> DataFrame:
    """The rows of a table that scores_replaced wrote, by the newest version of each bucket (or of some only)."""
    known = stored(spark, f"{path}/versions", StructType.fromDDL("version int, name string, bucket int, filled boolean")).where(F.col("name") == name)
    newest = known.groupBy("bucket").agg(F.max_by(F.struct("version", "filled"), "version").alias("v")).select("bucket", "v.*").collect()  # a row for each bucket
    paths = [f"{path}/{name}/{r['version']}/bucket={r['bucket']}" for r in newest if r["filled"] and (only is None or r["bucket"] in only)]
    if not paths:
        if schema is None:
            raise LookupError(f"no {name} at {path}")
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema) if schema else spark.read).parquet(*paths)


def migrated(spark: SparkSession, path: str, migrations: list[tuple[str, str, Callable[[SparkSession], None]]]) -> dict[str, list[str]]:
    """Runs those migrations (version, description, step) that the registry at a path doesn't know, in order, each noted
    as soon as it has run; a second call runs none."""
    with only_writer(spark, path) as lease:
        known = {r["version"] for r in stored(spark, path, StructType.fromDDL("version string, description string, applied_at timestamp")).select("version").collect()}
        applied, already = [], []
        for version, description, step in migrations:
            if version in known:
                already.append(version)
                continue
            step(spark)
            lease.check()
            spark.createDataFrame([(version, description)], "version string, description string").withColumn("applied_at", F.current_timestamp()).write.mode("append").parquet(path)
            applied.append(version)
        return {"applied": applied, "already_applied": already}


def insert_if_absent(new: DataFrame, path: str, keys: list[str], dry_run: bool = False) -> dict[str, int]:
    """Appends rows with new keys; tells how many were inserted and how many were there. A dry run writes nothing. Rows are
    written beside the table first, and their files moved into it while the lease holds."""
    spark = new.sparkSession
    with only_writer(spark, path) as lease:
        fresh = absent(new, stored(spark, path, new.schema), keys).persist()
        try:
            inserted, total = fresh.count(), new.select(*keys).distinct().count()
            if not dry_run and inserted:
                fresh.write.mode("overwrite").parquet(staged := f"{path.rstrip('/')}.staged/{lease.token}")
                lease.moved(staged, path)
            return {"inserted": inserted, "unchanged": total - inserted}
        finally:
            fresh.unpersist()


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows without a newer one, and the new rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def overlaid(base: DataFrame, log: DataFrame, keys: list[str], value: str, version: str) -> DataFrame:
    """base with values replaced by the latest entry of an override log; entries for unknown keys are ignored."""
    last = first_by(log.where(F.col(value).isNotNull()), keys, version, descending=True).select(*keys, F.col(value).alias("_v"))
    return base.join(last, keys, "left").withColumn("overridden", F.col("_v").isNotNull()).withColumn(value, F.coalesce("_v", value)).drop("_v")


def patched(log: DataFrame, ident: int, fields: dict, version: int) -> DataFrame:
    """A new log entry with some fields changed. No fields or an unknown id is an error."""
    if not fields:
        raise ValueError("nothing to change")
    current = first_by(log.where(F.col("id") == ident), ["id"], "version", descending=True)
    if current.isEmpty():
        raise LookupError(f"no override {ident}")
    for k, v in fields.items():
        current = current.withColumn(k, F.lit(v).cast(log.schema[k].dataType))
    return log.unionByName(current.withColumn("version", F.lit(version).cast(log.schema["version"].dataType)))


def expect(df: DataFrame, unique: list[str] = (), known: dict[str, DataFrame] | None = None, checks: dict[str, str] | None = None) -> DataFrame:
    """df, or an error that names what fails: repeated keys, values that a dimension lacks, or SQL conditions."""
    if unique and not df.groupBy(*unique).count().where("count > 1").isEmpty():
        raise ValueError(f"repeated keys: {list(unique)}")
    for column, dim in (known or {}).items():
        if not df.where(F.col(column).isNotNull()).join(dim.select(column), column, "left_anti").isEmpty():
            raise ValueError(f"unknown values: {column}")
    for name, condition in (checks or {}).items():
        if not df.where(f"not coalesce({condition}, true)").isEmpty():
            raise ValueError(f"check fails: {name}")
    return df


def journalled(spark: SparkSession, path: str, run_id: str, steps: dict[str, Callable[[], bool]], gates: dict[str, Callable[[], bool]] | None = None) -> str:
    """Runs steps in order and appends their outcome to a journal: success, quality_failed where a step returns False,
    skipped where a step's gate doesn't open, or failed, after which the error goes on."""
    status = "success"

    def note(step: str, status: str) -> None:
        spark.createDataFrame([(run_id, step, status)], "run_id string, step string, status string").withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)

    for name, step in steps.items():
        if gates and name in gates and not gates[name]():
            status = "quality_failed"
            note(name, "skipped")
            continue
        note(name, "running")
        try:
            if step() is False:
                status = "quality_failed"
        except Exception:
            note(name, "failed")
            raise
        note(name, status)
    return status
