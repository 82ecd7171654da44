"""Incremental ingestion: a file stream that is watermarked, windowed and written once per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from territoria.sinks import insert_if_absent


def events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed(stream: DataFrame, ts: str, keys: list[str], value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by tumbling windows; later events than the watermark don't count."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select("w.start", "w.end", *keys, "n", "total")


def written_once(stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Each micro-batch into a table where a key is written once, so replays change nothing."""
    return stream.writeStream.foreachBatch(lambda batch, _: insert_if_absent(batch, path, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
