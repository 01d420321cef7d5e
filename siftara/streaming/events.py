"""Streams: windows over event time, last state of a key, and redelivered messages dropped as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftara.operators.redelivery import message_key
from siftara.operators.runlog import last_record
from siftara.storage import child, file_system


def read_stream(spark: SparkSession, folder: str, schema: str, *, pattern: str = "*.parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def tumbling_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each kind in each window; rows later than ``late`` behind the newest are dropped by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of a key's events without a pause of ``gap``."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def drop_redelivered(messages: DataFrame, identifier: str, time: str, horizon: str = "30 days") -> DataFrame:
    """The first message of each identifier as they arrive; state is kept for ``horizon``. Messages without identifier all pass."""
    keyed = messages.withColumn("_key", F.coalesce(message_key(F.col(identifier)), F.concat(F.lit("\x00"), F.uuid())))
    return keyed.withWatermark(time, horizon).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def keep_last(stream: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Fold a log into a table of the last record of each key, batch by batch.

    Every batch writes a new version beside the old one; a batch that is replayed writes its own version again, so the
    result is the same after a failure.
    """
    spark = stream.sparkSession

    def fold(batch: DataFrame, number: int) -> None:
        fs, base = file_system(spark, path)
        done = sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(base) if s.getPath().getName().startswith("v=") and fs.exists(child(spark, s.getPath(), "_SUCCESS"))) if fs.exists(base) else []
        before = [v for v in done if v < number]
        rows = batch.unionByName(spark.read.parquet(f"{path}/v={before[-1]}")) if before else batch
        last_record(rows, keys, order).write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version that ``keep_last`` wrote."""
    fs, base = file_system(spark, path)
    done = [int(s.getPath().getName()[2:]) for s in fs.listStatus(base) if s.getPath().getName().startswith("v=") and fs.exists(child(spark, s.getPath(), "_SUCCESS"))]
    return spark.read.parquet(f"{path}/v={max(done)}")

