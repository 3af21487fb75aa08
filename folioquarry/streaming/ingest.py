"""Structured Streaming: files into the corpus, and windows over event streams. Additions: the engine's own scope is batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioquarry.operators.lifecycle import append_new


def append_stream(spark: SparkSession, source: str, schema, target: str, checkpoint: str, files_per_trigger: int = 100) -> StreamingQuery:
    """Parquet files of documents arriving in ``source``, appended to ``target`` unless known by either digest; of those that arrive at once the least id.

    Each micro-batch is an anti-join against the digests of what is there, under the batch's own folder ``batch=<id>``: a
    batch that is run again after a failure overwrites its own folder, and its own rows don't count as known. Digests have
    a log of their own (``<target>_digests``), so a micro-batch reads two narrow columns of the past and none of its texts.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    jvm = spark.sparkContext._jvm
    log = jvm.org.apache.hadoop.fs.Path(f"{target}_digests")
    digests = "sha256 string, content_sha256 string"

    def write(batch: DataFrame, epoch: int) -> None:
        s = batch.sparkSession
        there = log.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).exists(log)
        known = s.read.schema(f"{digests}, batch bigint").parquet(f"{target}_digests").where(F.col("batch") < epoch).drop("batch") if there else s.createDataFrame([], digests)
        append_new(known, batch).write.mode("overwrite").parquet(f"{target}/batch={epoch}")
        s.read.parquet(f"{target}/batch={epoch}").select("sha256", "content_sha256").write.mode("overwrite").parquet(f"{target}_digests/batch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, at: str = "ts", key: str = "event_type", width: str = "1 day", late: str | None = "1 hour") -> DataFrame:
    """Counts and sums by time window and key, batch or streaming; with a stream, rows later than ``late`` are dropped."""
    e = events.withColumn("_at", F.col(at).cast("timestamp"))
    if events.isStreaming and late:
        e = e.withWatermark("_at", late)
    g = e.groupBy(F.window("_at", width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), key, "n", "total")


def session_windows(events: DataFrame, at: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    e = events.withColumn("_at", F.col(at).cast("timestamp"))
    if events.isStreaming and late:
        e = e.withWatermark("_at", late)
    g = e.groupBy(F.session_window("_at", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("events"))
    return g.select(key, F.col("w.start").alias("started"), "events")
