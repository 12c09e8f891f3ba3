"""Event streams: windows, sessions and duplicates with a watermark, and the same over tables.

Each function takes a streaming or a batch DataFrame with ts, user_id and event_type. Rows later than the watermark are
dropped by Spark; with append output a window is given once the watermark has passed it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "1 hour"


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", files_a_batch: int = 1) -> DataFrame:
    """New files of the folder as a stream; ts becomes a timestamp, which watermarks need."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = LATE, slide: str | None = None) -> DataFrame:
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("value_cents"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "value_cents")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def distinct_events(events: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """The first of equal events; a stream remembers them for the watermark's time only."""
    marked = events.withWatermark("ts", late)
    return marked.dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now, into a memory table (for small results and tests)."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return df.sparkSession.table(name)


def upsert_latest(stream: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str):
    """Each micro-batch's latest rows a key, appended with its batch id: replays overwrite nothing and read_latest() decides."""
    from ..operators.relational import latest_by_key

    def write(batch: DataFrame, batch_id: int) -> None:
        latest_by_key(batch, keys, order).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch_id_{batch_id:012d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    from ..operators.relational import latest_by_key

    return latest_by_key(spark.read.parquet(f"{path}/batch_id_*"), keys, order).drop("batch_id")
