"""Extensions over the event stream; the reference has no counterpart.

Windows with watermarks and sessions work on a stream as on a table; each query reads the events as a stream of files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.shared import shared_folder


def windowed_counts(events: DataFrame, watermark: str = "1 hour", width: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows; events later than the watermark are dropped from a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    made = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return made.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "12 hours") -> DataFrame:
    """(user_id, start, stop, n) of sessions that a gap ends."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    made = timed.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return made.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("session_window.end", "yyyy-MM-dd HH:mm:ss").alias("stop"), "n")


def run_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of the events, read as a stream until it has no more."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    name = f"counts_{uuid.uuid4().hex}"
    folder = shared_folder(spark)
    query = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName(name)
    query.option("checkpointLocation", f"{folder}/stream-{name}").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)
