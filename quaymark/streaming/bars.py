"""Bars, sessions and rates in force over a stream of events (event_id, ts, user_id, event_type, value)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of a table's files; times without a zone become instants, which watermarks need."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def daily_bars(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """(ticker, day, open, high, low, close, volume), each day once it is over and late events are in."""
    at = F.struct("ts", "event_id")
    days = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), F.col("event_type").alias("ticker"))
    bars = days.agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.round(F.sum("value"), 4).alias("volume"))
    return bars.select("ticker", F.col("window.start").cast("date").alias("day"), "open", "high", "low", "close", "volume")


def user_sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user_id, begin, n_events, value): runs of a user's events with no longer gap."""
    runs = stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("value"))
    return runs.select("user_id", F.col("session_window.start").alias("begin"), "n_events", "value")


def with_rate(stream: DataFrame, decisions: DataFrame) -> DataFrame:
    """Events with the decision in force: a stream-static join on the decision's validity; decisions are a dimension."""
    spans = decisions.select("effective", "target_bp", F.lead("effective").over(_by_date()).alias("until"))
    day = F.col("ts").cast("date")
    return stream.join(F.broadcast(spans), (day >= F.col("effective")) & (F.col("until").isNull() | (day < F.col("until"))), "left").select("event_id", "effective", "target_bp")


def _by_date():
    from pyspark.sql import Window

    return Window.orderBy("effective")


def drain(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """All that a stream over files gives, as a table of a shared folder: appended files, or in complete mode those of the last batch."""
    spark = stream.sparkSession
    path = f"{folder}/{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/rows")
    if mode == "complete":
        query = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{path}/rows")).start()
    else:
        query = writer.format("parquet").option("path", f"{path}/appended").start()
    query.awaitTermination()
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{path}/rows")
    return spark.read.schema(stream.schema).parquet(f"{path}/rows", f"{path}/appended")
