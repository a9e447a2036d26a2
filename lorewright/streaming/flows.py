"""Structured Streaming: access logs into heat counts, and work queues drained by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ACCESS_SCHEMA = "entry_id string, op string, accessed_at timestamp"


def access_stream(spark: SparkSession, path: str) -> DataFrame:
    """The access log's JSON lines as they arrive."""
    return spark.readStream.schema(ACCESS_SCHEMA).json(path)


def daily_counts(access: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, entry_id, n) by event time; what comes later than `late` behind the newest is dropped. Heat is these counts,
    decayed when read."""
    return access.withWatermark("accessed_at", late).groupBy(F.window("accessed_at", "1 day").alias("w"), "entry_id").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "entry_id", "n")


def heat_of_counts(counts: DataFrame, as_of: str, window_days: int = 90, half_life_days: int = 30) -> DataFrame:
    """(entry_id, heat) of daily counts."""
    age = F.datediff(F.lit(as_of).cast("date"), "day")
    return counts.where(age <= window_days).groupBy("entry_id").agg(F.sum(F.col("n") * F.pow(F.lit(0.5), F.greatest(age, F.lit(0)) / half_life_days)).alias("heat"))


def drain(rows: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], key: str = "entry_id"):
    """Run all there is of a queue stream through handle, one row a key and batch; returns when it is empty."""
    once = lambda df, n: handle(df.dropDuplicates([key]), n)
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(once).start()


def to_memory(rows: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run all there is of a stream into a table of the session."""
    query = rows.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.table(name)
