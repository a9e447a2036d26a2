"""Exact percentiles without one buffer a group: distinct values with their counts, sorted by range, and places by running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewright.plans.lineage import cut


def quantiles(rows: DataFrame, points: tuple[float, ...]) -> DataFrame:
    """(group, count, min, max, p...) of rows (group, value): percentiles by linear interpolation, named p and the percent.
    Null values count nowhere; a group of none has count 0 and nulls.

    Values are counted before they move, so one that very many rows share is one row. Distinct values are dealt by range of
    (group, value); what lies before a range is a sum over ranges, and the two values beside each place are found by it."""
    counts = rows.groupBy("group", "value").agg(F.count("value").alias("n"))
    sorted_ = cut(counts.repartitionByRange("group", "value").withColumn("part", F.spark_partition_id()))
    facts = sorted_.groupBy("group").agg(F.sum("n").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"))
    ranges = sorted_.groupBy("group", "part").agg(F.sum("n").alias("n"))  # at most a row a group and range
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("group", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("part", "group").orderBy("value")
    held = sorted_.where("n > 0").withColumn("upto", F.sum("n").over(within)).join(ranges, ["group", "part"])
    held = held.select("group", "value", (F.col("ahead") + F.col("upto") - F.col("n")).alias("first"), (F.col("ahead") + F.col("upto") - 1).alias("last"))
    place = lambda p: (F.col("count") - 1) * F.lit(float(p))
    places = F.array(*[F.struct(F.lit(i).alias("i"), place(p).alias("at")) for i, p in enumerate(points)])
    asked = facts.where("count > 0").select("group", F.explode(places).alias("t")).select("group", "t.i", "t.at")
    met = held.join(asked, "group").where((F.col("first") <= F.ceil("at")) & (F.col("last") >= F.floor("at")))
    # the lower value holds the place's floor, the higher its ceiling; they may be one
    low, high = F.min("value"), F.max(F.when(F.col("first") <= F.ceil("at"), F.col("value")))
    found = met.groupBy("group", "i").agg((low + (high - low) * F.first(F.col("at") - F.floor("at"))).alias("value"))
    named = [F.max(F.when(F.col("i") == i, F.col("value"))).alias(f"p{int(p * 100)}") for i, p in enumerate(points)]
    return facts.join(found.groupBy("group").agg(*named), "group", "left")
