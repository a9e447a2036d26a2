"""Ordered lists of ids as DataFrames: merges, first-seen dedupe, and the neighbourhoods that a change touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright.operators import graph


def first_seen(rows: DataFrame, key: str, place: str) -> DataFrame:
    """Each key once, where it came first."""
    return rows.groupBy(key).agg(F.min(place).alias(place))


def merged(primary: DataFrame, secondary: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, place): ids of primary (id, place), then those that only secondary has, renumbered; the first `limit`."""
    both = primary.select("id", F.lit(0).alias("part"), "place").unionAll(secondary.select("id", F.lit(1).alias("part"), "place"))
    once = both.groupBy("id").agg(F.min(F.struct("part", "place")).alias("at")).select("id", "at.part", "at.place")
    if limit is not None:
        once = once.orderBy("part", "place", "id").limit(limit)
        return once.select("id", F.row_number().over(Window.orderBy("part", "place", "id")).cast("long").alias("place"))  # `limit` rows
    from lorewright.plans.ranking import placed

    return placed(once, F.col("part"), F.col("place"), F.col("id")).select("id", "place")


def united(current: Column, new: Column) -> Column:
    """An array and what only the other has, in order."""
    return F.array_distinct(F.concat(current, new))


def tag_matches(entries: DataFrame, tags: list[str], limit: int) -> DataFrame:
    """(id, place): the first `limit` entries of each tag by id, tag after tag, each id once, `limit` in all."""
    order = F.array_position(F.array(*[F.lit(t) for t in tags]), F.col("tag"))
    rows = entries.select("id", F.explode(F.array_distinct("tags")).alias("tag")).where(F.col("tag").isin(*tags))
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("tag").orderBy("id"))).where(F.col("at") <= limit)
    once = rows.groupBy("id").agg(F.min(F.struct(order.alias("o"), "at")).alias("m")).orderBy("m", "id").limit(limit)
    return once.select("id", F.row_number().over(Window.orderBy("m", "id")).cast("long").alias("place"))


def affected(changed: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(id) of changed entries (id) and of their neighbours by the old and the new edges."""
    near = [graph.neighbors(e).join(changed.select("id"), "id", "left_semi").select(F.col("neighbor").alias("id")) for e in (old, new)]
    return changed.select("id").unionAll(near[0]).unionAll(near[1]).distinct()


def refreshed(rows: DataFrame, held: DataFrame, touched: DataFrame, key: str = "entry_id") -> DataFrame:
    """held with the touched ids' rows (id) replaced by those newly worked out."""
    ids = touched.select(F.col("id").alias(key))
    return held.join(ids, key, "left_anti").unionByName(rows.join(ids, key, "left_semi").select(*held.columns))


def mutation_order(rows: DataFrame) -> DataFrame:
    """(path, creates) in the order of application: what creates a file first, then by path."""
    return rows.orderBy(F.desc("creates"), "path")
