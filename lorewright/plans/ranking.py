"""Places in a total order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright.plans.lineage import cut


def placed(rows: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """rows with their place from 1 in a total order. They are dealt by range of it; a range's places go on behind the counts
    of the ranges before, so only a row a range meets in one task."""
    part, within, ahead = "_lw_part", "_lw_within", "_lw_ahead"
    dealt = cut(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    counts = dealt.groupBy(part).agg(F.count("*").alias("_lw_n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(part, F.coalesce(F.sum("_lw_n").over(before), F.lit(0)).alias(ahead))
    own = dealt.withColumn(within, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    out = own.join(counts, part).withColumn(name, (F.col(ahead) + F.col(within)).cast("long"))
    return out.drop(part, within, ahead)
