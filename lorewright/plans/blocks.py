"""Self-joins by key whose pairs are made where their rows meet, and are never shuffled. Rows that are alike but for their id
meet as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a key that meet in one group, and so many times fewer are the rows that are alike and meet as one.
BLOCK, PARTS = 2048, 8


def alike(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows (id and other columns, none null), with one row (id, the least; ids, in order) for about block / PARTS rows that differ by
    nothing but their id. Only where more are alike are they dealt by id, so that a row stays small however many there are. rows
    are read twice."""
    same, most = [c for c in rows.columns if c != "id"], max(1, block // PARTS)
    many = rows.groupBy(*same).agg(F.count("*").alias("_n")).where(F.col("_n") > most).withColumn("_parts", F.ceil(F.col("_n") / most)).drop("_n")
    dealt = rows.join(F.broadcast(many), same, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("id"), "_parts"), F.lit(0)))
    return dealt.groupBy(*same, "_part").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("id", F.col("ids")[0]).drop("_part")


def met(rows: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Pairs of rows of one key, each once and each row with itself, the other columns named with _l and _r; rows have `id`, once a
    key, and `ids`, for which they stand. A key's rows are dealt into blocks of about `block` ids, and every two blocks meet in one
    group, so a key of very many rows is no one task and a row is sent once for each block of its key. rows are read several times."""
    counts = rows.groupBy(*keys).agg(F.sum(F.size("ids")).alias("_n")).where("_n > 1")
    dealt = rows.join(counts.select(*keys, F.ceil(F.col("_n") / block).alias("_blocks")), keys).withColumn("_block", F.pmod(F.xxhash64("id"), "_blocks"))
    sent = counts.select(F.sum(F.col("_n") * F.ceil(F.col("_n") / block))).first()[0] or 0
    tasks = int(min(2000, max(rows.sparkSession.sparkContext.defaultParallelism, sent // block)))
    carried = [c for c in rows.columns if c not in keys]

    def side(s: str, low: str, high: str, ahead) -> DataFrame:
        others = F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)
        out = dealt.withColumn("_other", F.explode(F.filter(others, ahead)))
        return out.select(*keys, F.col(low).alias("_i"), F.col(high).alias("_j"), *[F.col(c).alias(f"{c}_{s}") for c in carried]).repartition(tasks, *keys, "_i", "_j")

    left = side("l", "_block", "_other", lambda o: o >= F.col("_block"))
    right = side("r", "_other", "_block", lambda o: o <= F.col("_block"))
    return left.join(right.hint("shuffle_hash"), [*keys, "_i", "_j"]).where("_i < _j or id_l <= id_r").drop("_i", "_j")


def pairs(met: DataFrame, *kept: str) -> DataFrame:
    """(left_id, right_id, the kept columns): the pairs of ids for which rows that met stand, left_id < right_id."""
    left = met.select((F.col("id_l") == F.col("id_r")).alias("_self"), "ids_r", *kept, F.explode("ids_l").alias("_a"))
    both = left.select("_self", "_a", *kept, F.explode("ids_r").alias("_b")).where("not _self or _a < _b")
    return both.select(F.least("_a", "_b").alias("left_id"), F.greatest("_a", "_b").alias("right_id"), *kept)


def apart(a: str, b: str) -> Column:
    """Whether two arrays have nothing in common."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), True).otherwise(~F.arrays_overlap(a, b))
