"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Of all document rates in [0, MOST_COPIES] that meet each source's word constraint, the ones of greatest entropy relative to
one copy each are min(MOST_COPIES, exp(lambda * x)), x the document's size over its source's mean size and lambda the
source's multiplier. The dual is convex and falls apart by source, so Newton steps on all multipliers are one grouped
aggregation; a bracket catches steps that overshoot. A rate depends on source and size alone, so the iterations read a table
of (source, size) counts. Rates become copies by systematic rounding from the largest size to the smallest: the copies of any
prefix are within one of their rates' sum, so a source misses its target by at most about its largest document. REPAIRS
rounds then move one document of each source by one copy, the one whose size is nearest what is missing.

Sums over a source are grouped with partial aggregation; running sums go in two levels (blocks of sizes, then sizes), and a
size that many documents share is dealt into cells of about CELL documents, so no window holds a whole source. Rows that
repeat id, source and text are one bundle with a count from the start; a cell's extra copies go to its bundles in turn, so
at most one bundle a cell gets some and not all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright.llm.shared import drop, written

WEIGHTS = (1.0, 2.0, 3.0)
MOST_COPIES = 3
STEPS, TOLERANCE = 60, 1e-7
CELL, BLOCK, REPAIRS = 4096, 64, 3
#: Rows of a table that is broadcast; larger ones are joined by key.
BROADCAST = 100_000


def size_of(text: Column) -> Column:
    """Runs of non-space characters."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """Never null: 0 and the source's UTF-8 bytes, or 1 for null; it sorts as code points do, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with rank, from 0 by key. Keys are dealt by range, and a task's rank continues after the counts of the tasks
    before it; a row a task reaches the driver's plan, not a row a source."""
    dealt = written(sources.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "sources")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    return dealt.withColumn("within", within).join(before, "part").withColumn("rank", F.col("before") + F.col("within")).drop("part", "before", "within", "n")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """sources (key, source_size) with target: all sizes shared by the weights in order of key, repeating; what goes beyond
    most times a source's size is shared again among the others until none is above."""
    shares = F.expr("array(" + ",".join(f"{w!r}D" for w in weights) + ")")
    weight = F.get(shares, (F.col("rank") % len(weights)).cast("int"))
    ranked = written(_ranked(sources).withColumn("weight", weight).drop("rank"), "weights")
    ceiling = most * F.col("source_size")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        # every source at or below the level of its ceiling over its weight is full; the rest share what is left
        full = F.lit(False) if level is None else ceiling <= F.col("weight") * level
        held, rest = ranked.agg(F.sum(F.when(full, ceiling)), F.sum(F.when(~full, F.col("weight")))).first()
        if not rest:
            break
        now = (total - (held or 0)) / rest
        if level is not None and now <= level * (1 + 1e-15):
            break
        level = now
    target = F.least(ceiling.cast("double"), F.col("weight") * F.lit(float(level or 0)))
    out = written(ranked.withColumn("target", target).drop("weight"), "targets")
    drop(ranked)
    return out


def _rate(most: float) -> Column:
    """The rate of a size under its source's multiplier; a source at its ceiling takes all copies."""
    x = F.col("size") / F.col("mean")
    tilted = F.least(F.lit(float(most)), F.exp(F.least(F.col("lambda") * x, F.lit(50.0))))
    return F.when(F.col("target") >= most * F.col("source_size"), F.lit(float(most))).otherwise(tilted)


def solved(cells: DataFrame, sources: DataFrame, most: float = MOST_COPIES) -> DataFrame:
    """sources (key, source_size, documents, target) with mean and lambda, the root of the dual's gradient."""
    mean = F.greatest(F.col("source_size") / F.col("documents"), F.lit(1e-9))
    share = F.try_divide(F.col("target"), F.col("source_size"))
    low = F.when(F.col("source_size") > 0, F.least(F.log(share), F.lit(0.0)) * mean).otherwise(0.0)
    state = sources.withColumn("mean", mean).withColumn("low", low).withColumn("high", F.lit(math.log(most)) * mean).withColumn("lambda", F.lit(0.0))
    open_ = (F.col("source_size") > 0) & (F.col("target") > 0) & (F.col("target") < most * F.col("source_size"))
    state = written(state, "multipliers")
    carried = ["source_size", "documents", "target", "mean", "low", "high", "lambda"]
    for _ in range(STEPS):
        rate, held = _rate(most), F.col("n") * F.col("size")
        slope = F.sum(F.when(rate < most, held * rate * F.col("size") / F.col("mean")))
        own = [F.first(c).alias(c) for c in carried]  # one value a source, so no second join with state
        moved = cells.join(state.select("key", *carried), "key").groupBy("key").agg(F.sum(held * rate).alias("words"), slope.alias("slope"), *own)
        moved = moved.withColumn("gap", F.when(open_, F.col("words") - F.col("target")).otherwise(0.0))
        moved = moved.withColumn("low", F.when(F.col("gap") < 0, F.col("lambda")).otherwise(F.col("low")))
        moved = moved.withColumn("high", F.when(F.col("gap") > 0, F.col("lambda")).otherwise(F.col("high")))
        newton = F.when(F.col("slope") > 0, F.col("lambda") - F.col("gap") / F.col("slope"))
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        off = F.coalesce(F.try_divide(F.abs("gap"), F.col("target")), F.lit(0.0))
        halved = (F.col("low") + F.col("high")) / 2
        step = F.when(F.col("off") <= TOLERANCE, F.col("lambda")).when(inside, newton).otherwise(halved)
        moved = moved.withColumn("off", off).withColumn("lambda", step)
        before, state = state, written(moved.select("key", *carried, "off"), "multipliers")
        drop(before)
        if state.where(F.col("off") > TOLERANCE).isEmpty():
            break
    out = state.select("key", "source_size", "target", "mean", "lambda")
    out._lorewright_path = state._lorewright_path
    return out


def _repaired(cells: DataFrame, most: int) -> DataFrame:
    """cells (key, target, size, cell, n, base, extra), with one document of each source taken once more or once less where that
    brings the source nearer its target."""
    taken = F.sum(F.col("size") * (F.col("n") * F.col("base") + F.col("extra")))
    gaps = cells.groupBy("key").agg((F.first("target") - taken).alias("gap"))
    more = (F.col("gap") > 0) & (F.col("extra") < F.col("n")) & (F.col("base") < most)
    move = F.when(more, 1).when((F.col("gap") < 0) & (F.col("extra") > 0), -1)
    tried = cells.join(gaps, "key").withColumn("move", move).withColumn("after", F.abs(F.col("gap") - F.col("move") * F.col("size")))
    tried = tried.where(F.col("after") < F.abs("gap"))
    best = tried.groupBy("key").agg(F.min(F.struct("after", "size", "cell", "move")).alias("b"))
    moved = cells.join(best.select("key", "b.size", "b.cell", "b.move"), ["key", "size", "cell"], "left")
    return moved.select("key", "target", "size", "cell", "n", "base", (F.col("extra") + F.coalesce("move", F.lit(0))).alias("extra"))


def _near(table: DataFrame) -> DataFrame:
    """The table, broadcast where it is small."""
    return F.broadcast(table) if table.limit(BROADCAST + 1).count() <= BROADCAST else table


#: What tells bundles apart; id and none stand for doc_id, which may be null.
BUNDLE = ["id", "none", "key", "size", "h"]


def _named(docs: DataFrame) -> list[Column]:
    """BUNDLE of rows of docs."""
    return [
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNull().alias("none"),
        _key(F.col("source")).alias("key"), size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("h"),
    ]


def planned(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(BUNDLE, n, source_size, target, rate, base, extra): each bundle of docs' rows, how many rows it has, and the copies
    it gets: base for each row, and one more for `extra` of them."""
    rows = written(docs.select(*_named(docs)).groupBy(*BUNDLE).agg(F.count("*").alias("n")), "bundles")
    counts = written(rows.groupBy("key", "size").agg(F.sum("n").alias("n")), "counts")
    sources = counts.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("documents"))
    wanted = targets(sources, weights, most)
    multipliers = solved(counts, wanted, most)

    many = counts.where(F.col("n") > CELL).select("key", "size", F.ceil(F.col("n") / CELL).cast("int").alias("cells"))
    dealt = rows.join(_near(multipliers), "key").withColumn("rate", _rate(most)).drop("mean", "lambda")
    dealt = dealt.join(_near(many), ["key", "size"], "left")
    cell = F.pmod(F.xxhash64(F.lit(1), "id", "none", "h"), F.coalesce("cells", F.lit(1))).cast("int")
    dealt = dealt.withColumn("cell", cell).drop("cells")
    cells = dealt.groupBy("key", "size", "cell").agg(F.sum("n").alias("n"), F.max("rate").alias("rate"), F.first("target").alias("target"))
    cells = cells.withColumn("part", F.col("n") * (F.col("rate") - F.floor("rate"))).withColumn("block", F.floor(F.col("size") / BLOCK))
    cells = first = written(cells, "cells")
    blocks = cells.groupBy("key", "block").agg(F.sum("part").alias("sum"))
    earlier = Window.partitionBy("key").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("ahead", F.coalesce(F.sum("sum").over(earlier), F.lit(0.0))).drop("sum")
    inner = Window.partitionBy("key", "block").orderBy(F.desc("size"), "cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.join(blocks, ["key", "block"]).withColumn("upto", F.round(F.col("ahead") + F.sum("part").over(inner), 6))
    extra = F.floor(F.col("upto") + 0.5) - F.floor(F.round(F.col("upto") - F.col("part"), 6) + 0.5)
    cells = written(cells.select("key", "target", "size", "cell", "n", F.floor("rate").alias("base"), extra.cast("long").alias("extra")), "cells")
    drop(first)
    for _ in range(REPAIRS):
        before, cells = cells, written(_repaired(cells, most), "cells")
        drop(before)
    order = Window.partitionBy("key", "size", "cell").orderBy(F.xxhash64(F.lit(2), "id", "none"), "id", "none", "h")
    ahead = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = dealt.withColumn("ahead", ahead).join(cells.select("key", "size", "cell", F.col("extra").alias("all")), ["key", "size", "cell"])
    own = F.greatest(F.lit(0), F.least(F.col("n"), F.col("all") - F.col("ahead")))
    out = out.select(*BUNDLE, "n", "source_size", "target", "rate", F.floor("rate").cast("long").alias("base"), own.cast("long").alias("extra"))
    out = written(out, "plan")
    drop(rows, counts, wanted, multipliers, cells)
    return out


def _times(rows: DataFrame, n: Column, place: str) -> DataFrame:
    """Each row n times (none where n is 0), numbered by `place` from 1. A row of very many is split before it is spread."""
    rows = rows.withColumn("_many", n).where("_many > 0")
    split = rows.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_many") - 1) / CELL))))
    if not rows.where(F.col("_many") > CELL).isEmpty():
        split = split.repartition(F.xxhash64("_many", "_chunk", *[c for c in BUNDLE if c in rows.columns]))
    at = F.sequence(F.lit(1).cast("long"), F.least(F.lit(CELL).cast("long"), F.col("_many") - F.col("_chunk") * CELL))
    split = split.withColumn("_at", F.explode(at))
    return split.withColumn(place, F.col("_chunk") * CELL + F.col("_at")).drop("_many", "_chunk", "_at")


def copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(doc_id, key, size, source_size, target, rate, copies) of every row of docs (doc_id long, text string, source string;
    other columns are left).

    A null text has size 0; a null source is a source of its own; documents of size 0 count for nothing and keep one copy
    where their source is open. Rows that repeat id, source and text are documents of their own: of n of them some may take
    a copy more than the others. So are rows of null doc_id. An empty table gives no rows. Which documents of a cell take
    the extra copy is settled by hashes of their ids and texts, so reruns agree.
    """
    rows = _times(planned(docs, weights, most), F.col("n"), "place")
    taken = F.col("base") + F.when(F.col("place") <= F.col("extra"), 1).otherwise(0)
    doc_id = F.when(~F.col("none"), F.col("id"))
    return rows.select(doc_id.alias("doc_id"), "key", "size", "source_size", "target", "rate", taken.alias("copies"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns, whatever their names. Order does not
    matter.

    Nulls and empty tables are as in `copies`. Of n rows that repeat id, source and text each is taken base times, and the
    bundle's extra copies are those of one of them where not all get one.
    """
    plan = planned(docs, weights, most)
    rows = docs.select(*_named(docs), F.struct(*docs.columns).alias("row"))
    each = F.col("base") + F.when(F.col("extra") == F.col("n"), 1).otherwise(0)
    every = rows.join(plan.select(*BUNDLE, each.alias("each")).where("each > 0"), BUNDLE)
    out = every.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("each")))).select("row.*")
    some = plan.where("extra > 0 and extra < n")
    if not some.isEmpty():
        one = rows.join(some.select(*BUNDLE, "extra"), BUNDLE).groupBy(*BUNDLE).agg(F.first("row").alias("row"), F.max("extra").alias("extra"))
        out = out.unionAll(_times(one, F.col("extra"), "place").select("row.*"))
    return out
