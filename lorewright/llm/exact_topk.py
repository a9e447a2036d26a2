"""Exact inner-product top-k by block-at-a-time pruning.

Vectors are documents and dimensions terms. Documents are ordered by a sign code, so that a range of them is alike, and cut
into ranges (shards, one a task) and blocks of BLOCK rows. A shard and a block keep each term's largest and smallest value;
a block has a forward index, its rows' integers. A query's bound on either sums, over its terms, the larger product with the
two. Blocks are scored in order of bounds until a bound falls below the query's kth score so far (equal bounds are scored,
for ties).

The first pass scores each query in its own shard, which gives it a kth score to start from. The second sends it, with that
score, to those other shards whose bound reaches it. A task holds its shard and lets queries stream by, so documents are
shuffled once whatever the number of queries. What the passes find meets in a partial top-k per query.

How much is pruned is up to the data: vectors in tight clusters leave out most shards and blocks; for vectors without any
common direction a block's summed maxima exceed every score, and all pairs are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright.llm.shared import drop, written

K, SCALE, DIVISOR = 5, 256, 50
#: Rows of a shard on large tables and the fewest on small ones, rows of a block, queries that are scored at once, and
#: shards whose bounds (two rows of terms each) are kept on the driver; with more shards queries go to all of them.
SHARD, LEAST_SHARD, BLOCK, CHUNK, MOST_SHARDS = 65536, 4096, 64, 256, 16384
RESULT = "query_id long, vec_id long, score long"


def usable(embedding: Column) -> Column:
    """Neither null nor holding null or non-finite components."""
    return F.coalesce(F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def _matrix(columns: list[np.ndarray]) -> np.ndarray:
    """Rows of integers; shorter vectors end in zeros."""
    wide = max(map(len, columns), default=0)
    out = np.zeros((len(columns), wide), np.int64)
    for i, x in enumerate(columns):
        out[i, : len(x)] = x
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, by floats where these hold every sum exactly, else by integers."""
    wide = min(a.shape[1], b.shape[1])
    a, b = a[:, :wide], b[:, :wide]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(wide, 1)
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 2**53 else a @ b.T


def _bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """(query, range): no row of the range scores more; high and low are its terms' extremes."""
    wide = min(queries.shape[1], high.shape[1])
    q = queries[:, :wide]
    return _product(np.maximum(q, 0), high[:, :wide]) + _product(np.minimum(q, 0), low[:, :wide])


class Blocks:
    """The block index of one shard."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, size: int = BLOCK):
        self.ids, self.rows, self.edges = ids, rows, [(i, min(i + size, len(ids))) for i in range(0, len(ids), size)]
        starts = [a for a, _ in self.edges]
        self.high, self.low = np.maximum.reduceat(rows, starts, axis=0), np.minimum.reduceat(rows, starts, axis=0)
        self.scored = 0  # pairs so far

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query's row: its number, the ids and the scores of its k best, its own row left out; of those below its
        floor (a score that k rows elsewhere reach) any may be missing. Block by block in the order of each query's bounds;
        queries that ask for the same block next are scored together."""
        bounds = _bounds(queries, self.high, self.low)
        order = np.argsort(-bounds, axis=1, kind="stable")
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(own)
        kth = np.full(len(own), np.iinfo(np.int64).min) if floor is None else floor.copy()
        active = np.arange(len(own))
        for step in range(len(self.edges)):
            wanted = order[active, step]
            going = bounds[active, wanted] >= kth[active]
            active, wanted = active[going], wanted[going]
            if not len(active):
                break
            for block in np.unique(wanted):
                a, b = self.edges[block]
                asking = active[wanted == block]
                scores = _product(queries[asking], self.rows[a:b])
                self.scored += scores.size
                good = scores >= kth[asking, None]
                for r in np.flatnonzero(good.any(axis=1)):
                    q, hit = asking[r], good[r]
                    ids, s = np.concatenate([best[q][0], self.ids[a:b][hit]]), np.concatenate([best[q][1], scores[r][hit]])
                    other = ids != own[q]
                    ids, s = ids[other], s[other]
                    first = np.lexsort((ids, -s))[:k]
                    best[q] = (ids[first], s[first])
                    if len(first) == k:
                        kth[q] = max(kth[q], s[first[-1]])
        for q, (ids, s) in enumerate(best):
            yield q, ids, s


def _vectors(batch: pa.RecordBatch, a: int, b: int) -> list[np.ndarray]:
    column = batch.column("v")
    at, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[at[i] : at[i + 1]] for i in range(a, b)]


def _shards(k: int, block: int):
    """Rows come by shard, its documents first; the queries stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held_ids, held, index = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            shards, asks = batch.column("shard").to_numpy(), batch.column("asks").to_numpy()
            edges = [0, *(np.flatnonzero((shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1])) + 1), batch.num_rows]
            out: list[tuple[np.ndarray, ...]] = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if shards[a] != shard:
                    shard, held_ids, held, index = shards[a], [], [], None
                ids = batch.column("vec_id").slice(a, b - a).to_numpy()
                if not asks[a]:
                    held_ids.append(ids)
                    held += _vectors(batch, a, b)
                    continue
                if not held:
                    continue
                if index is None:
                    index = Blocks(np.concatenate(held_ids), _matrix(held), block)
                floor, vectors = batch.column("floor").slice(a, b - a).to_numpy(), _vectors(batch, a, b)
                for s in range(0, b - a, CHUNK):
                    own = ids[s : s + CHUNK]
                    for q, found, scores in index.search(own, _matrix(vectors[s : s + CHUNK]), k, floor[s : s + CHUNK]):
                        out.append((np.full(len(found), own[q]), found, scores))
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else [()] * 3)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in flat], ["query_id", "vec_id", "score"])

    return run


def _extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each shard's terms' largest and smallest values in the task's rows."""
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        rows = _matrix(_vectors(batch, 0, batch.num_rows))
        for shard in np.unique(shards):
            own = rows[shards == shard]
            found[shard] = _wider(found.get(shard), (own.max(axis=0), own.min(axis=0)))
    high, low = [x for x, _ in found.values()], [y for _, y in found.values()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(found), pa.int32()), pa.array(high, pa.list_(pa.int64())), pa.array(low, pa.list_(pa.int64()))], ["shard", "high", "low"]
    )


def _wider(one: tuple | None, other: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The extremes of both; a shorter vector's missing terms are zeros."""
    if one is None:
        return other
    wide = max(len(one[0]), len(other[0]))
    (a, b), (c, d) = ([np.pad(x, (0, wide - len(x))) for x in pair] for pair in (one, other))
    return np.maximum(a, c), np.minimum(b, d)


def _wanted(high: np.ndarray, low: np.ndarray):
    """Each query once for every other shard whose bound reaches its floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                part = batch.slice(a, CHUNK)
                own, floor = part.column("shard").to_numpy(), part.column("floor").to_numpy()
                going = _bounds(_matrix(_vectors(part, 0, part.num_rows)), high, low) >= floor[:, None]
                going[np.arange(len(own)), own] = False
                q, shard = np.nonzero(going)
                rest = part.take(pa.array(q))
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), *(rest.column(c) for c in ("vec_id", "v", "floor"))], ["shard", "vec_id", "v", "floor"])

    return run


def top_k(vectors: DataFrame, k: int = K, divisor: int = DIVISOR, scale: int = SCALE, shard: int = SHARD, least: int = LEAST_SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by divisor its k highest integer inner
    products with every row of another vec_id, ties to the smaller vec_id, ranks from 1; all, if fewer.

    vectors: vec_id long, embedding array of numbers; other columns are left, whatever their names. A component x counts as
    floor(scale * x), x as double. Vectors that are null or hold null or non-finite components, and rows of null vec_id,
    take no part; of rows that repeat a vec_id, all are candidates and the queries are one for each distinct vector.
    Shorter vectors end in zeros. Sums beyond 64 bits wrap. No usable rows give no rows.
    """
    rows = vectors.where(F.col("vec_id").isNotNull()).select("vec_id", "embedding").where(usable(F.col("embedding")))
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    signs = F.aggregate(F.slice(F.col("v"), 1, 48), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1) + (x > 0).cast("long"))
    rows = written(rows.withColumn("code", signs), "integers")
    total = rows.count()
    spark = vectors.sparkSession
    count = max(1, -(-total // shard), min(-(-total // least), 4 * spark.sparkContext.defaultParallelism))
    dealt = rows.repartitionByRange(count, "code", "vec_id").withColumn("shard", F.spark_partition_id())
    dealt = written(dealt, "shards")
    drop(rows)
    parts = (dealt.agg(F.max("shard")).first()[0] or 0) + 1
    lowest = F.lit(-(2**63))
    docs = dealt.select("shard", F.lit(0).alias("asks"), "vec_id", "v", lowest.alias("floor"))
    queries = dealt.where(F.col("vec_id") % divisor == 0).groupBy("vec_id", "v").agg(F.min("shard").alias("shard"))
    queries = written(queries, "queries")

    def met(asking: DataFrame) -> DataFrame:
        asked = asking.select("shard", F.lit(1).alias("asks"), "vec_id", "v", "floor")
        cells = docs.unionAll(asked).repartitionById(parts, F.col("shard")).sortWithinPartitions("shard", "asks", "vec_id")
        return cells.mapInArrow(_shards(k, block), RESULT)

    first = found = written(met(queries.withColumn("floor", lowest)), "found")
    if parts > 1:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        kth = first.withColumn("place", place).where(F.col("place") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
        asking = queries.join(kth, "vec_id", "left").withColumn("floor", F.coalesce("floor", lowest))
        if parts <= MOST_SHARDS:
            extremes: dict[int, tuple] = {}
            for r in dealt.select("shard", "v").mapInArrow(_extremes, "shard int, high array<long>, low array<long>").collect():
                extremes[r.shard] = _wider(extremes.get(r.shard), (np.array(r.high, np.int64), np.array(r.low, np.int64)))
            none = (np.zeros(0, np.int64),) * 2
            high, low = (_matrix([extremes.get(i, none)[x] for i in range(parts)]) for x in (0, 1))
            asking = asking.select("shard", "vec_id", "v", "floor").mapInArrow(_wanted(high, low), "shard int, vec_id long, v array<long>, floor long")
        else:
            others = F.filter(F.sequence(F.lit(0), F.lit(parts - 1)), lambda s: s != F.col("shard"))
            asking = asking.select(F.explode(others).alias("shard"), "vec_id", "v", "floor")
        found = first.unionAll(met(asking))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
