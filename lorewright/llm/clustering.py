"""Centroid clustering of integer vectors with exact assignments, screened in float32.

A batch of vectors meets all centroids in one float32 matrix product. A product's rounding error is at most
gamma * |x| * |c|, whatever the order of its sums, so each distance has an interval that surely holds it. Centroids whose
interval lies above another's upper end are out; where one is left, it is the nearest, and where intervals overlap, the distances
are worked out again in exact integers, ties to the smaller number. New centroids are exact floors of sums; tasks send sums
a cluster, which meet in Spark before the driver reads k rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.llm.exact_topk import usable
from lorewright.llm.shared import drop, written

CENTROIDS, ROUNDS, WIDE, SCALE = 40, 5, 64, 256
#: Rows screened at once, and pairs of a row and a centroid that are worked out exactly at once.
CHUNK, PAIRS = 8192, 32768
_UNIT, _LOW = 2.0**-24, (1 << 32) - 1


def kept(vectors: DataFrame, wide: int = WIDE, scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of vectors of exactly `wide` components, none null or non-finite, as integers floor(scale * component)."""
    rows = vectors.select("vec_id", "embedding").where(usable(F.col("embedding")) & (F.size("embedding") == wide))
    return rows.select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x"))


def _matrix(batch: pa.RecordBatch, wide: int) -> np.ndarray:
    column = batch.column("x")
    at = column.offsets.to_numpy()
    return column.values.to_numpy()[at[0] : at[-1]].reshape(-1, wide)


def _exact(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows; Python's integers where 64 bits might not do."""
    most = float(np.abs(rows.astype(np.float64)).max(initial=0)) + float(np.abs(centroids.astype(np.float64)).max(initial=0))
    if most * most * max(rows.shape[1], 1) < 2.0**62:
        apart = rows - centroids
        return np.einsum("ij,ij->i", apart, apart)
    apart = rows.astype(object) - centroids.astype(object)
    return (apart * apart).sum(axis=1)


def shortlist(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(row, centroid) booleans: false only where another centroid is surely nearer.

    Compared is |c|^2 - 2 x.c, a distance less |x|^2. Products of float32 values differ from x.c by at most gamma * |x| * |c|
    with gamma = m u / (1 - m u), u = 2^-24: d terms' rounding and both operands' conversion make m = d + 2; a margin of a
    millionth covers the norms' own rounding in double precision. A row whose product isn't finite keeps all centroids."""
    m = rows.shape[1] + 2
    gamma = m * _UNIT / (1 - m * _UNIT)
    with np.errstate(over="ignore", invalid="ignore"):
        product = (rows.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
        square = (centroids.astype(np.float64) ** 2).sum(axis=1)
        norms = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))[:, None] * np.sqrt(square)[None, :]
        value = square[None, :] - 2 * product
        reach = 2 * gamma * norms * 1.000001 + 2.0**-50 * (square[None, :] + 2 * norms)
        out = value - reach <= (value + reach).min(axis=1)[:, None]
    out[~np.isfinite(product).all(axis=1)] = True
    return out


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest centroid and its exact squared distance, ties to the smaller number; and how many rows had more than one
    centroid on their shortlist."""
    cluster, distance, overlapped = np.zeros(len(rows), np.int64), np.zeros(len(rows), object), 0
    for a in range(0, len(rows), CHUNK):
        part = rows[a : a + CHUNK]
        wanted = shortlist(part, centroids)
        cluster[a : a + CHUNK] = wanted.argmax(axis=1)
        several = np.flatnonzero(wanted.sum(axis=1) > 1)
        overlapped += len(several)
        for b in range(0, len(several), max(1, PAIRS // len(centroids))):
            some = several[b : b + max(1, PAIRS // len(centroids))]
            r, c = np.nonzero(wanted[some])
            apart = _exact(part[some[r]], centroids[c])
            order = np.lexsort((c, apart, r)) if apart.dtype != object else np.array(sorted(range(len(r)), key=lambda i: (r[i], apart[i], c[i])), np.int64)
            cluster[a + some] = c[order[np.flatnonzero(np.diff(r[order], prepend=-1))]]
        distance[a : a + CHUNK] = _exact(part, centroids[cluster[a : a + CHUNK]])
    return cluster, distance, overlapped


def _summed(centroids: np.ndarray):
    """Each cluster's count and sums of a task's rows; sums as multiples of 2**32 and rests, so that 64 bits do."""
    k, wide = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, high, low = np.zeros(k, np.int64), np.zeros((k, wide), np.int64), np.zeros((k, wide), np.int64)
        for batch in batches:
            rows = _matrix(batch, wide)
            cluster, _, _ = nearest(rows, centroids)
            order = np.argsort(cluster, kind="stable")
            met, starts = np.unique(cluster[order], return_index=True)
            if len(met):
                counts += np.bincount(cluster, minlength=k)
                high[met] += np.add.reduceat(rows[order] >> 32, starts, axis=0)
                low[met] += np.add.reduceat(rows[order] & _LOW, starts, axis=0)
        met = np.flatnonzero(counts)
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met]), pa.array(list(high[met]), longs), pa.array(list(low[met]), longs)], ["cluster", "n", "high", "low"])

    return run


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: the floors of the clusters' means; an empty cluster's centroid stays."""
    wide = centroids.shape[1]
    sums = rows.mapInArrow(_summed(centroids), "cluster long, n long, high array<long>, low array<long>")
    total = lambda c: F.array(*[F.sum(F.col(c)[i].cast("decimal(38,0)")).cast("string") for i in range(wide)]).alias(c)
    out = centroids.copy()
    for r in sums.groupBy("cluster").agg(F.sum("n").alias("n"), total("high"), total("low")).collect():
        out[r.cluster] = [((int(h) << 32) + int(x)) // r.n for h, x in zip(r.high, r.low, strict=True)]
    return out


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, _ = nearest(_matrix(batch, centroids.shape[1]), centroids)
            distances = pa.array([int(x) if x < 2**63 else None for x in distance], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster.astype(np.int32)), distances], ["vec_id", "cluster", "distance"])

    return run


def first_centroids(rows: DataFrame, count: int = CENTROIDS, seed: int = 2) -> np.ndarray:
    """The vectors of the smallest SHA-256 of `<seed>:<vec_id>`, in that order; rows that share an id by their vectors."""
    hashed = rows.where(F.col("vec_id").isNotNull()).select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("h"), "x")
    return np.array([r.x for r in hashed.orderBy("h", "x").limit(count).collect()], np.int64)


def clustered(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, wide: int = WIDE, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per kept row.

    vectors: vec_id long, embedding array of numbers; other columns are left, whatever their names. Kept are vectors of exactly
    `wide` components, none null or non-finite. Rows that repeat count each time; rows of a null id are assigned and summed, but
    start no centroid. Fewer kept ids than `count` make fewer centroids; without any there are no rows. Distances and
    inertias beyond 64 bits are null, clusters right all the same."""
    rows = written(kept(vectors, wide, scale), "vectors")
    centroids = first_centroids(rows, count)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    out = written(rows.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"), "clusters")
    drop(rows)
    exact = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.max(F.col("distance").isNull()).alias("lost")).collect()  # k rows at most
    inertia = {r.cluster: None if r.lost or r.s is None else int(r.s) for r in exact}
    every = None if None in inertia.values() else sum(inertia.values())
    fits = lambda x: F.lit(x if x is not None and x < 2**63 else None).cast("long")
    text = [F.sha2(F.lit(",".join(map(str, c.tolist()))).cast("binary"), 256) for c in centroids]
    of_cluster = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    own = of_cluster([fits(inertia.get(i)) for i in range(len(centroids))])
    return out.select("vec_id", "cluster", "distance", own.alias("cluster_inertia"), fits(every).alias("inertia"), of_cluster(text).alias("centroid_sha256"))
