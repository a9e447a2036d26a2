"""Near-duplicate embeddings by sorted projection passes.

Equal vectors are one class from the start. In each of several passes the classes are ordered by a code of concatenated random
hashes (signs of random projections of the vectors less their mean, the pass's own) and dealt by range of it, TASK_VALUES
numbers a task. A task then sorts its own range again and again: by codes of hashes of its own, taken about its own mean, so
that vectors of one dense topic, which lie to one side of most planes, are told apart as well. Every class is compared with the
WINDOW next ones of each order. Of the pairs that reach the threshold each task emits a spanning forest, so a dense group costs
its size a pass, not its square. Pairs of all passes are united into components.

Two vectors at the threshold agree in a sign with chance q. About the mean of vectors of common direction a pair's cosine is
less, and so is q; a task measures it and sorts as often as misses at most LOCAL_MISS of such pairs that lie in its range (not
less than LEAST_SORTS, not more than MOST_SORTS times). The number of passes follows from the chance that a range holds both, so
that all together miss a pair with chance MISS. Where vectors lie so near to each other that MOST_SORTS is met, more are missed;
tests hold recall against brute force.

A window would cut the links of a dense group short, so links are counted inside the components, exactly: members within half
the threshold's angle of the component's mean direction (the core) are all linked with each other by the triangle inequality and
are counted, not compared; every other member (the rim) is compared with all of its component, blocks of the rim against pieces
of the component, each pair of these in a group of its own. The work is the rim times the component: a component of many vectors
that is no tight cluster costs about its square, as its links, all of which are to be counted, may.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.llm.components import connected_components
from lorewright.llm.exact_topk import usable
from lorewright.llm.shared import drop, written

THRESHOLD, WINDOW = 0.95, 32
#: The chances of missing a pair at the threshold in all passes, and in the sorts of a task that holds both.
MISS, LOCAL_MISS = 1e-4, 0.1
LEAST_PASSES, LEAST_SORTS, MOST_SORTS = 6, 4, 64
#: Numbers that a task sorts and compares; rim members and members of a component that meet in one group.
TASK_VALUES, BLOCK, PIECE = 4_000_000, 512, 4096


def units(column: pa.Array) -> np.ndarray:
    """(rows, dimensions) float64 vectors of length 1; the lists are of one length."""
    at = column.offsets.to_numpy()
    x = column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def agreement(threshold: float, common: float = 0.0) -> float:
    """The chance that two vectors at the threshold agree in a sign about their mean, when two at random are at cosine
    `common`."""
    common = min(max(common, 0.0), threshold - 1e-6)
    return 1 - math.acos((threshold - common) / (1 - common)) / math.pi


def passes_for(tasks: int, threshold: float, common: float) -> int:
    """Passes over so many ranges that miss a pair at the threshold with chance MISS."""
    met = agreement(threshold, common) ** math.log2(max(tasks, 1)) * (1 - LOCAL_MISS)
    return max(LEAST_PASSES, math.ceil(math.log(MISS) / math.log1p(-met)))


def sorts_for(rows: int, threshold: float, common: float, window: int) -> int:
    """Sorts of a task's rows that miss a pair at the threshold with chance LOCAL_MISS."""
    met = agreement(threshold, common) ** max(0.0, math.log2(max(rows, 1) / window))
    return min(MOST_SORTS, max(LEAST_SORTS, 1 if met >= 1 else math.ceil(math.log(LOCAL_MISS) / math.log1p(-met))))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's unit vectors of each dimension: how many, and their sum."""
    found: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            x = units(batch.filter(pa.array(dims == dim)).column("v"))
            n, total = found.get(dim, (0, np.zeros(dim)))
            found[dim] = (n + len(x), total + x.sum(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(found), pa.int32()), pa.array([n for n, _ in found.values()], pa.int64()), pa.array([t for _, t in found.values()], pa.list_(pa.float64()))], ["dim", "n", "total"]
    )


def _means(classes: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """How many vectors each dimension has, and their mean; a row a task and dimension reaches the driver."""
    found: dict[int, tuple[int, np.ndarray]] = {}
    for r in classes.select("dim", "v").mapInArrow(_sums, "dim int, n long, total array<double>").collect():
        n, total = found.get(r.dim, (0, np.zeros(r.dim)))
        found[r.dim] = (n + r.n, total + np.array(r.total))
    return {dim: (n, total / n) for dim, (n, total) in found.items()}


def _signs(x: np.ndarray, seed: list[int]) -> np.ndarray:
    """63 signs of random projections, as a number."""
    planes = np.random.default_rng(seed).standard_normal((x.shape[1], 63))
    return ((x @ planes) > 0) @ (1 << np.arange(62, -1, -1, dtype=np.int64))


def _codes(passes: int, means: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                x = units(own.column("v")) - means[dim]
                for p in range(passes):
                    columns = [pa.array(np.full(len(x), p, np.int32)), own.column("dim"), pa.array(_signs(x, [p, dim])), own.column("id"), own.column("v")]
                    yield pa.RecordBatch.from_arrays(columns, ["pass", "dim", "code", "id", "v"])

    return run


def _forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray, above: dict[int, int]) -> Iterator[tuple[int, int]]:
    def top(i: int) -> int:
        while (up := above.get(i, i)) != i:
            above[i] = above.get(up, up)
            i = up
        return i

    for i, j in zip(ids[a].tolist(), ids[b].tolist(), strict=True):
        p, q = top(i), top(j)
        if p != q:
            above[max(p, q)] = min(p, q)
            yield i, j


def range_links(ids: np.ndarray, x: np.ndarray, threshold: float, window: int, seed: list[int], block: int = 128) -> list[tuple[int, int]]:
    """A spanning forest of the pairs at the threshold that lie within the window in one of the range's sorts."""
    mean = x.mean(axis=0)
    common = float(mean @ mean)
    above: dict[int, int] = {}
    pairs: list[tuple[int, int]] = []
    for s in range(sorts_for(len(x), threshold, common, window)):
        order = np.lexsort((ids, _signs(x - mean, [*seed, s])))
        own, y = ids[order], x[order]
        for i in range(0, len(y), block):
            near = y[i : i + block] @ y[i : i + block + window].T
            r, c = np.nonzero(near >= threshold)
            met = (c > r) & (c <= r + window)
            pairs += _forest(own, i + r[met], i + c[met], above)
    return pairs


def _windows(threshold: float, window: int):
    """Rows come by (pass, dim, code); each run of a task's is sorted and compared whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def met() -> pa.RecordBatch:
            pairs = range_links(np.concatenate([i for i, _ in held]), np.concatenate([x for _, x in held]), threshold, window, [int(k) for k in key]) if held else []
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.int64()), pa.array([q for _, q in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column("pass").to_numpy(), batch.column("dim").to_numpy()])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if key != tuple(keys[:, a]):
                    if held:
                        yield met()
                    key = tuple(keys[:, a])
                held.append((batch.column("id").slice(a, b - a).to_numpy(), units(batch.column("v").slice(a, b - a))))
        if held:
            yield met()

    return run


def _directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's sum of unit vectors of each component; its rows come sorted by component."""
    last, total = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        component = batch.column("component").to_numpy()
        edges = [0, *(np.flatnonzero(component[1:] != component[:-1]) + 1), len(component)]
        done: list[tuple[int, np.ndarray]] = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = units(batch.column("v").slice(a, b - a)).sum(axis=0)
            if last is not None and component[a] == last:
                total = total + own
                continue
            if last is not None:
                done.append((last, total))
            last, total = component[a], own
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([t for _, t in done], pa.list_(pa.float64()))], ["component", "total"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([total], pa.list_(pa.float64()))], ["component", "total"])


def _cores(half: float):
    """Whether a member lies in its component's core: within half the threshold's angle of the mean direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, core = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, bool)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(own))
                core[own] = (units(part.column("v")) * units(part.column("middle"))).sum(axis=1) >= half
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("component", "id", "n", "v", "dim")), pa.array(core)], ["component", "id", "n", "v", "dim", "core"])

    return run


def _rims(threshold: float, most: int = 2048):
    """Counts of links with rim members. Rows come by (component, block, piece), the block's rim first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rim_ids, rim, rim_n = None, np.zeros(0, np.int64), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in ("component", "block", "piece")])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            out_ids, out_n = [], []
            asks, core = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "core"))
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                ids, n, x = batch.column("id").to_numpy()[s:e], batch.column("n").to_numpy()[s:e], units(batch.column("v").slice(s, e - s))
                if key != tuple(keys[:, s]):
                    key, rim_ids, rim, rim_n = tuple(keys[:, s]), ids[:0], x[:0], n[:0]
                a = asks[s:e]
                rim_ids, rim, rim_n = np.concatenate([rim_ids, ids[a]]), np.concatenate([rim, x[a]]), np.concatenate([rim_n, n[a]])
                ids, n, x, c = ids[~a], n[~a], x[~a], core[s:e][~a]
                for i in range(0, len(ids), most):
                    linked = (x[i : i + most] @ rim.T >= threshold) & (ids[i : i + most, None] != rim_ids[None, :])
                    inner = c[i : i + most]
                    out_ids += [rim_ids, ids[i : i + most][inner]]
                    out_n += [n[i : i + most] @ linked, (linked @ rim_n)[inner]]
            flat = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in (out_ids, out_n)]
            some = flat[1] > 0
            yield pa.RecordBatch.from_arrays([pa.array(flat[0][some]), pa.array(flat[1][some].astype(np.int64))], ["id", "links"])

    return run


def linked_pairs(classes: DataFrame, threshold: float, passes: int | None, window: int) -> DataFrame:
    """(a, b): spanning forests of the near pairs of classes (id, dim, v) that the passes meet."""
    means = _means(classes)
    total = sum(n for n, _ in means.values())
    wide = max(means, default=1)
    tasks = max(1, -(-total * wide // TASK_VALUES))
    common = max((float(m @ m) for _, m in means.values()), default=0.0)
    passes = passes_for(tasks, threshold, common) if passes is None else passes
    coded = classes.select("dim", "id", "v").mapInArrow(
        _codes(passes, {d: m for d, (_, m) in means.items()}), f"pass int, dim int, code long, id long, v {classes.schema['v'].dataType.simpleString()}"
    )
    dealt = coded.repartitionByRange(tasks * passes, "pass", "dim", "code", "id").sortWithinPartitions("pass", "dim", "code", "id")
    return dealt.mapInArrow(_windows(threshold, window), "a long, b long").distinct()


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, passes: int | None = None, window: int = WINDOW) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id long, embedding array of numbers; other columns
    are left, whatever their names).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and keep themselves, as do
    rows of null vec_id, whose component is null. Vectors of different length don't link. n_links counts the component's
    other rows at the threshold; rows that repeat a vec_id count each. An empty table gives no rows.
    """
    fine = usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull()
    kind = vectors.schema["embedding"].dataType.elementType
    numbers = F.when(fine, F.transform("embedding", lambda x: x + F.lit(0).cast(kind)))  # -0 becomes 0
    rows = vectors.select("vec_id", numbers.alias("v"))
    rows = written(rows.withColumn("x", F.xxhash64(F.lit(1), "v")).withColumn("y", F.xxhash64(F.lit(2), "v")), "vectors")
    classes = rows.where("v is not null").groupBy("x", "y").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = written(classes.withColumn("dim", F.size("v")), "classes")
    links = written(linked_pairs(classes, threshold, passes, window), "links")
    groups = connected_components(links).withColumnRenamed("node", "id")

    v = f"v {classes.schema['v'].dataType.simpleString()}"
    members = written(groups.join(classes, "id").select("component", "id", "n", "v", "dim"), "members")
    sums = members.select("component", "v").sortWithinPartitions("component").mapInArrow(_directions, "component long, total array<double>")
    spread = sums.select("component", F.posexplode("total").alias("at", "x")).groupBy("component", "at").agg(F.sum("x").alias("x"))
    middle = spread.groupBy("component").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("m"))  # a row a dimension
    middle = middle.select("component", F.col("m.x").alias("middle"))
    half = math.sqrt((1 + threshold) / 2) + 1e-9
    cored = members.join(middle, "component").select("component", "id", "n", "v", "dim", "middle")
    cored = written(cored.mapInArrow(_cores(half), f"component long, id long, n long, {v}, dim int, core boolean"), "cores")
    parts = lambda c, size: F.ceil(c / size).cast("int")
    sizes = cored.groupBy("component").agg(
        F.sum(F.when(F.col("core"), F.col("n"))).alias("core_n"), parts(F.count(F.when(~F.col("core"), 1)), BLOCK).alias("blocks"), parts(F.count("*"), PIECE).alias("pieces")
    )
    sizes = written(sizes, "sizes")
    open_ = cored.join(sizes.where("blocks > 0").drop("core_n"), "component")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    rest = ["component", "id", "n", "v", "core"]
    asking = open_.where(~F.col("core")).select(*rest, F.pmod(F.hash("id"), F.col("blocks")).alias("block"), every("pieces").alias("piece"), F.lit(True).alias("asks"))
    answering = open_.select(*rest, every("blocks").alias("block"), F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece"), F.lit(False).alias("asks"))
    met = asking.unionAll(answering).repartition("component", "block", "piece").sortWithinPartitions("component", "block", "piece", F.desc("asks"), "id")
    rim = met.mapInArrow(_rims(threshold), "id long, links long").groupBy("id").agg(F.sum("links").alias("rim_links"))
    counted = cored.join(sizes.select("component", "core_n"), "component").join(rim, "id", "left")
    inside = F.when(F.col("core"), F.col("core_n") - F.col("n")).otherwise(0) + F.coalesce("rim_links", F.lit(0))
    counted = written(counted.select("id", "component", inside.alias("inside")), "counted")
    drop(links, groups, members, cored, sizes)

    named = rows.join(classes.select("x", "y", "id", "n").join(counted, "id", "left"), ["x", "y"], "left")
    named = named.withColumn("valid", F.col("v").isNotNull() & F.col("id").isNotNull())
    component = F.when(F.col("valid"), F.coalesce("component", "id")).otherwise(F.col("vec_id"))
    links_ = F.when(F.col("valid"), F.col("n") - 1 + F.coalesce("inside", F.lit(0))).otherwise(0)
    kept = F.coalesce(F.col("vec_id") == component, F.lit(True))
    return named.select("vec_id", links_.cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))
