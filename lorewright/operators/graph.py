"""Graph operators over an edge list (source_id, target_id, type, origin)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.model import EVIDENCE_TYPES
from lorewright.plans.lineage import cut, stored


def neighbors(edges: DataFrame, rel_type: str | None = None, direction: str = "both", entries: DataFrame | None = None) -> DataFrame:
    """(id, neighbor), distinct. With entries, archived neighbours are left out."""
    if direction not in ("out", "in", "both"):
        raise ValueError(f"direction: {direction}")
    own = edges if rel_type is None else edges.where(F.col("type") == rel_type)
    out = own.select(F.col("source_id").alias("id"), F.col("target_id").alias("neighbor"))
    back = own.select(F.col("target_id").alias("id"), F.col("source_id").alias("neighbor"))
    found = {"out": out, "in": back, "both": out.unionAll(back)}[direction].distinct()
    if entries is not None:
        found = found.join(entries.where("status <> 'archived'").select(F.col("id").alias("neighbor")), "neighbor", "left_semi")
    return found.select("id", "neighbor")


def related(edges: DataFrame, entries: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, id, layer): breadth-first layers both ways from each seed (id), each node once, archived nodes neither
    returned nor walked."""
    near = neighbors(edges, entries=entries)
    seen = cut(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("layer")))
    frontier = seen
    for layer in range(1, depth + 1):
        reached = frontier.join(near, "id").select("seed", F.col("neighbor").alias("id")).distinct()
        frontier = cut(reached.join(seen, ["seed", "id"], "left_anti").withColumn("layer", F.lit(layer)))
        seen = seen.unionAll(frontier)
    return seen.where("layer > 0")


def reachable_sources(entries: DataFrame, edges: DataFrame, hops: int = 9) -> DataFrame:
    """(id, source): the sources that each entry's evidence edges lead to in at most hops steps. A walk stops at a source; an
    entry that is one reaches itself.

    Sources go backwards: in each round what has newly met a source hands it to the entries whose evidence it is, so only
    pairs that are answers are ever made, each once, and an edge carries each source once."""
    kinds = entries.select("id", (F.col("kind") == "source").alias("is_source"))
    step = edges.where(F.col("type").isin(*EVIDENCE_TYPES)).select(F.col("source_id").alias("id"), F.col("target_id").alias("node")).distinct()
    step = cut(step.join(kinds.where("not is_source").select("id"), "id", "left_semi").repartition("node"))
    seen = frontier = cut(kinds.where("is_source").select("id", F.col("id").alias("source")))
    for _ in range(hops):
        handed = step.join(frontier.withColumnRenamed("id", "node"), "node").select("id", "source").distinct()
        frontier = cut(handed.join(seen, ["id", "source"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return seen


def sources_of(asked: DataFrame, entries: DataFrame, edges: DataFrame, hops: int = 9) -> DataFrame:
    """reachable_sources of the entries asked (id) alone: their walks forwards, which read the edges of what they meet."""
    kinds = entries.select("id", (F.col("kind") == "source").alias("is_source"))
    step = edges.where(F.col("type").isin(*EVIDENCE_TYPES)).select(F.col("source_id").alias("node"), F.col("target_id").alias("next")).distinct()
    ends = kinds.select(F.col("id").alias("node"), "is_source")
    seen = frontier = cut(kinds.join(asked, "id", "left_semi").select("id", F.col("id").alias("node"), "is_source"))
    for _ in range(hops):
        walked = frontier.where("not is_source").join(step, "node").select("id", F.col("next").alias("node")).distinct()
        frontier = cut(walked.join(seen, ["id", "node"], "left_anti").join(ends, "node").select("id", "node", "is_source"))
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return seen.where("is_source").select("id", F.col("node").alias("source"))


def pagerank(entries: DataFrame, edges: DataFrame, iterations: int = 100, damping: float = 0.85, tolerance: float | None = 1e-6) -> DataFrame:
    """(id, rank) of entries that aren't archived. Edges count when both ends do, parallel ones each; what dangling nodes
    hold is spread evenly. Stops when ranks move by less than tolerance in all; None runs all iterations."""
    nodes = cut(entries.where("status <> 'archived'").select("id"))
    total = nodes.count()
    if not total:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    live = edges.join(nodes.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(nodes.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    degree = live.groupBy("source_id").agg(F.count("*").alias("degree"))
    flows = cut(live.groupBy("source_id", "target_id").agg(F.count("*").alias("n")).join(degree, "source_id").select(F.col("source_id").alias("id"), "target_id", (F.col("n") / F.col("degree")).alias("share")))
    nodes = cut(nodes.join(degree.withColumnRenamed("source_id", "id"), "id", "left").select("id", F.col("degree").isNull().alias("dangling")))
    ranks = nodes.select("id", "dangling", F.lit(1.0 / total).alias("rank"))
    for i in range(iterations):
        held = ranks.agg(F.sum(F.when(F.col("dangling"), F.col("rank")))).first()[0] or 0.0
        given = flows.join(ranks.select("id", "rank"), "id").groupBy("target_id").agg(F.sum(F.col("rank") * F.col("share")).alias("given"))
        base = (1 - damping) / total + damping * held / total
        moved = ranks.join(given.withColumnRenamed("target_id", "id"), "id", "left").select("id", "dangling", F.col("rank").alias("old"), (F.lit(base) + damping * F.coalesce("given", F.lit(0.0))).alias("rank"))
        moved = cut(moved)
        ranks = moved.drop("old")
        if tolerance is not None and moved.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] < tolerance:
            break
    return ranks.select("id", "rank")


#: Layers trimmed between contractions of trees.
TRIMS = 4


def cycle_members(edges: DataFrame, rel_type: str = "supersedes") -> DataFrame:
    """(id) of nodes on a cycle of two nodes or more."""
    return strong_components(edges.where(F.col("type") == rel_type).select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))).select("id")


def strong_components(arcs: DataFrame) -> DataFrame:
    """(id, component) of the nodes of strongly connected components of two nodes or more in arcs (a, b); loops count nothing.

    A node with one way in is on a cycle only together with the node it comes from. These ways make trees, and each is contracted
    to its root; then the same is done with the only ways out, and nodes without a way in or out are trimmed, in turns while
    arcs go. So long chains, rings and chains of small cycles go in few rounds. What is left is coloured: the largest id that leads to
    a node is its colour, and nodes of a colour that lead to that id are a component. At last trees are opened in reverse order.
    Tables stay as large as the arcs, and as the nodes times the logarithm of a tree's depth."""
    arcs = stored(arcs.where("a <> b").select("a", "b").distinct())
    trees, before = [], None
    while (now := arcs.count()) not in (0, before):
        before = now
        for _ in range(TRIMS):
            left = stored(arcs.join(arcs.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(arcs.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
            had, now, arcs = now, left.count(), left
            if now in (0, had):
                break
        for _ in range(2 if now else 0):
            arcs, tree = _contracted(arcs)
            trees += [tree] if tree else []
            arcs = arcs.select(F.col("b").alias("a"), F.col("a").alias("b"))
    kept = stored(_coloured(arcs))
    for ways, steps in reversed(trees):
        kept = _opened(kept, ways, steps)
    return kept


def _contracted(arcs: DataFrame) -> tuple[DataFrame, tuple[DataFrame, list[DataFrame]] | None]:
    """Arcs with each tree of only ways in contracted to its root; and, where there are any trees, the arcs (a, b, root) that leave a tree's
    inner nodes for other trees or for the root itself, and the steps up the trees."""
    up = stored(arcs.groupBy(F.col("b").alias("id")).agg(F.count("*").alias("n"), F.min("a").alias("up")).where("n = 1").select("id", "up"))
    if up.isEmpty():
        return arcs, None
    steps = _steps(up)
    top = steps[-1].select("id", F.col("up").alias("root"))
    ways = arcs.join(top.select(F.col("id").alias("b")), "b", "left_anti").join(top.withColumnRenamed("id", "a"), "a", "left")
    ways = stored(ways.select("a", "b", "root"))
    joined = stored(ways.select(F.coalesce("root", "a").alias("a"), "b").where("a <> b").distinct())
    return joined, (ways.where("root is not null"), steps)


def _steps(up: DataFrame) -> list[DataFrame]:
    """(id, up) for 1, 2, 4, ... steps up the ways (id, up), a root at most; the last table has roots alone. Of a ring the smallest node
    is made a root."""
    open_ = up.select(F.col("id").alias("up"), F.lit(True).alias("open"))
    closed = lambda c: F.coalesce(c, F.lit(False)).alias("open")
    now = stored(up.join(open_, "up", "left").select("id", "up", closed("open"), F.col("id").alias("least")))
    steps = [now]
    for _ in range(up.count().bit_length()):
        if now.where("open").isEmpty():
            return steps
        there = now.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("open").alias("open2"), F.col("least").alias("least2"))
        moved = now.join(there, "up", "left")
        now = stored(moved.select("id", F.coalesce("up2", "up").alias("up"), closed("open2"), F.least("least", F.coalesce("least2", "least")).alias("least")))
        steps.append(now)
    on_rings = now.where("open").select(F.col("up").alias("id")).distinct()
    heads = now.join(on_rings, "id", "left_semi").select(F.col("least").alias("id")).distinct()
    return steps if heads.isEmpty() else _steps(stored(up.join(heads, "id", "left_anti")))


def _opened(kept: DataFrame, ways: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """kept (id, component) with the inner nodes of contracted trees: those from which a way leads to the root's component, and all
    between them and the root."""
    rings = ways.where("b = root").select(F.col("root").alias("id")).distinct().join(kept, "id", "left_anti").select("id", F.col("id").alias("component"))
    kept = stored(kept.unionByName(rings))
    ends = ways.join(kept.withColumnRenamed("id", "root"), "root").join(kept.select(F.col("id").alias("b"), F.col("component").alias("other")), "b")
    found = stored(ends.where("component = other").select(F.col("a").alias("id"), "component").distinct())
    if found.isEmpty():
        return kept
    for step in steps:
        found = stored(found.unionByName(found.join(step, "id").select(F.col("up").alias("id"), "component")).distinct())
    return stored(kept.unionByName(found).distinct())


def _coloured(arcs: DataFrame) -> DataFrame:
    """(id, component) of strongly connected components of two nodes or more."""
    out = arcs.sparkSession.createDataFrame([], "id string, component string")
    while not arcs.isEmpty():
        colours = cut(arcs.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("colour", F.col("id")))
        while True:
            given = arcs.join(colours.select(F.col("id").alias("a"), "colour"), "a").groupBy(F.col("b").alias("id")).agg(F.max("colour").alias("given"))
            moved = stored(colours.join(given, "id", "left").select("id", F.greatest("colour", F.coalesce("given", "colour")).alias("colour"), F.coalesce(F.col("given") > F.col("colour"), F.lit(False)).alias("moved")))
            colours = moved.select("id", "colour")
            if moved.where("moved").isEmpty():
                break
        alike = arcs.join(colours.select(F.col("id").alias("a"), "colour"), "a").join(colours.select(F.col("id").alias("b"), F.col("colour").alias("other")), "b").where("colour = other").select("a", "b")
        met = frontier = cut(colours.where("id = colour").select("id"))
        while True:
            frontier = cut(alike.join(frontier.withColumnRenamed("id", "b"), "b", "left_semi").select(F.col("a").alias("id")).distinct().join(met, "id", "left_anti"))
            if frontier.isEmpty():
                break
            met = met.unionAll(frontier)
        found = cut(colours.join(met, "id", "left_semi").select("id", F.col("colour").alias("component")))
        whole = found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
        out = out.unionByName(found.join(whole, "component", "left_semi").select("id", "component"))
        gone = found.select("id")
        arcs = cut(arcs.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b"))
    return out


def degrees(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree, degree) of every entry; parallel edges each count."""
    ends = edges.select(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("target_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return entries.select("id").join(sums, "id", "left").select("id", zero("out_degree"), zero("in_degree"), (F.coalesce("out_degree", F.lit(0)) + F.coalesce("in_degree", F.lit(0))).alias("degree"))


def isolated(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of entries that no edge touches."""
    touched = edges.select(F.col("source_id").alias("id")).unionAll(edges.select(F.col("target_id").alias("id")))
    return entries.select("id").join(touched, "id", "left_anti")


def dense_core(entries: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """Edges between entries of undirected degree of at least `least`."""
    kept = degrees(entries, edges).where(F.col("degree") >= least).select("id")
    return edges.join(kept.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(kept.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("source_id", "target_id", "type")


def domain_subgraph(entries: DataFrame, edges: DataFrame, domain: str) -> DataFrame:
    """Edges with both ends in a domain."""
    kept = entries.where(F.col("domain") == domain).select("id")
    return edges.join(kept.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(kept.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("source_id", "target_id", "type")
