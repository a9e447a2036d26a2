"""MinHash near-duplicates by a signature-coordinate inverted join.

Every distinct shingle set is posted under each of its COORDINATES (coordinate, minimum) pairs. A pair of sets counts as a
candidate when at least MATCHES of its coordinates collide; only such pairs are confirmed, on the full sets.

* Prefix: sets with fewer than MATCHES shared coordinates have no partner and go. Of the others' shared coordinates, the
  MATCHES - 1 most frequent are left out: a pair with MATCHES collisions still meets in what stays, and very frequent
  coordinates (those of passages that many documents repeat) are what is left out first.
* Skip: coordinates left out are never merged. A pair met in the prefix has all its collisions counted by comparing the two
  signatures, which is a lookup and no list.
* Groups: equal sets are one class from the start. The first merge links each list's members to the list's smallest one, so
  a group of m near copies costs about m pairs; the second merge meets members of different components only, those outside
  a list's largest component with all of it, in blocks, each pair once (in the most frequent coordinate of both prefixes),
  and emits the confirmed links that join two components: at most a tree a block, however many pairs come close to the
  threshold.

A pair of similarity 0.85 misses MATCHES = 38 of 64 collisions with a chance of about 5e-7, one of 0.9 with 1e-10; nothing
else is approximate. Rows whose doc_id is null take no part and keep themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorewright.llm.components import connected_components
from lorewright.llm.kernel import buffers, mix, shingle_sets, slices
from lorewright.llm.shared import drop, written

WIDTH = 5
PERCENT = 85
COORDINATES = 64
MATCHES = 38
#: Documents of a list that ask in one group, and that answer there, each of at most SHINGLES shingles (a longer one counts
#: as several); answers that are compared at once.
BLOCK, PIECE, SHINGLES, ANSWERING = 512, 1024, 4096, 1024


def _family(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * coordinates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:coordinates] | np.uint64(1)), seeds[coordinates:]


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 4096) -> np.ndarray:
    """Per coordinate the smallest image of the set, as 32 bits."""
    least = np.full(len(a), np.uint64(2**64 - 1))
    for i in range(0, len(shingles), block):
        np.minimum(least, ((shingles[None, i : i + block] ^ b[:, None]) * a[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _signatures(width: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _family(coordinates)
        for whole in batches:
            for batch in slices(whole, "text"):
                n, x, y, sig = [], [], [], np.zeros((batch.num_rows, coordinates), np.uint32)
                for i, s in enumerate(shingle_sets(*buffers(batch.column("text")), width)):
                    n.append(len(s))
                    x.append(s.sum(dtype=np.uint64).view(np.int64))
                    y.append(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))
                    if len(s):
                        sig[i] = signature(s, a, b)
                at = pa.array(np.arange(0, (len(n) + 1) * coordinates, coordinates, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.ListArray.from_arrays(at, pa.array(sig.ravel().view(np.int32)))],
                    ["doc_id", "n_shingles", "x", "y", "sig"],
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = list(shingle_sets(*buffers(batch.column("text")), width))
                at = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(found).view(np.int64)))], ["id", "shingles"])

    return run


def _collisions(a: str, b: str) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("p")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("q"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("p", "q")).cast("long"))
    return both.where(100 * F.col("common") >= percent * (F.size("p") + F.size("q") - F.col("common"))).select("a", "b")


def _rows_of(column: pa.Array, a: int, b: int) -> list[np.ndarray]:
    """The lists of rows a to b."""
    at = column.offsets.to_numpy()
    values = column.values.to_numpy()
    return [values[at[i] : at[i + 1]] for i in range(a, b)]


class _Side:
    """Members of one list: those that ask, or a run of those that answer."""

    def __init__(self, batch: pa.RecordBatch, a: int, b: int, sets: bool):
        self.ids, self.component, self.n, self.minor = (
            batch.column(c).slice(a, b - a).to_numpy(zero_copy_only=False) for c in ("id", "component", "n", "minor")
        )
        self.sig = np.stack(_rows_of(batch.column("sig"), a, b))
        self.prefix = _rows_of(batch.column("prefix"), a, b)
        self.sets = [np.sort(x.view(np.uint64)) for x in _rows_of(batch.column("shingles"), a, b)] if sets else []

    def add(self, other: _Side) -> None:
        for c in ("ids", "component", "n", "minor", "sig"):
            setattr(self, c, np.concatenate([getattr(self, c), getattr(other, c)]))
        self.prefix += other.prefix
        self.sets += other.sets


def _hits(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Equal coordinates of each row of p with each of q."""
    if len(p) * len(q) <= 4096:
        return (p[:, None, :] == q[None, :, :]).sum(axis=2)
    out = np.zeros((len(p), len(q)), np.uint16)
    for x, y in zip(np.ascontiguousarray(p.T), np.ascontiguousarray(q.T), strict=True):
        out += x[:, None] == y[None, :]
    return out


def _candidates(asking: _Side, answering: _Side, token: int, matches: int, percent: int) -> np.ndarray:
    """(asking, answering) pairs of two components that have `matches` collisions, sets of fitting sizes, and no common
    prefix coordinate more frequent than this list's. Of two that both ask, the smaller id does."""
    found = _hits(asking.sig, answering.sig) >= matches
    found &= asking.component[:, None] != answering.component[None, :]
    found &= ~answering.minor[None, :] | (asking.ids[:, None] < answering.ids[None, :])
    small, large = np.minimum.outer(asking.n, answering.n), np.maximum.outer(asking.n, answering.n)
    found &= 100 * small >= percent * large
    if not found.any():
        return found
    above = [[x[int(np.flatnonzero(x == token)[0]) + 1 :] for x in side.prefix] for side in (asking, answering)]
    names = np.unique(np.concatenate([*above[0], *above[1]]))
    marks = []
    for lists in above:
        mark = np.zeros((len(lists), len(names)), np.float32)
        mark[np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.searchsorted(names, np.concatenate(lists))] = 1
        marks.append(mark)
    return found & (marks[0] @ marks[1].T == 0)


def _top(above: dict[int, int], x: int) -> int:
    while (up := above.get(x, x)) != x:
        above[x] = above.get(up, up)
        x = up
    return x


def _links(found: np.ndarray, p: _Side, q: _Side, above: dict[int, int], percent: int) -> Iterator[tuple[int, int]]:
    """Of the pairs, confirmed on full sets, those that join two components; above holds the unions made so far."""
    for x, y in np.argwhere(found):
        a, b = _top(above, int(p.component[x])), _top(above, int(q.component[y]))
        if a == b:
            continue
        small, large = sorted((p.sets[x], q.sets[y]), key=len)
        common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
        if 100 * common >= percent * (len(small) + len(large) - common):
            above[a] = b
            yield p.ids[x], q.ids[y]


def _met(matches: int, percent: int, confirm: bool):
    """Rows come by (token, block, piece), those that ask first. They are held; the others stream by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, above = None, None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in ("token", "block", "piece", "asks")])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            out: list[tuple[int, int]] = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if key != tuple(keys[:3, a]):
                    key, held, above = tuple(keys[:3, a]), None, {}
                for s in range(a, b, ANSWERING):
                    side = _Side(batch, s, min(s + ANSWERING, b), confirm)
                    if keys[3, a]:
                        held = side if held is None else (held.add(side) or held)
                        continue
                    if held is None:
                        continue
                    found = _candidates(held, side, key[0], matches, percent)
                    if confirm:
                        out += _links(found, held, side, above, percent)
                    else:
                        ids = np.concatenate([held.ids[found.any(axis=1)], side.ids[found.any(axis=0)]])
                        out += [(key[0], i) for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return run


def _meet(lists: DataFrame, facts: DataFrame, matches: int, percent: int, sets: DataFrame | None) -> DataFrame:
    """The members of each list (token, id, component) that are of different components meet. Without sets: (token, id) of
    the members of candidate pairs; with them: confirmed links that join components.

    In any such pair one side at least stands outside the list's largest component, so only these (the minority) ask; all
    members answer. The askers are dealt into blocks of about BLOCK documents, those who answer into pieces of about PIECE,
    both counted in documents of at most SHINGLES shingles, and each block meets each piece in a group of its own. So a
    group of m near copies, most of which are one component by now, is about m rows, and no group outgrows its task."""
    rows = lists.join(facts.select("id", "n"), "id")
    rows = rows.withColumn("w", 1 + F.floor(F.col("n") / SHINGLES))
    parts = rows.groupBy("token", "component").agg(F.sum("w").alias("w"))
    order = F.col("w") + F.pmod(F.xxhash64("component"), F.lit(1 << 24)) / (1 << 24)  # of equal ones the same one each time
    tops = parts.groupBy("token").agg(
        F.max_by("component", order).alias("largest"), F.max("w").alias("most"), F.sum("w").alias("all"), F.count("*").alias("parts")
    )
    count = lambda weight, size: F.greatest(F.ceil(weight / size).cast("int"), F.lit(1))
    tops = tops.where("parts > 1").select(
        "token", "largest", count(F.col("all") - F.col("most"), BLOCK).alias("blocks"), count(F.col("all"), PIECE).alias("pieces")
    )
    rows = rows.drop("w", "n").join(tops, "token").withColumn("minor", F.col("component") != F.col("largest")).join(facts, "id")
    if sets is not None:
        rows = rows.join(sets, "id")
    block, piece = F.pmod(F.hash("id"), F.col("blocks")), F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")
    at = lambda b, p, asks: F.struct(b.alias("block"), p.alias("piece"), F.lit(asks).alias("asks"))
    asking = F.when(F.col("minor"), F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda p: at(block, p, 1)))
    answering = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: at(b, piece, 0))
    places = F.explode(F.concat(F.coalesce(asking, F.array().cast("array<struct<block:int,piece:int,asks:int>>")), answering))
    rest = ["token", "id", "component", "minor", "n", "sig", "prefix"] + ["shingles"] * (sets is not None)
    dealt = rows.select(places.alias("at"), *rest).select("at.*", *rest).repartition("token", "block", "piece")
    dealt = dealt.sortWithinPartitions("token", "block", "piece", F.desc("asks"), "id")
    return dealt.mapInArrow(_met(matches, percent, sets is not None), "a long, b long")


def _sets_of(docs: DataFrame, named: DataFrame, met: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of the documents of met (id). Rows that repeat both id and text give one set; only those are
    shuffled."""
    again = named.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("rows")).where("rows > 1").select("id")
    asked = docs.withColumnRenamed("doc_id", "id").join(met, "id")
    once, more = asked.join(again, "id", "left_anti"), asked.join(again, "id", "left_semi").dropDuplicates(["id", "text"])
    return once.unionAll(more).mapInArrow(_sets(width), "id long, shingles array<long>")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id long, text string; other columns are left).

    Words are runs of non-space bytes, A-Z lower-cased. Null, empty and blank texts have n_shingles 0 and are linked with
    nothing. Rows of one doc_id are rows of one document: their texts' links all count for it. A null doc_id gives a null component_id and kept true. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    signed_rows = docs.mapInArrow(_signatures(width, coordinates), "doc_id long, n_shingles long, x long, y long, sig array<int>")
    rows = written(signed_rows, "signatures")
    named = rows.where("doc_id is not null and n_shingles > 0")
    classes = written(named.groupBy("x", "y", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")), "classes")

    token = F.shiftleft(F.col("pos").cast("long"), 32) + F.col("col").cast("long") + F.lit(2**31)
    posted = classes.select("id", F.posexplode("sig")).select("id", token.alias("token"))
    shared = posted.groupBy("token").count().where("count > 1")
    own = Window.partitionBy("id")
    kept = posted.join(shared, "token").withColumn("n", F.count("*").over(own)).where(F.col("n") >= matches)
    kept = kept.withColumn("rank", F.row_number().over(own.orderBy("count", "token"))).where(F.col("rank") <= F.col("n") - (matches - 1))
    prefix = written(kept.select("token", "id", "count"), "prefix")

    signed = classes.select("id", "sig")
    least = prefix.groupBy("token").agg(F.min("id").alias("a"), F.count("*").alias("members")).where("members > 1").drop("members")
    first = prefix.join(least, "token").where("a < id").select("a", F.col("id").alias("b")).distinct()
    left, right = signed.select(F.col("id").alias("a"), F.col("sig").alias("p")), signed.select(F.col("id").alias("b"), F.col("sig").alias("q"))
    first = first.join(left, "a").join(right, "b")
    first = written(first.where(_collisions("p", "q") >= matches).select("a", "b"), "pairs")

    met = prefix.join(least.select("token"), "token", "left_semi").select("id").distinct()
    sets = written(_sets_of(docs, named, met, width), "sets")
    links = written(_confirmed(first, sets, percent), "links")
    groups = connected_components(links)

    component = F.coalesce("component", "id")
    labelled = prefix.join(groups.withColumnRenamed("node", "id"), "id", "left").select("token", "id", component.alias("component"))
    mixed = labelled.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    labelled = written(labelled.join(mixed.select("token"), "token"), "labelled")
    ranks = prefix.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("count", "token"))).alias("r"))  # at most a row a coordinate
    facts = classes.select("id", "sig", F.col("n_shingles").alias("n")).join(ranks.select("id", F.col("r.token").alias("prefix")), "id")
    facts = written(facts.join(labelled.select("id").distinct(), "id", "left_semi"), "facts")
    near = written(_meet(labelled, facts, matches, percent, None).select(F.col("a").alias("token"), F.col("b").alias("id")).distinct(), "near")
    near_lists = near.join(labelled, ["token", "id"])
    more = written(_meet(near_lists, facts, matches, percent, sets), "links")

    same_id = named.join(classes.select("x", "y", "n_shingles", "id"), ["x", "y", "n_shingles"]).where("doc_id <> id")
    found = connected_components(links.unionAll(more).unionAll(same_id.select(F.col("doc_id").alias("a"), F.col("id").alias("b"))))
    drop(prefix, first, sets, links, more, labelled, facts, near, groups)
    out = rows.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))
