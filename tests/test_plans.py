"""Strong components, percentiles and incremental metrics against plain readings."""

import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewright.operators import graph, metrics
from lorewright.plans.quantiles import quantiles


def _components(arcs):
    """Node -> smallest node of its component, of components of two nodes or more, by mutual reach."""
    out = {}
    for a, b in arcs:
        if a != b:
            out.setdefault(a, set()).add(b)
    reach = {}
    for start in {x for arc in arcs for x in arc}:
        seen, todo = set(), [start]
        while todo:
            for nxt in out.get(todo.pop(), ()):
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        reach[start] = seen
    alike = {v: {w for w in reach[v] if v in reach[w]} for v in reach}
    return {v: min(own | {v}) for v, own in alike.items() if own - {v}}


def _found(spark, arcs):
    rows = graph.strong_components(spark.createDataFrame(arcs, "a string, b string")).collect()
    names = {}
    for r in rows:
        names.setdefault(r.component, []).append(r.id)
    assert len({r.id for r in rows}) == len(rows)
    return {v: min(own) for own in names.values() for v in own}


def test_components_equal_mutual_reach(spark):
    rnd = random.Random(5)
    arcs = [(f"r{rnd.randrange(24)}", f"r{rnd.randrange(24)}") for _ in range(40)]  # a random core
    arcs += [(f"p{i}", f"p{i + 1}") for i in range(9)] + [("p9", "r1"), ("r2", "p0"), ("p4", "q0"), ("q0", "q1"), ("q1", "p2")]  # paths into and out of it
    arcs += [(f"o{i}", f"o{(i + 1) % 7}") for i in range(7)]  # a ring
    arcs += [("h", "i"), ("i", "h"), ("h", "j"), ("j", "k"), ("k", "l"), ("l", "m"), ("m", "l"), ("z", "z"), ("h", "h")]  # between two cycles, loops
    assert _found(spark, arcs) == _components(arcs)
    assert _found(spark, []) == {} and _found(spark, [("a", "a"), ("a", "b")]) == {}


def test_long_chains_and_rings_settle(spark):
    chain = [(f"c{i:05d}", f"c{i + 1:05d}") for i in range(20_000)]
    ring = [(f"d{i:05d}", f"d{(i + 1) % 5000:05d}") for i in range(5000)]
    got = _found(spark, chain + ring + [("c20000", "d00000")])
    assert got == {f"d{i:05d}": "d00000" for i in range(5000)}


def test_chains_of_small_cycles_settle(spark):
    rnd = random.Random(9)
    arcs = [(f"n{rnd.randrange(120):03d}", f"n{rnd.randrange(120):03d}") for _ in range(140)]
    for i in range(0, 600, 2):  # pairs in a chain, some with ways from and to the random part
        arcs += [(f"p{i:03d}", f"p{i + 1:03d}"), (f"p{i + 1:03d}", f"p{i:03d}"), (f"p{i + 1:03d}", f"p{i + 2:03d}")]
        arcs += [(f"p{i:03d}", f"n{rnd.randrange(120):03d}")] if i % 14 == 0 and i > 300 else []
        arcs += [(f"n{rnd.randrange(120):03d}", f"p{i:03d}")] if i % 18 == 4 else []
    arcs += [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)] + [("r1", "t1"), ("t1", "t2"), ("r2", "t3")]  # a ring with trees on it
    assert _found(spark, arcs) == _components(arcs)


def test_percentiles_equal_numpy(spark):
    rnd = random.Random(7)
    groups = {"many": [rnd.gauss(0, 5) for _ in range(500)], "equal": [2.0] * 400, "hot": [0.0] * 300 + [rnd.random() for _ in range(101)], "one": [3.5], "two": [1.0, 2.0]}
    rows = [(k, v) for k, own in groups.items() for v in own] + [("many", None), ("none", None)]
    got = {r.group: r for r in quantiles(spark.createDataFrame(rows, "group string, value double").repartition(5), (0.0, 0.5, 0.9, 0.95, 1.0)).collect()}
    for k, own in groups.items():
        r = got[k]
        assert (r["count"], r.min, r.max) == (len(own), min(own), max(own))
        assert [r.p0, r.p50, r.p90, r.p95, r.p100] == pytest.approx([np.percentile(own, p) for p in (0, 50, 90, 95, 100)])
    assert got["none"]["count"] == 0 and got["none"].p50 is None


def test_metrics_of_what_a_change_touches(spark):
    kinds = {"s1": "source", "s2": "source", "n": "note", "c": "concept", "d": "decision", "x": "dossier", "y": "dossier"}
    entries = spark.createDataFrame([(k, v, "web" if k == "s1" else "doc", date(2024, 1, 1)) for k, v in kinds.items()], "id string, kind string, source_type string, captured_at date")
    edge = "source_id string, target_id string, type string"
    old = [("n", "s1", "source_refs"), ("c", "n", "evidence_refs"), ("d", "c", "evidence_refs"), ("x", "s2", "evidence_refs"), ("y", "x", "derived_from")]
    new = [*old[:1], *old[2:], ("c", "x", "evidence_refs"), ("c", "s2", "superseded_by")]
    access = spark.createDataFrame([("c", "get", None)], "entry_id string, op string, accessed_at timestamp")
    changed = spark.createDataFrame([("c",)], "id string")
    a, b = spark.createDataFrame(old, edge), spark.createDataFrame(new, edge)
    touched = {r.id for r in metrics.dependants(changed, entries, b, a).collect()}
    assert touched == {"c", "d", "n", "x", "s2", "y"}
    held = metrics.entry_metrics(entries, a, access, "2024-01-31").withColumn("evidence_strength", F.when(F.col("id") == "s1", 77.0).otherwise(F.col("evidence_strength")))
    got = {r.id: r for r in metrics.updated_metrics(held, changed, entries, b, a, access, "2024-01-31").collect()}
    want = {r.id: r for r in metrics.entry_metrics(entries, b, access, "2024-01-31").collect()}
    assert got.pop("s1").evidence_strength == 77.0 and want.pop("s1") and got == want  # s1 isn't worked out again
    assert want["c"].sources == 1 and want["c"].drift_score == 0.0
