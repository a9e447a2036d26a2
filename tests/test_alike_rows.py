"""Entries that are alike but for their id meet as one, and only their ids are paired."""

import random
from collections import Counter

from lorewright.operators import checks, rules
from lorewright.plans import blocks


def _joined(df):
    """The rows that the last join of a collected df made."""
    plan = [df._jdf.queryExecution().executedPlan()]
    while plan:
        node = plan.pop(0)
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            plan.append(node.executedPlan())
        elif name == "ResultQueryStageExec":
            plan.append(node.plan())
        elif "Join" in name:
            return node.metrics().apply("numOutputRows").value()
        else:
            plan += [node.children().apply(i) for i in range(node.children().size())]


def test_every_pair_of_rows_once(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice("aab"), rnd.choice(["x", "x", "x", "y"])) for i in range(200)]
    frame = spark.createDataFrame(rows, "id long, key string, other string")
    for block in (2048, 16):
        groups = blocks.alike(frame, block)
        sizes = [len(r.ids) for r in groups.collect()]
        assert sum(sizes) == 200 and (len(sizes) == 4 if block == 2048 else max(sizes) < 16)
        found = Counter((r.left_id, r.right_id) for r in blocks.pairs(blocks.met(groups, ["key"], block)).collect())
        assert found == Counter({(a, b): 1 for a, k, _ in rows for b, q, _ in rows if a < b and k == q})


def test_holders_of_the_same_aliases_meet_as_one(spark):
    rows = [(f"e{i:03d}", "active", ["the", "数据", f"u{i}"]) for i in range(400)]
    found = checks.cross_language_aliases(spark.createDataFrame(rows, "id string, status string, aliases array<string>"), block=256)
    got = found.collect()
    assert {(r.left_id, r.right_id) for r in got} == {(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :]} and {r.shared for r in got} == {2}
    assert len(got) == 79800 and _joined(found) < len(got) / 50


def test_entries_of_the_same_terms_are_compared_as_one(spark):
    rows = [(f"e{i:03d}", "note", rnd) for i in range(300) for rnd in [["a", "b", "c", f"r{i % 3}"][:: 1 if i % 2 else -1]]]
    edges = [(rows[0][0], rows[6][0]), (rows[9][0], rows[3][0]), (rows[1][0], rows[2][0]), (rows[5][0], rows[5][0])]
    edges = [(a, b, "related", "confirmed") for a, b in edges]
    found = rules.merge(spark.createDataFrame(rows, "id string, kind string, search_terms array<string>"), spark.createDataFrame(edges, "source_id string, target_id string, type string, origin string"))
    got = Counter((r.target_id, r.message) for r in found.collect())
    linked = {(min(a, b), max(a, b)) for a, b, *_ in edges}
    assert got == Counter({(a[0], b[0]): 1 for i, a in enumerate(rows) for b in rows[i + 1 :] if (a[0], b[0]) not in linked})
    assert len(got) == 44847 and _joined(found) < len(got) / 50
