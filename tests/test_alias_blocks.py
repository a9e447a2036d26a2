"""Pairs of entries that share aliases, by blocks of an alias's holders."""

import inspect
import random

from lorewright.operators import checks


def test_blocks_give_every_pair_once(spark):
    rnd = random.Random(8)
    pool = ["the", "数据", "x", "知识", "of", "12", None]
    rows = [(f"e{i:03d}", "archived" if i % 9 == 0 else "active", rnd.sample(pool, rnd.randrange(5)) + ["the"] * (i % 3 > 0)) for i in range(120)]
    want = set()
    for a, state, s in rows:
        for b, other, t in rows:
            held, both = {x for x in s + t if x}, {x for x in s if x in t and x}
            if a < b and "archived" not in (state, other) and both and held & {"数据", "知识"} and held & {"the", "x", "of"}:
                want.add((a, b, len(both)))
    entries = spark.createDataFrame(rows, "id string, status string, aliases array<string>")
    for block in (2048, 16):
        found = checks.cross_language_aliases(entries, block=block)
        assert sorted(tuple(r) for r in found.collect()) == sorted(want)
        assert "HashAggregate" not in found._jdf.queryExecution().executedPlan().toString().split("Join", 1)[0]  # no pair is shuffled
    assert {r[2] for r in checks.cross_language_aliases(entries, 2).collect()} == {n for *_, n in want if n > 1}
    assert len(want) > 500 and "block" in inspect.signature(checks.cross_language_aliases).parameters
