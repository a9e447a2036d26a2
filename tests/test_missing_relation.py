import random

import pytest

from lorewright.operators import rules


def brute(rows, pairs, least=2):
    linked = {p for a, b in pairs for p in ((a, b), (b, a))}
    n = {a: sum(a != b and (a, b) not in linked and bool(set(t) & set(u)) and bool(set(g) & set(h)) for b, u, h in rows) for a, t, g in rows}
    return {a: str(k) for a, k in n.items() if k >= least}


@pytest.mark.parametrize("wide", [10, 3])
def test_hints_count_terms_of_many_holders(spark, wide):
    rng = random.Random(5)
    rows = [(f"e{i}", ["the"] * (i % 3 > 0) + rng.sample([f"t{k}" for k in range(12)], 2) + [f"r{rng.randrange(60)}"], rng.sample(["en", "de", "a", "b"], rng.choice([0, 1, 2]))) for i in range(160)]
    pairs = [(f"e{rng.randrange(160)}", f"e{rng.randrange(160)}") for _ in range(300)]
    entries = spark.createDataFrame([(i, "note", "active", t, g) for i, t, g in rows], "id string, kind string, status string, search_terms array<string>, tags array<string>")
    edges = spark.createDataFrame([(a, b, "related", "confirmed") for a, b in pairs], "source_id string, target_id string, type string, origin string")
    want = brute(rows, pairs)
    for meet in (50, 10, 1000):
        assert {r.target_id: r.message for r in rules.missing_relation_hint(entries, edges, meet=meet, wide=wide).collect()} == want
