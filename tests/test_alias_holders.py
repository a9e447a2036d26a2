from collections import Counter
from itertools import combinations

from lorewright.operators import rules


def test_every_pair_and_its_count_follow(spark):
    rows = [("a", "active", ["x", "y"]), ("b", "active", ["x", "z", "x"]), ("c", "active", ["x", "z"]), ("d", "archived", ["x"]), ("e", "active", ["y", "z", None]), ("f", "active", ["q", None]), ("g", "active", [])]
    entries = spark.createDataFrame(rows, "id string, status string, aliases array<string>")
    groups = {}
    for r in rules.alias_holders(entries).collect():
        groups.setdefault((r.alias, r.representative), []).append(r.member)
    assert all(k[1] == min(v) for k, v in groups.items())
    got = Counter(p for v in groups.values() for p in combinations(sorted(v), 2))
    live = {i: set(x) - {None} for i, s, x in rows if s != "archived"}
    assert got == {p: n for p in combinations(sorted(live), 2) if (n := len(live[p[0]] & live[p[1]]))}
