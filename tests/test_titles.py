"""Near titles against all pairs."""

import random

from lorewright.functions.text import indel_ratio
from lorewright.operators import titles


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def _brute(rows):
    first = {}
    for i, kind, title in rows:
        if kind != "source" and title:
            first[kind, title] = min(i, first.get((kind, title), i))
    names, found = sorted(first.items()), set()
    for n, ((kind, a), left) in enumerate(names):
        for (other, b), right in names[n + 1 :]:
            near = _distance(a, b) <= 2 and max(len(a), len(b)) >= 4
            if kind == other and (near or indel_ratio(a, b) >= 0.85):
                found.add((kind, min(left, right), max(left, right), round(indel_ratio(a, b), 9), _distance(a, b) if near else None))
    return found


def test_near_titles_equal_all_pairs(spark):
    rnd = random.Random(3)
    said = ["", "a", "ab", "ba", "acdb", "abcd", "xabx", "abc", "一二", "一三二四", "知识库系统", "知识库的系统"]
    for _ in range(60):
        base = "".join(rnd.choice("abcde ") for _ in range(rnd.choice([3, 5, 8, 13, 21, 34])))
        said.append(base)
        for _ in range(rnd.randrange(5)):
            letters = list(base)
            for _ in range(rnd.randrange(1, 8)):
                at = rnd.randrange(len(letters) + 1)
                letters[at : at + rnd.randrange(2)] = rnd.choice(["", "z", "a"])
            said.append("".join(letters))
    rows = [(f"e{i:04d}", ("note", "concept", "source")[i % 5 % 3], t) for i, t in enumerate(said)]
    rows += [(f"f{i}", "note", said[20]) for i in range(3)] + [("g", "note", None)]
    entries = spark.createDataFrame(rows, "id string, kind string, title string")
    got = {(r.kind, r.left_id, r.right_id, round(r.ratio, 9), r.edits) for r in titles.near_titles(entries).collect()}
    want = _brute(rows)
    assert got == want and len(want) > 30
    same = {r.id: r.representative for r in titles.members(entries).collect()}
    twice = {(k, t) for i, k, t in rows if k != "source" and t and sum((k, t) == (x, y) for _, x, y in rows) > 1}
    assert set(same) == {i for i, k, t in rows if (k, t) in twice} and titles.near_titles(entries.limit(0)).count() == 0


def test_findings_name_the_first_three(spark):
    rows = [(f"e{i}", "note", "the same title") for i in range(6)] + [("d", "note", "the same titles"), ("x", "note", "another thing"), ("y", "concept", "the same title")]
    entries = spark.createDataFrame(rows, "id string, kind string, title string")
    got = {r.target_id: r.message for r in titles.duplicate_candidates(entries).collect()}
    assert got == {"d": "e0,e1,e2", "e0": "d,e1,e2", "e1": "d,e0,e2", **{f"e{i}": "d,e0,e1" for i in range(2, 6)}}
