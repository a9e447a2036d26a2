"""Near titles that share much, and blocks of titles."""

import random
import time

from lorewright.operators import titles
from tests.test_titles import _brute


def test_titles_of_common_parts_end_soon(spark):
    rnd = random.Random(4)
    rows = [(f"e{i:05d}", "note", "knowledge base of " + "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(16))) for i in range(3000)]
    rows += [("x", "note", rows[0][2] + "z"), ("y", "note", "z" + rows[1][2][:-1])]
    entries = spark.createDataFrame(rows, "id string, kind string, title string")
    begun = time.monotonic()
    found = {(r.left_id, r.right_id) for r in titles.near_titles(entries).collect()}
    assert {("e00000", "x"), ("e00001", "y")} <= found
    assert time.monotonic() - begun < 60


def test_blocks_miss_no_pair(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(250):
        base = "".join(rnd.choice("abcdé中 ") for _ in range(rnd.choice([2, 4, 9, 30, 90])))
        rows += [(f"e{i:04d}{k}", "note", base[:at] + rnd.choice(["", "z", "ab"]) + base[at + rnd.randrange(2) :]) for k in range(3) for at in [rnd.randrange(len(base))]]
    entries = spark.createDataFrame(rows, "id string, kind string, title string")
    want = _brute(rows)
    for block in (60, 1000):
        assert {(r.kind, r.left_id, r.right_id, round(r.ratio, 9), r.edits) for r in titles.near_titles(entries, block).collect()} == want
    assert len(want) > 100
