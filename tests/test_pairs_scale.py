"""Pairs made by blocks, against all pairs."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lorewright.functions.text import cosine
from lorewright.operators import rules

ENTRY = "id string, kind string, search_terms array<string>"


def _rows(seed, n=150):
    rnd = random.Random(seed)
    return [(f"e{i:03d}", ("note", "concept", "source")[i % 5 % 3], rnd.sample("abcdefg", rnd.randrange(5)) + [f"r{rnd.randrange(9)}"] * (i % 2)) for i in range(n)]


def _like(rows):
    return {(a, b) for a, k, s in rows for b, q, t in rows if a < b and k == q != "source" and s and t and len({*s} & {*t}) >= 0.5 * len({*s, *t})}


def test_term_pairs_by_blocks_and_no_pair_shuffled(spark):
    rows = _rows(2)
    for block in (2048, 8):
        found = rules.term_pairs(spark.createDataFrame(rows, ENTRY), block=block)
        assert sorted((r.left_id, r.right_id) for r in found.collect()) == sorted(_like(rows))
        # the last join is of blocks: its pairs go into no exchange
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") <= 2


def test_merge_leaves_linked_pairs_out(spark):
    rows, rnd = _rows(3), random.Random(9)
    links = [(b, a) if i % 2 else (a, b) for i, (a, b) in enumerate(rnd.sample(sorted(_like(rows)), 40))]
    edges = spark.createDataFrame([(a, b, "related", "confirmed") for a, b in links], "source_id string, target_id string, type string, origin string")
    found = rules.merge(spark.createDataFrame(rows, ENTRY), edges)
    assert sorted((r.target_id, r.message) for r in found.collect()) == sorted(_like(rows) - {(min(p), max(p)) for p in links})


def test_candidates_by_blocks_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    vectors = [v for v in rng.integers(-3, 4, (70, 6)).astype(float).tolist() for _ in (0, 1)] + [[0.0] * 6, [1.0] * 5]
    table = spark.createDataFrame([(i, "ab"[i % 4 // 2], v) for i, v in enumerate(vectors)], "id long, kind string, embedding array<float>").unionByName(spark.sql("SELECT 999L AS id, 'a' AS kind, array(1f, null, 1f, 1f, 1f, 1f) AS embedding"))
    asked = table.where("id % 3 = 0").select("id")
    pairs = table.join(asked, "id").select("id", "kind", F.col("embedding").alias("q")).join(table.select(F.col("id").alias("candidate"), "kind", "embedding"), "kind").where("id <> candidate")
    near: dict[int, list] = {}
    for r in pairs.withColumn("s", cosine(F.col("q"), F.col("embedding"))).where("s >= 0.3").collect():
        near.setdefault(r.id, []).append((-r.s, r.candidate))
    want = {(i, c, -s) for i, found in near.items() for s, c in sorted(found)[:4]}
    for ask, block in ((1024, 8192), (5, 9)):
        got = {(r.id, r.candidate, r.similarity) for r in rules.semantic_candidates(table, asked, 0.3, 4, ask, block).collect()}
        assert got == want and len(want) > 50


def test_sums_of_a_term_need_no_row_a_subset():
    sets = [(["b", "c"], ["x"], 3), (["b"], ["x", "y"], 2), ([], ["y"], 1), (["c"], ["z"], 4)]
    frame = pd.DataFrame([("a", *s) for s in sets], columns=["term", "after", "tags", "m"])
    # whoever shares a tag is counted under this term where no other term is shared; subsets of shared terms take the rest away
    want = [sum(m for b, u, m in sets if set(t) & set(u) and not set(a) & set(b)) for a, t, _ in sets]
    assert rules._sharing(frame)["n"].tolist() == want
