"""Repeated rows, null ids and clashing columns in the mix."""

import random
from collections import Counter

import pytest
from lorewright.llm import mixing
from pyspark.sql import functions as F
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _words(n):
    return " ".join(["w"] * n)


CASES = {
    "one id": [(7, _words(2), "a")] * 600 + [(1000 + i, _words(2), "b") for i in range(600)],
    "null ids": [(None, _words(3), "a")] * 300 + [(None, f"{_words(2)} x{i}", "a") for i in range(100)] + [(i, _words(5), "b") for i in range(500)],
    "hot pair": [(5, _words(9), "a")] * 5000 + [(6, _words(4), None)] * 40 + [(i, _words(i % 7), "c") for i in range(500)],
}


@pytest.mark.parametrize("case", CASES)
def test_repeats_meet_their_targets(spark, case):
    rows = CASES[case]
    docs = spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], DOCS)
    got = mixing.copies(docs).collect()
    sizes, target = brute.mix_targets([(s, t) for _, t, s in rows])
    taken = Counter()
    for r in got:
        assert 0 <= r.copies <= 3
        taken[None if r.key == "1" else r.key[1:]] += r.copies * r.size
    most = {s: max(len(t.split()) for _, t, x in rows if x == s) for s in sizes}
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= most[s] for s in sizes)
    assert sorted(map(repr, mixing.copies(docs.repartition(3)).collect())) == sorted(map(repr, got))
    rows_mixed = Counter(r.source for r in mixing.mixed(docs).collect() for _ in r.text.split())
    assert all(rows_mixed[s] == taken[s] for s in sizes)


def test_columns_keep_their_values(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, _words(rng.randrange(1, 50)), "en", rng.choice("ab"), i) for i in range(200)], DOCS)
    names = ["_id", "_key", "_k", "_s", "_n", "key", "size", "id", "none", "h", "n", "base", "extra", "row", "each", "copy", "place", "score", "label"]
    clashing = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    got = mixing.mixed(clashing).collect()
    assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in names) and mixing.mixed(clashing).columns == clashing.columns
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in mixing.mixed(docs).collect())


def test_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000, "en", "a", 0), (2, "word", "en", "b", 0)], DOCS)
    assert {(r.doc_id, r.size) for r in mixing.copies(docs).collect()} == {(1, 400_000), (2, 1)}
