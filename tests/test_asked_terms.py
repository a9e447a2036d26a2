"""Indexes of one run's queries: only their terms are posted, and every field is counted."""

from lorewright.functions import segment
from lorewright.operators import fulltext

ROWS = [
    ("a", "Aaaa station", ["数据库"], ["nation", "x"], ["知识"], "The nation of the NATION, 数据库 und 数据 ÉTÉ"),
    ("b", "知识库 of the", [], ["of"], ["数据"], "of the of the in"),
    ("c", "", ["知识"], [], [], None),
]


def _indexes(spark, queries):
    entries = spark.createDataFrame(ROWS, "id string, title string, aliases array<string>, search_terms array<string>, tags array<string>, body string")
    return fulltext.built(entries), fulltext.built(entries, queries=queries)


def test_asked_terms_are_posted_as_in_whole_indexes(spark):
    queries = ["of the", "nation", "aaa", "数据库", "ÉTÉ"]
    whole, asked = _indexes(spark, queries)
    terms = fulltext._asked(whole.known, fulltext.WEIGHTS, queries)
    rows = lambda index: sorted((r["index"], r.term, r.id, r.field, tuple(r.positions)) for r in index.postings.collect())
    assert rows(asked) == [r for r in rows(whole) if r[1] in terms[r[0]]] and len(rows(asked)) < len(rows(whole))
    assert sorted(map(tuple, asked.sizes.collect())) == sorted(map(tuple, whole.sizes.collect())) and asked.totals == whole.totals
    for q, find in (("of the", fulltext.search_en), ("aaa", fulltext.search_tri), ("数据库", fulltext.search_cn), ("数据库", fulltext.search_tri)):
        got = {r.id: round(r.score, 9) for r in find(asked, q).collect()}
        assert got == {r.id: round(r.score, 9) for r in find(whole, q).collect()} and got


def test_words_are_cut_and_posted_in_one_pass(spark):
    entries = spark.createDataFrame(ROWS, "id string, title string, aliases array<string>, search_terms array<string>, tags array<string>, body string")
    plan = fulltext.postings(entries, segment.dictionary(entries), ("cn",))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("MapInPandas") == 1
