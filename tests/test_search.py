"""The positional indexes against SQLite's FTS5, the segmenter against all segmentations, and the router's rules."""

import itertools
import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from lorewright.functions import segment
from lorewright.operators import fulltext, search

ENTRIES = "id string, kind string, status string, title string, body string, aliases array<string>, tags array<string>, search_terms array<string>"
DOCS = [
    ("a", "red fox", "the red fox jumps over the red, red fox. end. C++ a/b", ["vulpes", "red-fox"], ["animal"], ["fox"]),
    ("b", "dog", "a dog sleeps the day away; fox of red", [], ["animal"], ["hound", "fox red"]),
    ("c", "", "blue sky and sea é end of red fox", ["sky"], [], []),
    ("d", "sea", None, ["mer"], ["water"], ["red fox sea"]),
    ("e", "plain words", "words of no note, banana bananas BANANA", [], [], []),
    ("f", "x", "aaaa 1.2.3 node.js", [], [], ["aaa"]),
]


@pytest.fixture(scope="module")
def entries(spark):
    rows = [(i, "note", "active", t, b, al, tg, st) for i, t, b, al, tg, st in DOCS]
    return spark.createDataFrame(rows, ENTRIES)


@pytest.fixture(scope="module")
def index(spark, entries):
    built = fulltext.built(entries)
    return built._replace(vocabulary=fulltext.vocabulary(built.postings))


def _fts5(table, tokenizer, fields, query, weights):
    con = sqlite3.connect(":memory:")
    con.execute(f"CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, {', '.join(fields)}, tokenize = \"{tokenizer}\")")
    for i, t, b, al, tg, st in DOCS:
        row = {"title": t, "aliases": " ".join(al), "search_terms": " ".join(st), "tags": " ".join(tg), "body": b or ""}
        text = [row[f] if table != "en" else "".join(c if c.isascii() else " " for c in row[f]) for f in fields]
        con.execute(f"INSERT INTO t VALUES ({', '.join('?' * (len(fields) + 1))})", (i, *text))
    return dict(con.execute(f"SELECT id, -bm25(t, 0.0, {', '.join(map(str, weights))}) FROM t WHERE t MATCH ?", (query,)).fetchall())


def _close(rows, want):
    got = {r.id: r.score for r in rows.collect()}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want), (got, want)


@pytest.mark.parametrize("text", ["fox", "RED", "red fox", "end", "end.", "c++", "a/b", "node.js", "red;fox", "fox red;fox", "red red", "nothing", "1.2.3", ";"])
def test_words_and_phrases_equal_fts5(index, text):
    weights = fulltext.WEIGHTS["en"]
    query = " AND ".join(f'"{p}"' for p in text.split())
    want = _fts5("en", "unicode61 tokenchars '+-./#$%^&*_=' remove_diacritics 0", list(weights), query, weights.values())
    _close(fulltext.search_en(index, text), want)


@pytest.mark.parametrize("text", ["fox", "ED F", "ana", "anana", "aaa", "aa", "é e", "no such", "d, r"])
def test_trigrams_equal_fts5(index, text):
    weights = fulltext.WEIGHTS["tri"]
    _close(fulltext.search_tri(index, text), _fts5("tri", "trigram", list(weights), f'"{text}"', weights.values()))


def test_a_phrase_reads_its_terms_only(index):
    plan = fulltext.phrase_hits(index._replace(vocabulary=None), "tri", fulltext.trigrams("anana"))._jdf.queryExecution().optimizedPlan().toString()
    assert "ana" in plan and "body" not in plan
    rare = fulltext.phrase_hits(index, "tri", fulltext.trigrams("red fox"))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in rare


def test_limit_goes_by_score_and_id(index):
    every = [(r.id, r.score) for r in fulltext.search_en(index, "red").orderBy(F.desc("score"), "id").collect()]
    assert [(r.id, r.score) for r in fulltext.search_en(index, "red", 2).collect()] == every[:2]
    assert fulltext.bm25(index, "en", []).count() == 0 and fulltext.bm25(index, "en", [["red"], []]).count() == 0


# --- segmenter
WORDS = {"知识": 9, "知识库": 5, "识库": 40, "库系统": 3, "系统": 30, "的系": 2, "天地人和": 1, "天地": 2, "人和": 2}


def _every_path(run, words, total):
    found = []
    for cuts in itertools.product((0, 1), repeat=len(run) - 1):
        edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(run)]
        parts = [run[a:b] for a, b in itertools.pairwise(edges)]
        if all(len(p) == 1 or p in words for p in parts):
            found.append((sum(segment.weigh(words.get(p, 1) if len(p) > 1 else 1, total) for p in parts), [len(p) for p in parts], parts))
    return max(found)[2]


def test_best_path_is_the_best_of_all():
    total = sum(WORDS.values())
    for run in ("知识库系统", "知识库的系统", "天地人和", "的", "无此词", "库系统知识", "知识知识库识库系统"):
        words, loose = [], ""
        for part in _every_path(run, WORDS, total):
            if len(part) == 1:
                loose += part
                continue
            words += segment._pairs(loose) + [part]
            loose = ""
        assert segment.best_path(run, WORDS, total, 4) == words + segment._pairs(loose)


def test_tokens_of_mixed_text():
    assert segment.tokens("知识库系统 AI-2，Straße_x C++", {"知识库": 5, "系统": 5}, 10, 3) == ["知识库", "系统", "ai-2", "straße", "x", "c"]
    assert segment.tokens("", {}, 0, 1) == [] and segment.tokens("无此词", {}, 0, 1) == ["无此", "此词"]


def test_large_dictionaries_go_by_join(spark):
    texts = spark.createDataFrame([("1", "知识库系统 x 知识"), ("2", None), ("3", "no han"), ("4", "天地人和的系统" * 30)], "key string, text string")
    known = segment.of_words(spark.createDataFrame(list(WORDS.items()), "word string, frequency int"))
    assert (known.count, known.total, known.longest) == (len(WORDS), sum(WORDS.values()), 4) and known.among("知识库") == {"知识": 9, "知识库": 5, "识库": 40}
    sent, joined = ({r.key: r.tokens for r in segment.tokenised(texts, known, most).collect()} for most in (100, 0))
    assert sent == joined and sent["2"] == [] and sent["1"][-1] == "知识"


def test_the_dictionary_takes_aliases_and_tags(spark):
    rows = spark.createDataFrame([("a", ["知识库 ", "ai", "库", "知识"], ["系统3", "系统"]), ("b", ["知识库"], None)], "id string, aliases array<string>, tags array<string>")
    more = spark.createDataFrame([("知识", 12), ("词典", 7)], "word string, frequency int")
    known = segment.dictionary(rows, more)
    assert {r.word: r.frequency for r in known.words.collect()} == {"知识库": 5, "知识": 12, "系统": 5, "词典": 7}
    assert segment.dictionary(rows.limit(0))[1:] == (0, 0, 1)


# --- router
@pytest.fixture(scope="module")
def base(spark):
    rows = [
        ("a", "concept", "active", "foxes den", "some foxes in a den", ["vulpes"], ["red"], []), ("b", "note", "active", "whale", "the whale and foxes", [], [], []),
        ("c", "note", "archived", "den", "foxes foxes", [], [], ["vulpes"]), ("d", "concept", "active", "sea", "water", [], [], []), ("e", "note", "active", "fen", "peat", [], [], []),
        ("g", "note", "active", "hill", "a stone", [], [], []), ("h", "note", "active", "moor", "知识库系统", [], [], []),
    ]
    edges = spark.createDataFrame([("a", "d"), ("c", "e"), ("d", "d"), ("b", "c")], "source_id string, target_id string")
    authority = spark.createDataFrame([("a", 0.5), ("d", 1.0)], "id string, authority double")
    return spark.createDataFrame(rows, ENTRIES), edges, authority


def _ids(base, query, **more):
    return [r.id for r in search.search(*base, query, **more).collect()]


def test_exact_matches_are_the_answer(base):
    got = search.search(*base, "vulpes").collect()
    assert [(r.id, r.backends) for r in got] == [("a", ["exact"])] and got[0].score == pytest.approx(90 * 1.3)
    assert [r.id for r in search.search(*base, " VULPES ", archived=True).collect()] == ["a", "c"]
    assert _ids(base, "a") == ["a"]  # an id
    assert _ids(base, "vulpes", kinds=["note"]) == []  # filtered away, and BM25 goes by the same filter
    assert _ids(base, "vulpes", backends=["exact"], kinds=["note"]) == []


def test_exact_hits_are_not_cut_before_filters(spark, base):
    entries, edges, authority = base
    many = spark.createDataFrame([(f"m{i:03d}", "note", "active", "t", "b", ["same"], ["z"] if i == 199 else [], []) for i in range(200)], ENTRIES)
    assert _ids((entries.unionByName(many), edges, authority), "same", where={"tags": "z"}, limit=2) == ["m199"]


def test_graph_only_on_request_and_from_filtered_seeds(base):
    assert _ids(base, "foxes") == ["a", "b"]
    got = {r.id: r for r in search.search(*base, "foxes", backends=["bm25", "graph"]).collect()}
    assert set(got) == {"a", "b", "d"} and got["d"].backends == ["graph"] and got["a"].backends == ["fts_en"]  # c is archived, so e isn't reached
    assert got["d"].score == pytest.approx(got["a"].score / 1.15 * 0.5 * 1.3)
    assert set(_ids(base, "foxes", backends=["bm25", "graph"], expand_graph=False)) == {"a", "b"}
    assert set(_ids(base, "foxes", backends=["bm25", "graph"], archived=True)) == {"a", "b", "c", "d", "e"}
    assert set(_ids(base, "foxes", backends=["bm25", "graph"], kinds=["concept"])) == {"a", "d"}


def test_dense_adds_or_stands_alone(spark, base):
    near = lambda text, limit: spark.createDataFrame([("a", 1.0), ("g", 0.9), ("c", 5.0)], "id string, score double")
    plain = {r.id: r.score for r in search.search(*base, "foxes").collect()}
    both = {r.id: r for r in search.search(*base, "foxes", dense=near).collect()}
    assert both["a"].score == pytest.approx((plain["a"] / 1.3 + 1.0) * 1.3) and both["g"].score == pytest.approx(0.9) and set(both) == {"a", "b", "g"}
    assert both["a"].backends == ["fts_en", "dense"] and both["g"].backends == ["dense"]
    assert _ids(base, "foxes", backends=["dense"], dense=near) == ["a", "g"] and _ids(base, "foxes", backends=["dense"]) == []
    assert set(_ids(base, "foxes", backends=["bm25"], dense=near)) == {"a", "b"}


def test_segments_take_their_routes(base):
    assert _ids(base, "") == [] and _ids(base, "   ") == [] and _ids(base, "😀") == []
    assert _ids(base, "知识库") == ["h"] and _ids(base, "识库系") == ["h"]  # pairs and trigrams
    half = {r.id: r.score for r in search.search(*base, "whale stone", backends=["bm25"]).collect()}
    whole = {r.id: r.score for r in search.search(*base, "whale", backends=["bm25"]).collect()}
    assert set(half) == {"b", "g"} and half["b"] == pytest.approx(whole["b"] * search.PARTIAL)
