from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lorewright.functions import text
from lorewright.operators import filters, graph, metrics, query, search

EDGE = "source_id string, target_id string, type string, origin string"


def nodes(spark, *ids, kind="concept", status="active"):
    return spark.createDataFrame([(i, kind, status) for i in ids], "id string, kind string, status string")


def arcs(spark, *pairs, kind="related"):
    return spark.createDataFrame([(a, b, kind, "confirmed") for a, b in pairs], EDGE)


def ranks(spark, entries, edges, **kw):
    return {r.id: r["rank"] for r in graph.pagerank(entries, edges, **kw).collect()}


def test_pagerank_shapes(spark):
    none = arcs(spark)
    assert ranks(spark, nodes(spark), none) == {}
    assert ranks(spark, nodes(spark, "a"), none)["a"] == pytest.approx(1.0)
    assert all(v == pytest.approx(1 / 3) for v in ranks(spark, nodes(spark, "a", "b", "c"), none).values())
    cycle = ranks(spark, nodes(spark, "a", "b", "c"), arcs(spark, ("a", "b"), ("b", "c"), ("c", "a")))
    assert sum(cycle.values()) == pytest.approx(1.0)
    one = ranks(spark, nodes(spark, "a", "b"), arcs(spark, ("a", "b"), ("a", "missing")))
    assert one["b"] > one["a"]


def test_pagerank_counts_parallel_edges_and_leaves_archived_out(spark):
    entries = nodes(spark, "a", "b", "c").unionAll(nodes(spark, "z", status="archived"))
    edges = arcs(spark, ("a", "b"), ("a", "c"), ("a", "z")).unionAll(arcs(spark, ("a", "b"), kind="supersedes"))
    got = ranks(spark, entries, edges)
    assert set(got) == {"a", "b", "c"} and got["b"] > got["c"]


def test_cycles(spark):
    edges = arcs(spark, ("a", "b"), ("b", "a"), ("c", "c"), ("b", "d"), ("d", "e"), ("e", "f"), ("f", "d"), ("x", "a"), kind="supersedes")
    assert {r.id for r in graph.cycle_members(edges).collect()} == {"a", "b", "d", "e", "f"}


def test_bridge_between_cycles_is_no_member(spark):
    edges = arcs(spark, ("a", "b"), ("b", "a"), ("b", "m"), ("m", "d"), ("d", "e"), ("e", "d"), kind="supersedes")
    assert {r.id for r in graph.cycle_members(edges).collect()} == {"a", "b", "d", "e"}


def test_reach_stops_at_sources_and_hops(spark):
    entries = nodes(spark, "s1", "s2", kind="source").unionAll(nodes(spark, *"abcdefghij"))
    chain = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "g"), ("g", "h"), ("h", "i"), ("i", "j"), ("j", "s1"), ("s1", "s2")]
    got = {(r.id, r.source) for r in graph.reachable_sources(entries, arcs(spark, *chain, kind="evidence_refs")).collect()}
    assert ("j", "s1") in got and ("b", "s1") in got and ("a", "s1") not in got and ("j", "s2") not in got and ("s1", "s1") in got


def test_heat(spark):
    now = datetime(2024, 1, 31)
    log = spark.createDataFrame([("a", "get", now - timedelta(days=d)) for d in (0, 30, 100)], "entry_id string, op string, accessed_at timestamp")
    assert metrics.retrieval_heat(log, "2024-01-31").first().heat == pytest.approx(1.5)


def test_strength_and_drift(spark):
    schema = "id string, kind string, status string, source_type string, captured_at date"
    today = date(2024, 1, 31)
    entries = spark.createDataFrame([("c", "concept", "active", None, None), ("s", "source", "active", "web", today), ("t", "source", "active", "doc", today - timedelta(days=365))], schema)
    edges = arcs(spark, ("c", "s"), ("c", "t"), kind="evidence_refs")
    got = {r.id: r for r in metrics.evidence(entries, edges, "2024-01-31").collect()}
    assert got["c"].evidence_strength == pytest.approx(3.0) and got["c"].drift_score == 0
    gone = edges.unionAll(arcs(spark, ("t", "s"), kind="supersedes")).unionAll(arcs(spark, ("s", "t"), kind="supersedes"))
    assert {r.id: r.drift_score for r in metrics.evidence(entries, gone, "2024-01-31").collect()}["c"] == 1.0


def test_boost(spark):
    found = spark.createDataFrame([("a", 10.0), ("b", 10.0)], "id string, score double")
    power = spark.createDataFrame([("a", 0.8), ("b", 0.2)], "id string, authority double")
    assert {r.id: round(r.score, 6) for r in search.boost(found, power).collect()} == {"a": 13.0, "b": 10.75}


@pytest.mark.parametrize(
    ("said", "kinds"),
    [("Python", ["ascii_word"]), ("AI", ["ascii_short"]), ("C++", ["symbol"]), ("v1.2.3", ["version"]), ("2024", ["number"]), ("知识库", ["cjk"]), ("GPT4模型", ["mixed", "cjk"]), ("ＡＢＣ", ["ascii_word"]), ("🙂", ["emoji"]), ("", []), ("RAG 检索", ["ascii_word", "cjk"])],
)
def test_query_segments(said, kinds):
    assert [s.type for s in query.parse_query(said)] == kinds


def test_query_parts():
    assert [s.text for s in query.expand_mixed(query.parse_query("gpt4"))] == ["gpt", "4"]
    assert query.symbol_variants("node.js") == ["node", "js"] and query.symbol_variants("node") == []


def test_text_functions(spark):
    row = spark.createDataFrame([("C++ 与 Node.js: a guide!!", "é", "kitten", "sitting")], "t string, n string, a string, b string")
    got = row.select(text.slug(F.col("t")).alias("slug"), text.has_nfd_residual(F.col("n")).alias("nfd"), text.to_nfc(F.col("n")).alias("nfc"), text.similarity_ratio("a", "b").alias("ratio"), text.trigrams(F.col("a")).alias("grams")).first()
    assert got.slug == "cpp-与-nodejs-a-guide" and got.nfd and got.nfc == "é" and got.ratio == pytest.approx(2 * 4 / 13) and got.grams == ["kit", "itt", "tte", "ten"]


def test_links_follow_a_move():
    body = "[a](../x/old.md#part) <u> [b](https://e.org/old.md) [c](<../x/old.md>) [d](#here)"
    assert text.rewrite_links(body, "y/f.md", "y/f.md", {"x/old.md": "x/new.md"}) == "[a](../x/new.md#part) <u> [b](https://e.org/old.md) [c](<../x/new.md>) [d](#here)"


def test_filter_language():
    assert filters.clauses("kind = 'a b' AND status != draft", ("kind", "status")) == [("kind", "=", "a b"), ("status", "!=", "draft")]
    for bad in ("kind > 1", "other = 1"):
        with pytest.raises(ValueError):
            filters.clauses(bad, ("kind",))
    with pytest.raises(ValueError):
        filters.clauses("kind = a", ("kind", "status"), {"status": "draft"})
