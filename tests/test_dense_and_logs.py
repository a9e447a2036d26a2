"""The dense index, logs, watches, checks of single values, and rules that fail by themselves."""

from datetime import date

import pytest
from lorewright.api import KnowledgeBase
from lorewright.errors import BodyTooShort, ConflictError, NotFoundError, StorageError, ValidationError
from lorewright.govern import watch
from lorewright.model import ENTRY_SCHEMA
from lorewright.operators import browse, checks, dense, lists
from lorewright.plans.ranking import placed
from lorewright.sources import logs
from lorewright.sources.snapshots import Snapshots
from pyspark.sql import functions as F

BODY = "A body of more than fifty characters, so that its length is no problem at all."


def entry(i, **kw):
    return {"id": f"e{i}", "kind": "note", "title": f"Title {i}", "status": "active", "tags": ["t"], "aliases": [], "search_terms": ["a"], "body": BODY} | kw


@pytest.fixture
def entries(spark):
    schema = spark.createDataFrame([], ENTRY_SCHEMA).schema
    return lambda rows: spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in rows], schema)


def test_dense_store(spark, entries):
    e = entries([entry(i) for i in range(5)] + [entry(9, status="archived")])
    empty = spark.createDataFrame([], dense.STORE_SCHEMA)
    store, failures = dense.rebuilt(e, empty)
    store = spark.createDataFrame(store.collect(), store.schema)
    assert {r.entry_id for r in store.collect()} == {f"e{i}" for i in range(5)} and failures.count() == 0 and dense.enabled(store, dense.hashed)
    assert dense.stale(e, store).count() == 0 and not dense.enabled(empty, dense.hashed) and not dense.enabled(store, None)
    changed = e.withColumn("title", F.when(F.col("id") == "e2", "Other").otherwise(F.col("title")))
    assert [r.id for r in dense.stale(changed, store).collect()] == ["e2"]
    best = dense.dense_hits(store, "Title 3 t a " + BODY, 1).first()
    assert best.id == "e3" and 0 < best.score <= 1.5 + 1e-9
    done = spark.createDataFrame([("e2",)], "entry_id string")
    assert dense.rebuilt(changed, store, done)[0].where("entry_id = 'e2'").first().content_hash == store.where("entry_id = 'e2'").first().content_hash


def test_drain_keeps_what_fails(spark, entries):
    e = entries([entry(i) for i in range(4)] + [entry(8, status="archived")])
    queue = spark.createDataFrame([(f"e{i}", f"2024-01-0{1 + i % 9}") for i in (0, 1, 1, 2, 8, 77)], "entry_id string, queued_at string")
    store, _ = dense.rebuilt(e.where("id = 'e0'"), spark.createDataFrame([], dense.STORE_SCHEMA))

    def odd(texts):
        if any("Title 2" in t for t in texts):
            raise RuntimeError("no")
        return dense.hashed(texts)

    one = e.withColumn("id", F.col("id"))
    store, left, counts = dense.drained(queue, one.where("id <> 'e2'").unionAll(one.where("id = 'e2'")).repartition(8, "id"), store, 100, odd)
    assert counts["processed"] == 5 and counts["skipped"] == 3 and counts["ok"] + counts["failed"] == 2 and counts["failed"] >= 1
    assert "e2" in {r.entry_id for r in left.collect()} and "e77" not in {r.entry_id for r in left.collect()}
    assert dense.enqueued(queue, queue, 1, 100)[1] == "warn" and dense.enqueued(queue, queue, 1, 2)[1] == "full" and dense.enqueued(queue, queue)[0].count() == 12


def test_estimated_tokens():
    assert dense.tokens_estimated("ab1, 中文 c") == ["ab1", ",", "中", "文", "c"] and dense.truncated("a b c d", 2) == "a b" and dense.truncated("a b", 5) == "a b"
    assert dense.hashed(["x y"]) == dense.hashed(["x y"]) and dense.hashed([""])[0] == [0.0] * dense.DIM


def test_logs(spark, tmp_path, entries):
    root = f"file://{tmp_path}"
    assert logs.recovery(spark, root).count() == logs.fallbacks(spark, root).count() == 0
    for name in ("b1", "b2", "b3"):
        kept = logs.baseline(spark.range(3).toDF("n"), root, name, keep=2)
    assert kept == ["b2", "b3"]
    logs.status_transition(spark, root, "e1", "draft", "active", "2024-01-02T03:04:05", {"job": "x"})
    logs.status_transition(spark, root, "e1", None, "archived", "2024-01-03T03:04:05")
    read = spark.read.json(f"{root}/logs/refresh/status-events/*")
    assert sorted((r.status, r.status_before, r.job) for r in read.collect()) == [("active", "draft", "x"), ("archived", None, None)]
    tables = Snapshots(spark, f"{root}/.tables")
    logs.set_meta(tables, "k", "1")
    logs.set_meta(tables, "k", "2")
    assert [tuple(r) for r in tables.read("meta", "key string, value string").collect()] == [("k", "2")]
    words = logs.dictionary(entries([entry(1, aliases=["x", " "]), entry(2, tags=["t", "u"])]))
    assert sorted((r.term, r.frequency) for r in words.collect()) == [("t", 5), ("u", 5), ("x", 5)]
    (tmp_path / "progress.jsonl").write_text('{"ts": "a", "entry_id": "e1", "status": "ok", "message": "m"}\nbad\n{"ts": "a", "entry_id": "e2", "status": "failed", "message": "m"}\n')
    assert [r.entry_id for r in logs.completed(spark, f"{root}/progress.jsonl").collect()] == ["e1"]


def test_checks(spark, entries):
    rows = entries([entry(1, title="é", source_url="http://x/é", file_path="n/1.md", body="[a](ü.md) [b](http://x/ü)"), entry(2, body="`Ａ` ok"), entry(3, body="x　y")])
    assert {(r.id, r.rule_id) for r in checks.nfc_residuals(rows).collect()} == {("e1", "nfc_residual_in_frontmatter"), ("e1", "nfc_residual_in_source_url"), ("e1", "nfc_residual_in_markdown_link")}
    assert [(r.id, r.char) for r in checks.fullwidth(rows).collect()] == [("e3", "　")]
    terms = entries([entry(1, title="向量", search_terms=["向量", "vector", "vec", "embedding", "向量库"]), entry(2, title="x", search_terms=["x", "", "", "y" * 41, " ", "z", "z"])])
    found = {(r.id, r.problem) for r in checks.term_problems(terms).collect()}
    assert found == {("e2", p) for p in ("no_cjk", "too_long", "blank", "many_empty", "repeated")}
    pairs = checks.cross_language_aliases(entries([entry(i, aliases=a) for i, a in enumerate((["数据", "data"], ["data"], ["data", "x"], ["数据", "data"], ["x"]))]))
    assert {tuple(r) for r in pairs.collect()} == {("e0", "e1", 1), ("e0", "e2", 1), ("e0", "e3", 2), ("e1", "e3", 1), ("e2", "e3", 1)}
    log = spark.createDataFrame([(100_000 + i, f"t{i % 3}") for i in range(50)] + [(1, "old")], logs.FALLBACK)
    assert checks.fallback_summary(log, 100_060).first().n == 50 and checks.fallback_summary(log, 100_060, 51).count() == 0


def test_lists_and_places(spark):
    rows = spark.range(500).select(F.col("id"), (F.col("id") * 7919 % 500).alias("x"))
    assert all(r.place == r.x + 1 for r in placed(rows, F.col("x")).collect())
    one = spark.createDataFrame([("a", 2), ("b", 1)], "id string, place long")
    two = spark.createDataFrame([("b", 1), ("c", 2), ("d", 3)], "id string, place long")
    assert [(r.id, r.place) for r in lists.merged(one, two, 3).orderBy("place").collect()] == [("b", 1), ("a", 2), ("c", 3)]
    files = spark.createDataFrame([("b", False), ("a", False), ("c", True)], "path string, creates boolean")
    assert [r.path for r in lists.mutation_order(files).collect()] == ["c", "a", "b"]
    held = spark.createDataFrame([("e1", 1), ("e2", 2)], "entry_id string, v int")
    fresh = spark.createDataFrame([("e1", 9), ("e2", 9)], "entry_id string, v int")
    assert {tuple(r) for r in lists.refreshed(fresh, held, spark.createDataFrame([("e1",)], "id string")).collect()} == {("e1", 9), ("e2", 2)}
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    assert browse.pick(ids, 3, "a").first().id == "b" and browse.pick(ids.limit(1), 3, "a").first().id == "a"


def test_errors():
    assert [(e.exit_status, e.http_status) for e in (ValidationError, ConflictError, NotFoundError, StorageError)] == [(1, 400), (2, 409), (3, 404), (4, 500)]
    assert BodyTooShort("x", {"length": 3}).details == {"length": 3, "error_code": "body_length_below_min"} and issubclass(BodyTooShort, ValidationError)


def test_watches(spark, tmp_path):
    kb = KnowledgeBase(spark, f"file://{tmp_path}", date(2024, 1, 31))
    for target in ("o/a", "o/b", "o/c"):
        watch.watch(kb, target)
    tags = {"o/a": "v1"}

    def fetch(target):
        if target == "o/c":
            raise OSError("down")
        return {"tag_name": tags[target], "html_url": f"https://x/{target}/{tags[target]}", "body": "b" * 6000, "published_at": "2024-01-05T00:00:00Z"} if target in tags else None

    first = watch.poll(kb, fetch)
    assert (first.new, first.missing, list(first.errors)) == (["o/a"], ["o/b"], ["o/c"])
    assert watch.poll(kb, fetch).unchanged == ["o/a"]
    tags["o/a"] = "v2"
    assert watch.poll(kb, fetch).new == ["o/a"] and watch.poll(kb, fetch).resting == ["o/b"]
    made = {r.title: r for r in kb.entries().collect()}
    assert set(made) == {"o/a v1", "o/a v2"} and made["o/a v1"].superseded_by == made["o/a v2"].id and made["o/a v2"].captured_at == date(2024, 1, 5)
    assert watch.known_hash(kb, watch.url_tag_hash("https://x/o/a/v2", "v2")) and made["o/a v1"].body.endswith("(truncated)")


def test_rules_fail_by_themselves(spark, tmp_path):
    kb = KnowledgeBase(spark, f"file://{tmp_path}")

    def broken():
        raise RuntimeError("x")

    good = spark.createDataFrame([("r", "high", "e1", "m")], "rule_id string, severity string, target_id string, message string")
    assert kb._findings({"a": broken, "b": lambda: good}).count() == 1 and list(kb.failures) == ["a"]
