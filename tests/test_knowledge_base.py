import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from lorewright.api import KnowledgeBase, ulid
from lorewright.errors import ConflictError, NotFoundError, ValidationError
from lorewright.govern import autonomous
from lorewright.sources import markdown
from lorewright.streaming import flows

BODY = "A body that is certainly longer than the fifty characters it must have."


def payload(title, **more):
    return {"title": title, "search_terms": [title, "english", "ABB", "变体", "alias"], "body": BODY} | more


@pytest.fixture
def kb(spark, tmp_path):
    return KnowledgeBase(spark, str(tmp_path), date(2024, 1, 31))


def source(kb, title, **more):
    return kb.ingest("source", payload(title, source_type="web", source_url="https://e.org/1", captured_at=date(2024, 1, 31)) | more)["id"]


def test_life_of_entries(kb):
    s = source(kb, "First source")
    note = kb.ingest("note", payload("A note on foxes", source_refs=[s]))
    assert note["slug"] == "A-note-on-foxes" and note["id"].startswith("ek_note_")
    with pytest.raises(NotFoundError):
        kb.ingest("note", payload("Unknown reference", source_refs=["ek_src_none"]))
    with pytest.raises(ValidationError):
        kb.ingest("note", payload("Short") | {"body": "short"})
    with pytest.raises(ValidationError):
        kb.ingest("note", payload("Colour", colour="red"))
    with pytest.raises(ConflictError):
        kb.ingest("note", payload("A note on foxed"))
    assert kb.ingest("note", payload("A note on foxed"), "allow")["candidates"] == [note["id"]]
    assert kb.update(note["id"], {"status": "draft"})["status"] == "draft"
    with pytest.raises(ValidationError):
        kb.update(note["id"], {"kind": "concept"})
    dossier = kb.promote(note["id"], "dossier")
    assert dossier["evidence_refs"] == [s] and dossier["review_due_at"] == date(2024, 3, 1)
    concept = kb.promote(dossier["id"], "concept")
    assert concept["evidence_status"] == "partial"
    decision = kb.promote(concept["id"], "decision")
    assert decision["decision_status"] == "active"
    with pytest.raises(ValidationError):
        kb.promote(s, "concept")
    assert kb.link(concept["id"], s, "related")["origin"] == "confirmed"
    kb.unlink(concept["id"], s) if s not in concept["evidence_refs"] else None
    assert kb.rename(concept["id"], "foxes")["file_path"].endswith("/foxes.md")
    kb.recompute()
    facts = {r.entry_id: r for r in kb.metrics().collect()}
    assert facts[note["id"]].evidence_strength == pytest.approx(1.0) and sum(r.authority_score for r in facts.values()) == pytest.approx(1.0)
    found = [r.id for r in kb.search("foxes").collect()]
    assert note["id"] in found
    assert {r.value: r.n for r in kb.stats("kind").collect()}["note"] == 2
    assert kb.related(note["id"]).where(F.col("id") == s).count() == 1
    findings = kb.diagnose()
    kb.enqueue(findings)
    n = kb.queue().count()
    kb.enqueue(findings)
    assert kb.queue().count() == n == findings.where("severity <> 'low'").dropDuplicates(["rule_id", "target_id"]).count()
    assert kb.doctor().where("severity = 'high'").isEmpty()
    kb.delete(decision["id"])
    with pytest.raises(NotFoundError):
        kb.get(decision["id"])


def test_autonomy(kb):
    a, b = source(kb, "Source alpha"), source(kb, "Source omega")
    assert autonomous.act(kb, "link", {"source_id": a, "target_id": b, "type": "related"}, "agent")["action"] == "executed"
    body = autonomous.act(kb, "update", {"id": a, "changes": {"body": BODY * 2}}, "agent")
    assert body["action"] == "queued_for_approval" and kb.get(a)["body"] == BODY
    autonomous.approve(kb, body["queue_id"])
    assert kb.get(a)["body"] == BODY * 2
    with pytest.raises(ConflictError):
        autonomous.approve(kb, body["queue_id"])
    assert autonomous.act(kb, "domains_add", {"name": "zoology"}, "agent")["action"] == "queued_for_approval"
    with pytest.raises(ValidationError):
        autonomous.act(kb, "erase", {}, "agent")
    assert kb.access_log().count() == 2


def test_markdown_round_trip(kb, tmp_path):
    (tmp_path / "entries").mkdir()
    entry = {"id": "ek_note_1", "kind": "note", "title": "T：x", "status": "active", "freshness": "watch", "created_at": date(2024, 1, 1), "updated_at": date(2024, 1, 2), "tags": ["t"], "relations": [{"target": "ek_src_1", "type": "related", "source": "confirmed"}], "source_refs": ["ek_src_1"]}
    (tmp_path / "entries" / "a.md").write_text(markdown.rendered(entry, BODY))
    (tmp_path / "entries" / "b.md").write_text("no front matter")
    (tmp_path / "entries" / "c.md").write_text("---\nid: x\n  bad: [\n---\n\nbody")
    bad = {r.file_path: r.error for r in kb.build().collect()}
    assert set(bad) == {"entries/b.md", "entries/c.md"}
    row = kb.get("ek_note_1")
    assert row["created_at"] == date(2024, 1, 1) and row["body"].strip() == BODY and row["relations"][0]["target"] == "ek_src_1"
    assert {(r.type, r.origin) for r in kb.relations().collect()} == {("related", "confirmed"), ("source_refs", "confirmed")}
    assert kb.doctor().where("rule_id = 'broken_relations'").count() == 2


def test_ulid_sorts_by_time():
    assert len(ulid()) == 26 and ulid(1_000_000) < ulid(2_000_000)


def test_streams(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    rows = [{"entry_id": "a", "op": "get", "accessed_at": f"2024-01-{d:02d}T10:00:00"} for d in (1, 1, 31)]
    (log / "1.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    counts = flows.to_memory(flows.daily_counts(flows.access_stream(spark, str(log))), "daily")
    assert {(str(r.day), r.n) for r in counts.collect()} == {("2024-01-01", 2), ("2024-01-31", 1)}
    assert flows.heat_of_counts(counts, "2024-01-31").first().heat == pytest.approx(2.0)
    seen = []
    flows.drain(flows.access_stream(spark, str(log)), str(tmp_path / "cp"), lambda df, n: seen.extend(r.entry_id for r in df.collect())).awaitTermination()
    assert seen == ["a"]
