"""Queue items: one for each rule, entry, origin and proposal, with the messages of all their findings."""

import json
from datetime import date

from lorewright.api import MESSAGES, KnowledgeBase
from lorewright.model import FINDING_SCHEMA

BODY = "A body that is certainly longer than the fifty characters it must have."


def test_findings_of_one_item_keep_their_messages(spark, tmp_path):
    kb = KnowledgeBase(spark, f"file://{tmp_path}", today=date(2024, 1, 31))
    find = lambda *rows: spark.createDataFrame([(r, s, t, None, m) for r, s, t, m in rows], FINDING_SCHEMA)
    kb.enqueue(find(("merge", "medium", "a", "b"), ("merge", "medium", "a", "c"), ("merge", "medium", "d", "e"), ("merge", "low", "z", "y"), ("broken", "high", None, "x")))
    got = {(r.rule_id, r.entry_id): r for r in kb.queue().collect()}
    assert set(got) == {("merge", "a"), ("merge", "d"), ("broken", None)} and json.loads(got["merge", "a"].details_json) == {"messages": ["b", "c"], "n": 2}
    assert got["broken", None].channel == "push" and len({r.id for r in got.values()}) == 3

    kb.enqueue(find(("merge", "medium", "a", "f"), *[("merge", "medium", "d", f"m{i:02d}") for i in range(40)], ("broken", "high", None, "x")))
    again = {(r.rule_id, r.entry_id): r for r in kb.queue().collect()}
    assert {k: r.id for k, r in again.items()} == {k: r.id for k, r in got.items()} and all(again[k].created_at == got[k].created_at for k in got)
    assert json.loads(again["merge", "a"].details_json)["messages"] == ["b", "c", "f"] and again["merge", "a"].message == "b"
    assert json.loads(again["merge", "d"].details_json)["n"] == 41 and len(json.loads(again["merge", "d"].details_json)["messages"]) == MESSAGES
    assert json.loads(again["broken", None].details_json) == {"messages": ["x"], "n": 1}

    kb.transition(again["merge", "a"].id, "resolved")
    kb.enqueue(find(("merge", "medium", "a", "g")))
    assert {(r.status, r.message) for r in kb.queue().where("rule_id = 'merge' and entry_id = 'a'").collect()} == {("resolved", "b"), ("pending", "g")}

    proposed = find(("merge", "medium", "a", "g")).selectExpr("*", "'link' as proposed_op", "'{}' as proposed_payload_json")
    kb.enqueue(proposed)
    assert kb.queue().where("entry_id = 'a' and status = 'pending'").count() == 2  # a proposal is another item


def test_a_status_change_is_logged(spark, tmp_path):
    kb = KnowledgeBase(spark, f"file://{tmp_path}", today=date(2024, 1, 31))
    terms = ["Red foxes", "english", "ABB", "变体", "alias"]
    source = kb.ingest("source", {"title": "One", "search_terms": ["One", *terms[1:]], "body": BODY, "source_type": "web", "source_url": "https://e.org/1", "captured_at": date(2024, 1, 31)})["id"]
    kb.update(source, {"body": BODY + " more"})
    assert not (tmp_path / "logs/refresh/status-events").exists()
    kb.update(source, {"status": "deprecated"})
    rows = spark.read.json(f"file://{tmp_path}/logs/refresh/status-events/*").collect()
    assert [(r.entry_id, r.status_before, r.status) for r in rows] == [(source, "active", "deprecated")]
