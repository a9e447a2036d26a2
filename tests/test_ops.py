import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from lorewright import cli, ops
from lorewright.api import KnowledgeBase
from lorewright.errors import ConflictError
from tests.test_knowledge_base import payload, source


@pytest.fixture
def kb(spark, tmp_path):
    return KnowledgeBase(spark, str(tmp_path), date(2024, 1, 31))


def test_archive_and_restore(kb):
    a, b = source(kb, "Source alpha", status="draft"), source(kb, "Source omega", status="draft")
    with pytest.raises(ConflictError):
        ops.archive_plan(kb, "status = draft", 3)
    plan, signed = ops.archive_plan(kb, "kind = source AND status = draft", 2, {"kind": "source"})
    plan = kb.spark.createDataFrame(plan.collect(), plan.schema)
    kb.update(b, {"status": "active"})
    done = {r.id: r.outcome for r in ops.archive(kb, plan, signed).collect()}
    assert done == {a: "archived", b: "changed"} and kb.get(a)["status"] == "archived"
    with pytest.raises(ConflictError):
        ops.archive(kb, plan.where(F.col("id") == a), signed)
    events = kb.spark.createDataFrame([(a, "archived")], "entry_id string, status string")
    assert {(r.id, r.problem) for r in ops.reconcile(kb, plan, events).collect()} == {(b, "not archived")}
    assert ops.restore(kb, plan, kb.spark.createDataFrame([(a,)], "id string")) == 1 and kb.get(a)["status"] == "draft"
    log = kb.spark.createDataFrame([(a, "archive", "started", 1), (a, "archive", "failed", 2), (a, "archive", "done", 3), (b, "archive", "started", 4)], ops.LOG_SCHEMA)
    assert {r.entry_id: r.status for r in ops.log_state(log).collect()} == {a: "done", b: "started"}


def test_relation_cleanup(kb):
    a, b = source(kb, "Source alpha"), source(kb, "Source omega")
    kb.link(a, b, "related", "ai_suggested")
    kb.link(a, b, "part_of")
    kb.delete(b)
    with pytest.raises(ConflictError):
        ops.clean_relations(kb, 5)
    assert [r.type for r in ops.clean_relations(kb, 1).collect()] == ["part_of"] and [r["type"] for r in kb.get(a)["relations"]] == ["part_of"]


def test_punctuation(spark):
    files = spark.createDataFrame([("a.md", "---\ntitle：x，y\n---\n\nbody：\n"), ("b.md", "---\ntitle: x\n---\n\nb"), ("c.md", "title：")], "file_path string, content string")
    row = ops.punctuation_changes(files).withColumn("n", ops.character_diff(F.col("before"), F.col("after"))).collect()
    assert [(r.file_path, r.after, r.n) for r in row] == [("a.md", "title:x,y\n", 2)]


def test_command_line(kb, spark, capsys):
    call = lambda *args: (cli.main(["--root", kb.root, *args], spark), capsys.readouterr())
    status, said = call("ingest", "note", json.dumps(payload("A note on foxes")))
    made = json.loads(said.out)
    assert status == 0 and json.loads(call("get", made["id"])[1].out)["title"] == "A note on foxes"
    assert json.loads(call("stats", "kind")[1].out) == [{"value": "note", "n": 1}]
    status, said = call("get", "ek_none")
    assert status == 3 and json.loads(said.err)["code"] == "not_found"
