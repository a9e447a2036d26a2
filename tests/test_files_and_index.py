from datetime import date
from pathlib import Path

import pytest

from lorewright.api import KnowledgeBase
from lorewright.errors import NotFoundError
from lorewright.operators import fulltext
from lorewright.sources import markdown
from lorewright.sources.files import FileChanges

BODY = "A body that is certainly longer than the fifty characters it must have."


def payload(title, **more):
    return {"title": title, "search_terms": [title, "english", "ABB", "变体", "alias"], "body": BODY} | more


@pytest.fixture
def kb(spark, tmp_path):
    return KnowledgeBase(spark, str(tmp_path), date(2024, 1, 31))


def files_of(root):
    return {str(p.relative_to(root)): p.read_text() for d in ("entries", "sources") for p in Path(root, d).rglob("*") if p.is_file()}


def rows_of(kb):
    drop = {"file_path"}
    return {r.id: {k: v.strip() if k == "body" else v for k, v in r.asDict(recursive=True).items() if v not in (None, [], "") and k not in drop} for r in kb.entries().collect()}


def test_mutations_reach_files_and_the_index(kb, tmp_path):
    s = kb.ingest("source", payload("First：source", source_type="web", source_url="https://e.org/1", captured_at=date(2024, 1, 31)))["id"]
    a = kb.ingest("concept", payload("Red foxes", evidence_refs=[s], body=BODY + " fox fox den"))
    b = kb.ingest("concept", payload("Blue whales", evidence_refs=[s], body=BODY + " fox whale"))
    assert set(files_of(tmp_path)) == {r.file_path for r in kb.entries().collect()}
    before = rows_of(kb)
    assert kb.build().isEmpty()
    assert rows_of(kb) == before and before[s]["title"] == "First：source"
    assert kb.index() is not None

    kb.update(a["id"], {"body": BODY + " burrow"})
    kb.rename(b["id"], "whales")
    assert b["file_path"] not in files_of(tmp_path) and any(p.endswith("/whales.md") for p in files_of(tmp_path))
    index = kb.index()
    fresh = fulltext.postings(kb.entries(), index.known)
    assert index.postings.exceptAll(fresh).isEmpty() and fresh.exceptAll(index.postings).isEmpty()
    assert index.sizes.exceptAll(fulltext.sizes(fresh)).isEmpty() and index.totals == fulltext.totals(fulltext.sizes(fresh), kb.entries().count())
    assert [r.id for r in kb.search("burrow", graph_expansion=False).collect()] == [a["id"]]

    files, rows = files_of(tmp_path), rows_of(kb)
    with pytest.raises(NotFoundError):
        kb.apply([("update", {"entry_id": a["id"], "changes": {"body": BODY + " lost"}}), ("ingest", {"kind": "concept", "payload": payload("Green frogs", evidence_refs=[s])}), ("delete", {"entry_id": b["id"]}), ("touch", {"entry_id": "ek_none"})])
    assert files_of(tmp_path) == files and rows_of(kb) == rows
    done = kb.apply([("delete", {"entry_id": b["id"]}), ("ingest", {"kind": "concept", "payload": payload("Green frogs", evidence_refs=[s])})])
    assert done[0] is None and done[1]["file_path"] in files_of(tmp_path) and len(files_of(tmp_path)) == 3
    assert not list((tmp_path / ".changes").iterdir())
    kb.build()
    assert set(rows_of(kb)) == {s, a["id"], done[1]["id"]}


def test_file_changes_are_taken_back(spark, tmp_path):
    (tmp_path / "a.md").write_text("old")
    changes = FileChanges(spark, str(tmp_path))
    changes.write("a.md", "new")
    changes.write("a.md", "newer")
    changes.write("deep/b.md", "b")
    changes.remove("a.md")
    changes.remove("none.md")
    changes.undo()
    assert (tmp_path / "a.md").read_text() == "old" and not (tmp_path / "deep/b.md").exists()


def test_a_lost_run_is_taken_back(spark, tmp_path):
    (tmp_path / "a.md").write_text("old")
    (tmp_path / "c d.md").write_text("c")
    lost = FileChanges(spark, str(tmp_path))
    lost.write("a.md", "new")
    lost.write("deep/b.md", "b")
    lost.write("deep/b.md", "b again")
    lost._aside("c d.md")  # lost before the new file came
    assert FileChanges.recover(spark, str(tmp_path)) == 1 and FileChanges.recover(spark, str(tmp_path)) == 0
    assert (tmp_path / "a.md").read_text() == "old" and (tmp_path / "c d.md").read_text() == "c" and not (tmp_path / "deep/b.md").exists()


def test_rendered_files_are_read_back(spark, tmp_path):
    entry = {"id": "x", "kind": "note", "title": "“Quoted”：a，b", "status": "active", "freshness": "watch", "tags": ["’t", "- x"], "created_at": date(2024, 1, 2), "relations": [{"target": "y", "type": "related", "source": "confirmed"}]}
    rows = markdown.parsed(spark.createDataFrame([("entries/x.md", markdown.rendered(entry, "---\nbody\n"))], "file_path string, content string")).collect()
    assert rows[0].error is None and {k: rows[0].asDict(recursive=True)[k] for k in entry} == entry and rows[0].body == "---\nbody\n"
