"""Keyed tables in hash buckets: a change writes the buckets it touches, and readers see whole versions."""

import pytest
from pyspark.sql import functions as F

from lorewright.sources import snapshots
from lorewright.sources.snapshots import Snapshots

SCHEMA = "id long, value string"


@pytest.fixture
def tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "BUCKET_ROWS", 10)
    return Snapshots(spark, f"file://{tmp_path}")


def rows(tables, found):
    return tables.spark.createDataFrame(list(found.items()), SCHEMA)


def held(tables, name="t"):
    return {r.id: r.value for r in tables.read(name, SCHEMA).collect()}


def test_a_change_writes_the_buckets_it_touches(tables):
    want = {i: f"v{i}" for i in range(200)}
    first = tables.write("t", rows(tables, want), ["id"])
    before = tables.manifest("t", first)
    assert before.buckets == 32 and sum(n for _, n in before.parts.values()) == 200 and held(tables) == want

    second = tables.merge("t", SCHEMA, rows(tables, {7: "new", 1000: "more"}).withColumn("id", F.col("id").cast("int")), ["id"])
    want |= {7: "new", 1000: "more"}
    after = tables.manifest("t", second)
    moved = {b for b in before.parts.keys() | after.parts.keys() if before.parts.get(b) != after.parts.get(b)}
    assert held(tables) == want and 1 <= len(moved) <= 2
    read = {f.split("/")[-2] for f in tables.read("t", SCHEMA).inputFiles()}
    assert read == {folder.split("/")[-1] for folder, _ in after.parts.values()}

    tables.delete("t", SCHEMA, rows(tables, {7: "", 8: "", 5000: ""}), ["id"])
    del want[7], want[8]
    assert held(tables) == want
    tables.restore("t", first)
    assert held(tables) == {i: f"v{i}" for i in range(200)}


def test_buckets_double_as_the_table_grows(tables):
    want = {i: "a" for i in range(5)}
    tables.merge("t", SCHEMA, rows(tables, want), ["id"])
    assert tables.manifest("t", tables.version("t")).buckets == 1
    for start in range(5, 105, 20):
        more = {i: f"b{i}" for i in range(start, start + 20)}
        tables.merge("t", SCHEMA, rows(tables, more), ["id"])
        want |= more
    made = tables.manifest("t", tables.version("t"))
    assert held(tables) == want and made.buckets > 4 and sum(n for _, n in made.parts.values()) == 105


def test_tables_without_keys_become_keyed(tables):
    tables.write("t", rows(tables, {1: "a", 2: "b"}))
    tables.merge("t", SCHEMA, rows(tables, {2: "c"}), ["id"])
    assert held(tables) == {1: "a", 2: "c"} and tables.manifest("t", tables.version("t")).keys == ["id"]
    with pytest.raises(ValueError):
        tables.append("t", rows(tables, {3: "d"}))
    name = tables.version("t")
    assert tables.merge("t", SCHEMA, rows(tables, {}) if False else tables.read("t", SCHEMA).limit(0), ["id"]) == name  # nothing to do
    tables.delete("t", SCHEMA, rows(tables, {1: "", 2: ""}), ["id"])
    assert held(tables) == {}
    tables.merge("t", SCHEMA, rows(tables, {5: "e"}), ["id"])
    assert held(tables) == {5: "e"}


def test_null_keys_meet_nothing(tables):
    tables.write("t", rows(tables, {1: "a"}), ["id"])
    for _ in range(2):
        tables.merge("t", SCHEMA, tables.spark.createDataFrame([(None, "n")], SCHEMA), ["id"])
    assert sorted(((r.id or 0), r.value) for r in tables.read("t", SCHEMA).collect()) == [(0, "n"), (0, "n"), (1, "a")]


def test_a_lost_write_changes_nothing_and_is_cleared(tables, monkeypatch):
    want = {i: f"v{i}" for i in range(60)}
    tables.write("t", rows(tables, want), ["id"])
    with monkeypatch.context() as patch:
        patch.setattr(tables, "_point", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            tables.merge("t", SCHEMA, rows(tables, {3: "half"}), ["id"])
    assert held(tables) == want
    for i in range(3):
        tables.merge("t", SCHEMA, rows(tables, {i: "x"}), ["id"])
        want[i] = "x"
    assert tables.vacuum("t", keep=1) > 0 and held(tables) == want and tables.vacuum("t", keep=1) == 0
    tables.merge("t", SCHEMA, rows(tables, {9: "y"}), ["id"])
    assert held(tables) == want | {9: "y"}
