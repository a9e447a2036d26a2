"""What the pipeline's stages put on the driver: training rows, models in plans, and plans of steps that repeat."""

import pickle

import numpy as np
import pyarrow as pa
from lorewright.llm import components, lang_id, mixing, toxicity


def _plans(monkeypatch, module):
    """The optimised plans of the tables that a module writes from now on."""
    plans, write = [], module.written

    def seen(df, tag):
        plans.append((tag, df._jdf.queryExecution().optimizedPlan().toString()))
        return write(df, tag)

    monkeypatch.setattr(module, "written", seen)
    return plans


def test_rounds_do_not_repeat_where_edges_come_from(spark, monkeypatch):
    plans = _plans(monkeypatch, components)
    a = spark.createDataFrame([(i, i + 1) for i in range(20)], "k long, a long")
    b = spark.createDataFrame([(i, 100 + i // 5) for i in range(20)], "k long, marked long")
    found = components.connected_components(a.join(b, "k").selectExpr("a", "marked as b"))
    assert {(r.node, r.component) for r in found.collect()} >= {(101, 6), (103, 16), (20, 16)}
    assert sum("marked" in plan for _, plan in plans) == 1


def test_a_step_joins_its_multipliers_once(spark, monkeypatch):
    plans = _plans(monkeypatch, mixing)
    docs = spark.createDataFrame([(i, "w " * (i % 9 + 1), "en", "abc"[i % 3], 0) for i in range(300)], "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.copies(docs).collect()
    assert len(got) == 300 and all(0 <= r.copies <= mixing.MOST_COPIES for r in got)
    steps = [plan for tag, plan in plans if tag == "multipliers"][1:]
    repairs = [plan for tag, plan in plans if tag == "cells"][2:]
    assert steps and all(plan.count("Join ") == 1 for plan in steps)
    assert len(repairs) == mixing.REPAIRS and all(plan.count("Join ") == 2 for plan in repairs)


def test_training_rows_travel_compressed():
    texts = ["the river and the house", "", "ein Fluss und ein Haus " * 50]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["en", "en", "de"]), pa.array(texts)], ["doc_id", "lang", "text"])
    (out,) = lang_id._featured(iter([batch]))
    assert max(len(x.as_py()) for x in out.column("x")) < lang_id.DIM  # 4 * DIM bytes each before


def test_a_plan_holds_the_live_weights_alone():
    weights = np.zeros(1 << toxicity.BITS, np.float32)
    weights[[3, 70_000]] = 1.5, -2
    model = toxicity.Model(weights, 0.25)
    data = pickle.dumps(model)
    again = pickle.loads(data)
    assert len(data) < 10_000 and (again.weights == weights).all() and again.weights.dtype == np.float32 and again.bias == 0.25
