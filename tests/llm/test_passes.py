"""Recall of the sorted passes, and links counted in a component that is no tight cluster."""

import numpy as np
import pytest
from lorewright.llm import embedding_dedup
from tests.llm import brute, recall


@pytest.mark.parametrize("rows,common,least", [(100_000, 0.0, 0.995), (20_000, 0.5, 0.995), (10_000, 0.8, 0.99)])
def test_recall_of_planted_links(rows, common, least):
    assert recall.recall(recall.table(rows, common)) >= least


def test_passes_and_sorts_grow():
    assert embedding_dedup.passes_for(1, 0.95, 0) < embedding_dedup.passes_for(1000, 0.95, 0) < embedding_dedup.passes_for(10**6, 0.95, 0)
    assert embedding_dedup.sorts_for(10_000, 0.95, 0, 32) < embedding_dedup.sorts_for(10_000, 0.95, 0.6, 32)


def test_rim_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    monkeypatch.setattr(embedding_dedup, "PIECE", 16)
    rng = np.random.default_rng(9)
    walk = np.cumsum(rng.standard_normal((150, 8)) * 0.12, axis=0) + 2
    rows = [(i, v.tolist()) for i, v in enumerate(walk)] + [(1000 + i, walk[0].tolist()) for i in range(30)]
    frame = spark.createDataFrame([(i, v, "a", "b") for i, v in rows], "vec_id long, embedding array<double>, id string, component string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(frame).collect()}
    assert got == brute.vector_groups(rows)
