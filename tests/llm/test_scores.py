"""Models taken as fitted, each score is worked out again row by row in plain Python; and what the training promises."""

import math

import numpy as np
import pyarrow as pa
from lorewright.llm import lang_id, quality, toxicity
from lorewright.llm.shared import crc_of_id
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def _sigmoid(x):
    return 1 / (1 + math.exp(-min(30, max(-30, x))))


def test_language_scores(spark):
    docs, _ = tables(spark)
    model = lang_id.train(docs, F.coalesce(crc_of_id() % 4 != 2, F.lit(False)))
    by = {r.doc_id: r.text for r in docs.collect()}
    for r in lang_id.identified(docs).collect():
        x = np.zeros(lang_id.DIM)
        raw = (by[r.doc_id] or "").lower().encode()
        codes = [b if b > 127 or chr(b).isalpha() else 32 for b in raw]
        for a, b, c in zip(codes, codes[1:], codes[2:]):  # noqa: B905
            h = ((a * 0x9E3779B1 + b) * 0x85EBCA6B + c) * 0xC2B2AE35 % 2**32
            x[h >> 20] += 1
        n = max(x.sum(), 1)
        logs = [float(model.logs[:, f].astype(float) @ x) / n * min(n, 200) for f in range(len(model.families))]
        shares = [math.exp(v - max(logs)) for v in logs]
        f = int(np.argmax(logs))
        members, score = model.families[f], shares[f] / sum(shares)
        votes = dict.fromkeys(members, 0.0)
        for p, (i, j) in enumerate(model.pairs):
            if i in members:
                sure = _sigmoid(model.slopes[p] * (float(model.weights[:, p].astype(float) @ x) / max(np.linalg.norm(x), 1e-9) + model.biases[p]))
                votes[i] += sure
                votes[j] += 1 - sure
        best = max(members, key=lambda m: votes[m])
        if len(members) > 1:
            score *= votes[best] / (len(members) - 1)
        assert r.lang_pred == model.languages[best] and abs(r.score - score) < 1e-4


def test_toxicity_scores(spark):
    docs, labels = tables(spark)
    model = toxicity.train(docs, labels, F.coalesce(crc_of_id() % 5 != 0, F.lit(False)))
    by = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.judged(docs, labels).collect():
        (own,) = toxicity.features(pa.array([by[r.doc_id]], pa.string()))
        assert abs(r.score - _sigmoid(model.bias + sum(float(model.weights[f]) for f in own))) < 1e-6
        assert r.predicted == int(r.score >= 0.5)


def test_counterfactual_pairs_live_on_the_table(spark):
    """No document names a group; mentions put into them make the pairs, and swapping or adding one changes no score much."""
    docs, labels = tables(spark)
    text = docs.where("lang = 'en'").first().text
    (own,) = toxicity.features(pa.array([text]))
    pairs = toxicity.differences(text, own, 0)
    assert sum(pairs.values()) == 2 * len(set(toxicity.TERMS)) and all(a for a, _ in pairs)
    model = toxicity.train(docs, labels, F.coalesce(crc_of_id() % 5 != 0, F.lit(False)))
    for group in toxicity.IDENTITIES:
        plain, *said = model.score(pa.array([text, *[f"{text} {t}" for t in group]]))
        assert max(said) - min(said) < 0.05 and max(abs(x - plain) for x in said) < 0.05


def test_sentences_are_swapped_all():
    text = ". ".join(["Muslims met"] * 30 + ["no one"])
    assert len(list(toxicity.counterfactuals(text))) == 30
    (own,) = toxicity.features(pa.array([text]))
    assert sum(toxicity.differences(text, own, 1).values()) == 30


def test_quality_scores(spark):
    docs, labels = tables(spark)
    keep = F.coalesce(crc_of_id() % 3 != 1, F.lit(False))
    model = quality.train(docs, labels, keep)
    by = {r.doc_id: r.text for r in docs.collect()}
    got = quality.judged(docs, labels).collect()
    w1, b1, w2, b2 = (x.astype(float) for x in model.layers)
    for r in got:
        ids, _ = quality.tokens(pa.array([by[r.doc_id] or ""], pa.string()))
        own = model.vectors[ids].astype(float)
        x = np.zeros(2 * quality.DIM + 1)
        if len(ids):
            x[: quality.DIM], x[quality.DIM : -1], x[-1] = own.mean(axis=0), np.sqrt(np.maximum(own.var(axis=0), 0)), math.log(len(ids))
        z = float(np.tanh(np.clip((x - model.mean) / model.spread, -8, 8) @ w1 + b1) @ w2 + b2[0])
        assert abs(r.score - _sigmoid(z / model.temperature + model.shift)) < 5e-3
    again = {r.doc_id: r.score for r in quality.judged(docs.repartition(5), labels).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in got)


def test_calibration_takes_the_prior():
    rng = np.random.default_rng(2)
    y = (rng.random(4000) < 0.85).astype(float)
    logits = 3 * (rng.standard_normal(4000) + np.where(y == 1, 1.0, -1.0))
    picked = np.concatenate([np.flatnonzero(y == 1)[:500], np.flatnonzero(y == 0)[:500]])  # as many of each label
    temperature, shift = quality.calibrated(logits[picked], y[picked], 0.85)
    p = 1 / (1 + np.exp(-(logits / temperature + shift)))
    bins = np.minimum((p * 10).astype(int), 9)
    error = sum(abs(p[bins == b].mean() - y[bins == b].mean()) * (bins == b).mean() for b in range(10) if (bins == b).any())
    assert error < 0.03
