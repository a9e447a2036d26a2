"""Quality by random-indexing word vectors pooled per document, and a two-layer network with calibrated probabilities.

Tokens are runs of one class (letters and digits, or ASCII symbols), lower-cased and hashed into BUCKETS words. Every word has
a fixed sparse index vector; a word's context vector is the sum of the index vectors within WINDOW tokens of it, over all
documents. Tasks add up their own documents' contexts and a grouped sum adds the tasks', BUCKETS rows each. A document is the
mean and the deviation of its words' unit context vectors. The network sees at most PER_CLASS labelled rows of each label; its
temperature is fitted on a fifth of them that it isn't trained on. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewright.llm.kernel import RUNS, buffers, mix, slices, words
from lorewright.llm.shared import crc_of_id, labelled_sample

BUCKETS, DIM, NONZERO, WINDOW = 8192, 64, 4, 2
#: The bound of the labelled sample.
PER_CLASS = 3000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 64, 0.003, 1e-4


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places (BUCKETS, NONZERO) and signs of the words' index vectors."""
    h = mix(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(977)).reshape(BUCKETS, NONZERO)
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers, and how many come before each row (one more than rows)."""
    raw, at = buffers(pc.utf8_lower(texts))
    h, before, _ = words(raw, at, RUNS, lower=False, runs=True)
    return (h % np.uint64(BUCKETS)).astype(np.int64), before


def contexts(ids: np.ndarray, before: np.ndarray, out: np.ndarray) -> None:
    """Add the rows' contexts to out (BUCKETS * DIM,)."""
    places, signs = index_vectors()
    row = np.repeat(np.arange(len(before) - 1), np.diff(before))
    for step in range(1, WINDOW + 1):
        near = row[:-step] == row[step:]
        left, right = ids[:-step][near], ids[step:][near]
        for word, other in ((left, right), (right, left)):
            for k in range(NONZERO):
                out += np.bincount(word * DIM + places[other, k], weights=signs[other, k], minlength=len(out))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(BUCKETS, DIM) unit context vectors of all documents; words that don't occur are 0."""
    names = [f"c{i}" for i in range(DIM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS * DIM)
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                ids, before = tokens(batch.column("text"))
                if len(ids) > WINDOW:
                    contexts(ids, before, sums)
        table = sums.reshape(BUCKETS, DIM)
        own = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *(pa.array(table[own, i].astype(np.int64)) for i in range(DIM))], ["word", *names])

    # sums of whole numbers, so their order doesn't show; BUCKETS rows at most
    sums = docs.select("text").mapInArrow(run, "word int, " + ", ".join(f"{n} long" for n in names)).groupBy("word").agg(*[F.sum(n).alias(n) for n in names])
    found = sums.toPandas()
    out = np.zeros((BUCKETS, DIM))
    out[found["word"].to_numpy()] = found[names].to_numpy()
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray, block: int = 64) -> np.ndarray:
    """(rows, 2 * DIM + 1): mean and deviation of the words' vectors, and log length; a row without words is 0."""
    ids, before = tokens(texts)
    both = np.hstack([vectors, vectors**2])
    out = np.zeros((len(texts), 2 * DIM + 1), np.float32)
    for a in range(0, len(texts), block):
        b = min(a + block, len(texts))
        table = np.stack([np.bincount(ids[before[i] : before[i + 1]], minlength=BUCKETS) for i in range(a, b)]).astype(np.float32)
        n = np.maximum(table.sum(axis=1, keepdims=True), 1)
        sums = table @ both / n
        out[a:b, :DIM] = sums[:, :DIM]
        out[a:b, DIM:-1] = np.sqrt(np.maximum(sums[:, DIM:] - sums[:, :DIM] ** 2, 0))
        out[a:b, -1] = np.log(n[:, 0])
    return out


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]  # weights and biases in turn
    temperature: float
    shift: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(np.clip((x - self.mean) / self.spread, -8, 8) @ w1 + b1) @ w2 + b2

    def score(self, texts: pa.Array) -> np.ndarray:
        z = self.logits(pooled(texts, self.vectors)) / self.temperature + self.shift
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def calibrated(logits: np.ndarray, y: np.ndarray, share: float, rounds: int = 50) -> tuple[float, float]:
    """Temperature and shift under which logits / temperature + shift is likeliest for the labels at the prior `share` of
    label 1. Targets are drawn in by one observation of each label, so separable rows don't run off."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, share / n1, (1 - share) / n0)
    x = np.stack([logits.astype(np.float64), np.ones(len(y))], axis=1)
    loss = lambda t: float((weight * (np.logaddexp(0, x @ t) - target * (x @ t))).sum())
    theta = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (weight * (p - target)))
        size = 1.0
        while size > 1e-6 and loss(theta - size * step) > loss(theta):
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    slope = max(float(theta[0]), 1e-3)
    return 1 / slope, float(theta[1])


def fit(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, share: float = 0.5) -> Model:
    """Train on four fifths of the rows by Adam steps, and fit temperature and shift on the others. share: of label 1 among
    all labelled rows; the sample's classes weigh alike in training, and the calibration takes them at that share. Where too
    few rows are held back to calibrate on, the shift alone follows from the share."""
    if not len(y):
        x, y = np.zeros((1, 2 * DIM + 1), np.float32), np.zeros(1)
    rng = np.random.default_rng(11)
    order = rng.permutation(len(y))
    held = order[: len(y) // 5] if len(y) >= 50 else order[:0]
    own = order[len(held) :]
    mean, spread = x[own].mean(axis=0), x[own].std(axis=0) + 1e-3
    z = np.clip((x - mean) / spread, -8, 8)
    each = np.where(y == 1, 0.5 / max(1, (y[own] == 1).sum()), 0.5 / max(1, (y[own] == 0).sum())) * len(own)
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second, t = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(own), max(1, len(own) // BATCH)):
            t += 1
            w1, b1, w2, b2 = layers
            h = np.tanh(z[batch] @ w1 + b1)
            e = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30))) - y[batch]) * each[batch] / len(batch)
            back = e[:, None] * w2 * (1 - h**2)
            for i, g in enumerate((z[batch].T @ back + DECAY * w1, back.sum(axis=0), h.T @ e + DECAY * w2, np.array([e.sum()]))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g**2
                layers[i] = layers[i] - RATE * first[i] / (1 - 0.9**t) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    model = Model(vectors, mean, spread, [p.astype(np.float32) for p in layers], 1.0, 0.0)
    if len(held) and 0 < y[held].sum() < len(held):
        model.temperature, model.shift = calibrated(model.logits(x[held]), y[held], min(max(share, 0.01), 0.99))
    else:
        model.shift = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    return model


def train(docs: DataFrame, labels: DataFrame, keep: Column, per_class: int = PER_CLASS) -> Model:
    """A model of docs (doc_id, text) by labels (doc_id, quality) where keep holds; contexts come from all docs. Labels
    other than 0 and 1 take no part."""
    vectors = word_vectors(docs)
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & keep)
    good, all_ = own.agg(F.count(F.when(F.col("quality") == 1, 1)), F.count("quality")).first()
    taken = F.broadcast(labelled_sample(labels, "quality", keep, per_class))  # two labels: at most 2 * per_class rows
    sample = docs.select("doc_id", "text").join(taken, "doc_id")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                x = pooled(batch.column("text"), vectors)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    found = sorted(sample.mapInArrow(featured, "doc_id long, label int, x binary").collect(), key=lambda r: (r.doc_id, bytes(r.x)))
    x = np.stack([np.frombuffer(r.x, np.float32) for r in found]) if found else np.zeros((0, 2 * DIM + 1), np.float32)
    return fit(x, np.array([r.label for r in found], float), vectors, good / all_ if all_ else 0.5)


def scored(docs: DataFrame, model: Model, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with score and predicted, called `names`, behind its columns (text string is read)."""
    out = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                score = model.score(batch.column("text"))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], out.names)

    return docs.mapInArrow(run, out)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id long, text string; other columns are left).

    Learned from labels (doc_id, quality) of rows that are not held out (crc32 of the id modulo 3 is 1). A null or empty text
    has the score of no words; a null doc_id is held out. Without labels the network is near its start. Repeated rows stay;
    an empty table gives no rows.
    """
    held = F.coalesce(crc_of_id() % 3 == 1, F.lit(True))
    model = train(docs, labels, ~held)
    return scored(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
