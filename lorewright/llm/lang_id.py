"""Language identification in two levels: a naive Bayes model picks the language family, then one-versus-one linear support
vector machines tell the family's languages apart.

Features are counts of byte trigrams of the whole lower-cased text, hashed into DIM buckets, with every ASCII byte that is no
letter read as a space. Training rows are a sample of at most PER_LANGUAGE labelled rows of each language; they are
featurised on the executors and fitted on the driver. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewright.llm.kernel import buffers, slices
from lorewright.llm.shared import crc_of_id, fresh, smallest_hashes

DIM = 4096
#: Rows whose counts are held at once.
ROWS = 1024
#: The bound of the labelled sample: rows of each language, and rows in all.
PER_LANGUAGE, MOST_ROWS = 400, 2400
ROUNDS, COST = 150, 10.0
UNDEFINED = "und"
#: Families of language codes (fixed values); a code that is not here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "indic": ("hi", "bn", "mr", "ur", "pa", "gu", "ne"),
    "semitic": ("ar", "he", "mt"),
    "turkic": ("tr", "az", "kk", "uz"),
    "sinitic": ("zh", "yue"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
_LETTERS = np.where([chr(b).isalpha() or b > 127 for b in range(256)], np.arange(256), 32).astype(np.uint32)


def family(code: str) -> str:
    return _FAMILY.get(code.lower().split("-")[0], f"only {code}")


def counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, DIM) trigram counts, and whether a row has a letter."""
    raw, at = buffers(pc.utf8_lower(texts))
    letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    codes = _LETTERS[raw]
    grams = codes[:0]
    if len(codes) > 2:
        grams = ((codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1]) * np.uint32(0x85EBCA6B) + codes[2:]) * np.uint32(0xC2B2AE35) >> np.uint32(20)
    out = np.zeros((len(texts), DIM), np.float32)
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        if b - a > 2:
            out[i] = np.bincount(grams[a : b - 2], minlength=DIM)
    return out, letters


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def support_vectors(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, cost: float = COST) -> tuple[np.ndarray, float]:
    """Weights and bias of the squared-hinge machine for y in {-1, 1}, by accelerated gradient steps; each side weighs alike."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    side = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = v = np.zeros(x.shape[1])
    rate = 1 / (1 + 2 * cost * float((side[:, None] * x**2).sum()))
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v)) * side
        new = v - rate * (v - 2 * cost * (x.T @ (slack * y)))
        w, v = new, new + t / (t + 3) * (new - w)
    return w[:-1].astype(np.float32), float(w[-1])


def _slope(margins: np.ndarray, y: np.ndarray) -> float:
    """The steepness at which a logistic curve over the margins fits best, of a few."""
    tried = np.array([1.0, 2, 4, 8, 16, 32])
    return float(tried[np.argmin([np.logaddexp(0, -s * y * margins).mean() + 0.002 * s for s in tried])])


@dataclass
class Model:
    languages: list[str]
    families: list[list[int]]
    logs: np.ndarray  # (DIM, families): log shares of trigrams
    pairs: list[tuple[int, int]]
    weights: np.ndarray  # (DIM, pairs)
    biases: np.ndarray
    slopes: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language numbers and scores of count rows."""
        evidence = (x @ self.logs) / np.maximum(x.sum(axis=1, keepdims=True), 1) * np.minimum(x.sum(axis=1, keepdims=True), 200)
        share = np.exp(evidence - evidence.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        best, margins = share.argmax(axis=1), _unit(x) @ self.weights + self.biases
        sure = 1 / (1 + np.exp(-np.clip(self.slopes * margins, -30, 30)))
        language, score = np.zeros(len(x), int), share.max(axis=1)
        for f, members in enumerate(self.families):
            own = np.flatnonzero(best == f)
            if len(members) == 1:
                language[own] = members[0]
                continue
            votes = np.zeros((len(own), len(members)))
            for p, (i, j) in enumerate(self.pairs):
                if i in members:
                    votes[:, members.index(i)] += sure[own, p]
                    votes[:, members.index(j)] += 1 - sure[own, p]
            first = votes.argmax(axis=1)
            language[own] = np.array(members)[first]
            score[own] *= votes[np.arange(len(own)), first] / (len(members) - 1)
        return language, np.clip(score, 0, 1)


def fit(x: np.ndarray, langs: np.ndarray) -> Model:
    languages = sorted(set(langs))
    names = sorted({family(c) for c in languages})
    families = [[i for i, c in enumerate(languages) if family(c) == f] for f in names]
    number = np.array([languages.index(c) for c in langs])
    sums = np.stack([x[number == i].sum(axis=0) / max(1.0, x[number == i].sum()) for i in range(len(languages))])
    logs = np.log(np.stack([sums[m].mean(axis=0) for m in families], axis=1) + 1e-6).astype(np.float32)
    pairs, weights, biases, slopes, unit = [], [], [], [], _unit(x)
    for members in families:
        for a, i in enumerate(members):
            for j in members[a + 1 :]:
                own = (number == i) | (number == j)
                y = np.where(number[own] == i, 1.0, -1.0)
                w, b = support_vectors(unit[own], y)
                pairs.append((i, j))
                weights.append(w)
                biases.append(b)
                slopes.append(_slope(unit[own] @ w + b, y))
    return Model(languages, families, logs, pairs, np.array(weights, np.float32).reshape(-1, DIM).T, np.array(biases), np.array(slopes))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, lang, x): the rows' trigram counts, most of them 0, as compressed bytes."""
    for whole in batches:
        for batch in slices(whole, "text", rows=ROWS):
            x, _ = counts(batch.column("text"))
            columns = [batch.column("doc_id"), batch.column("lang"), pa.array([zlib.compress(r.tobytes(), 1) for r in x], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "x"])


def train(docs: DataFrame, keep: Column, per_language: int = PER_LANGUAGE, most: int = MOST_ROWS) -> Model | None:
    """A model of docs (doc_id, text, lang) where keep holds and neither text nor lang is null; None if there is no row. Of
    more than `most` languages (and of more than per_language rows of one) a bounded sample is learned from, so the rarest
    languages may stay unlearned."""
    known = keep & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
    rows = docs.where(known).select("doc_id", "text", "lang")
    ids = smallest_hashes(rows.select("doc_id", "lang").distinct(), "lang", per_language)
    taken = ids.orderBy("_n", "lang").limit(most).select("doc_id", "lang")
    sample = rows.join(F.broadcast(taken), ["doc_id", "lang"])  # at most `most` rows
    found = sample.select("doc_id", "lang", "text").mapInArrow(_featured, "doc_id long, lang string, x binary").limit(2 * most).collect()
    found = sorted(((r.lang, r.doc_id, bytes(r.x)) for r in found))
    if not found:
        return None
    x = np.empty((len(found), DIM), np.float32)
    for row, (_, _, data) in zip(x, found, strict=True):
        row[:] = np.frombuffer(zlib.decompress(data), np.float32)
    return fit(x, np.array([lang for lang, _, _ in found], object))


def judge(texts: pa.Array, model: Model | None) -> tuple[list[str], np.ndarray]:
    """Each text's language and score."""
    x, letters = counts(texts)
    if model is None:
        return [UNDEFINED] * len(x), np.zeros(len(x))
    number, score = model.predict(x)
    return [model.languages[n] if ok else UNDEFINED for n, ok in zip(number, letters, strict=True)], np.where(letters, score, 0.0)


def predicted(docs: DataFrame, model: Model | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with language and score, called `names`, behind its columns (text string is read)."""
    out = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", rows=ROWS):
                lang, score = judge(batch.column("text"), model)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], out.names)

    return docs.mapInArrow(run, out)


def known(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, with their columns whatever their names, whose language is a learned one: null and empty texts and
    those without a letter go, and all where nothing was learned."""
    names = fresh(docs.columns, "lang_pred", "score")
    return predicted(docs, model, tuple(names)).where(F.col(f"`{names[0]}`") != UNDEFINED).drop(*names)


def identified(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs (doc_id long, text string, lang string; others are left).

    Learned from rows that are not held out (crc32 of the id modulo 4 is 2). lang_pred is und, with score 0, where text is
    null or has no letter, and everywhere if there is nothing to learn from. A null doc_id is held out. Repeated rows stay.
    """
    held = F.coalesce(crc_of_id() % 4 == 2, F.lit(True)) if held_out is None else held_out
    model = train(docs, ~held)
    return predicted(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
