"""Toxicity by a counterfactual-regularised logistic model.

Features of a text are the distinct hashes of its words and of their first 4, 5 and 6 bytes, wherever they stand, so a text of
any length is judged whole. The loss is that of labels, a lasso term that keeps few features, and a penalty on score changes.
Counterfactual pairs are of two kinds. Every sentence of the labelled texts that names an identity is paired with itself, the
term swapped for another of its group. And every labelled text that names none gets a mention put into it, each term of the
IDENTITIES in turn, and is paired with itself with the term swapped, and with itself as it was where it is no toxic text; so
the model is held to mentions of groups whether or not the labelled texts hold any. As scores are sums over features, a pair
acts by what only one side has; equal differences are one pair with a count, so their number doesn't grow with the texts.

Training takes at most PER_CLASS labelled rows of each label; feature counts are summed on the executors and only features that
pass the screen come to the driver. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewright.llm.kernel import NON_ALNUM, buffers, slices, words
from lorewright.llm.shared import crc_of_id, drop, fresh, labelled_sample, written

BITS, PREFIXES = 20, (4, 5, 6)
#: The bound of the labelled sample, and of distinct counterfactual differences (the most frequent count).
PER_CLASS, MOST_PAIRS = 3000, 50_000
#: Features whose shares of the two labels' texts are fewer standard errors apart are left out, and all but SCREENED of the others.
LEAST_APART, SCREENED = 5.0, 4000
#: What the toxic texts weigh in the fit.
TOXIC_SHARE = 0.4
#: The bias of a model that learned from no row: every text scores below 0.5.
UNTRAINED = -1.0
#: COUNTERFACTUAL weighs the mean squared change of log-odds over all pairs, of which one term has a share of about a hundredth.
ROUNDS, LASSO, COUNTERFACTUAL = 300, 1e-4, 50.0
#: Groups of identity terms; a term is swapped for the next of its group.
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("gay", "straight"), ("lesbian", "heterosexual"),
    ("transgender", "cisgender"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("black", "white", "asian", "latino", "arab"),
    ("immigrant", "native"), ("immigrants", "natives"), ("disabled", "blind", "deaf"), ("old", "young"),
    ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden"), ("ausländer", "einheimische"), ("schwule", "heterosexuelle"),
    ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs"), ("étrangers", "français"), ("noirs", "blancs"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos"), ("extranjeros", "españoles"), ("negros", "blancos"),
)
TERMS = tuple(t for group in IDENTITIES for t in group)


def features(texts: pa.Array) -> list[np.ndarray]:
    """For each row its distinct feature numbers, ascending."""
    raw, at = buffers(pc.utf8_lower(texts))
    parts = []
    for n in (0, *PREFIXES):
        h, before, length = words(raw, at, NON_ALNUM, lower=False, prefix=n)
        own = length > n if n else np.ones(len(h), bool)
        kept = np.concatenate([[0], np.cumsum(own)])[before]
        parts.append(((h[own] ^ np.uint64(n * 0x9E3779B9)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS), kept))
    return [np.unique(np.concatenate([h[k[i] : k[i + 1]] for h, k in parts])).astype(np.int32) for i in range(len(texts))]


@functools.lru_cache(maxsize=8)
def _named(groups: tuple) -> tuple[re.Pattern, dict[str, str]]:
    after = {t: g[(i + 1) % len(g)] for g in groups for i, t in enumerate(g)}
    return re.compile(r"\b(" + "|".join(sorted(after, key=len, reverse=True)) + r")\b", re.IGNORECASE), after


def counterfactuals(text: str, groups: tuple = IDENTITIES) -> Iterator[tuple[str, str]]:
    """Sentences that name an identity, each with its terms swapped."""
    named, after = _named(groups)
    for sentence in re.split(r"[.!?\n]+", text):
        if named.search(sentence):
            yield sentence, named.sub(lambda m: after[m[0].lower()], sentence)


def _difference(a: np.ndarray, b: np.ndarray) -> tuple[bytes, bytes]:
    return np.setdiff1d(a, b).astype(np.int32).tobytes(), np.setdiff1d(b, a).astype(np.int32).tobytes()


@functools.lru_cache(maxsize=8)
def _mentions(groups: tuple) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Each term's features and those of the term that it is swapped for; and all of them."""
    after = _named(groups)[1]
    pairs = [tuple(features(pa.array([t, after[t]]))) for t in dict.fromkeys(t for g in groups for t in g)]
    return pairs, np.unique(np.concatenate([x for pair in pairs for x in pair]))


def _inserted(own: np.ndarray, toxic: int, groups: tuple) -> Counter:
    """The differences of a text's pairs with mentions put into it; own: those of its features that mentions have too."""
    out: Counter = Counter()
    for one, other in _mentions(groups)[0]:
        with_one = np.union1d(own, one)
        out[_difference(with_one, np.union1d(own, other))] += 1
        if not toxic:
            out[_difference(with_one, own)] += 1
    return out


def differences(text: str, own: np.ndarray, toxic: int, groups: tuple = IDENTITIES) -> Counter:
    """What only one side of each of the text's counterfactual pairs has (features as bytes), counted. own: its features."""
    out: Counter = Counter()
    swapped = list(counterfactuals(text, groups)) if groups else []
    for a in range(0, len(swapped), 256):
        both = features(pa.array([x for pair in swapped[a : a + 256] for x in pair]))
        out.update(_difference(both[k], both[k + 1]) for k in range(0, len(both), 2))
    if not swapped and groups:
        out.update(_inserted_once(np.intersect1d(own, _mentions(groups)[1]).tobytes(), toxic, groups))
    return out


@functools.lru_cache(maxsize=4096)
def _inserted_once(own: bytes, toxic: int, groups: tuple) -> Counter:
    return _inserted(np.frombuffer(own, np.int32), toxic, groups)


@dataclass
class Model:
    weights: np.ndarray  # (2 ** BITS,) float32, few of them not 0
    bias: float

    def __getstate__(self) -> tuple:
        """What goes with a plan: the weights that are not 0."""
        live = np.flatnonzero(self.weights).astype(np.int32)
        return len(self.weights), live, self.weights[live], self.bias

    def __setstate__(self, state: tuple) -> None:
        size, live, own, self.bias = state
        self.weights = np.zeros(size, np.float32)
        self.weights[live] = own

    def score(self, texts: pa.Array) -> np.ndarray:
        live = self.weights != 0
        raw, at = buffers(pc.utf8_lower(texts))
        sums = np.full(len(texts), self.bias)
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        for n in (0, *PREFIXES):
            h, before, length = words(raw, at, NON_ALNUM, lower=False, prefix=n)
            f = ((h ^ np.uint64(n * 0x9E3779B9)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)
            keep = np.flatnonzero(live[f] & (length > n))
            hits.append((np.searchsorted(before, keep, side="right") - 1, f[keep]))
        pairs = np.unique(np.concatenate([(r.astype(np.int64) << BITS) | f for r, f in hits]))
        np.add.at(sums, pairs >> BITS, self.weights[pairs & ((1 << BITS) - 1)])
        return 1 / (1 + np.exp(-np.clip(sums, -30, 30)))


def _apart(pos: np.ndarray, neg: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """How many standard errors the shares of the two labels' texts that have a feature are apart."""
    mean = (pos + neg + 1) / (n1 + n0 + 2)
    return np.abs(pos / n1 - neg / n0) / np.sqrt(mean * (1 - mean) * (1 / n1 + 1 / n0))


def _table(rows: list[np.ndarray], column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and kept columns of the rows' features; column is -1 for those left out."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = column[np.concatenate(rows)] if len(row) else np.zeros(0, np.int64)
    return row[at >= 0], at[at >= 0]


def solve(rows: list[np.ndarray], y: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], counts: np.ndarray, kept: np.ndarray, strength: float) -> Model:
    """Proximal gradient steps with momentum over the kept features of texts, labels (0 or 1) and counted counterfactual
    pairs."""
    size = 1 << BITS
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    column = np.full(size, -1)
    column[kept] = np.arange(len(kept))
    r, c = _table(rows, column)
    (ra, ca), (rb, cb) = _table([a for a, _ in pairs], column), _table([b for _, b in pairs], column)
    share = np.where(y == 1, TOXIC_SHARE / n1, (1 - TOXIC_SHARE) / n0)
    n, each = len(kept), strength * counts / max(1, counts.sum())

    def look(w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
        """Loss without the lasso term, and its gradient."""
        s = b + np.bincount(r, weights=w[c], minlength=len(y))
        d = np.bincount(ra, weights=w[ca], minlength=len(pairs)) - np.bincount(rb, weights=w[cb], minlength=len(pairs))
        e = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y) * share
        pull = np.bincount(ca, weights=(each * d)[ra], minlength=n) - np.bincount(cb, weights=(each * d)[rb], minlength=n)
        loss = float((share * (np.logaddexp(0, s) - y * s)).sum() + (each * d**2).sum())
        return loss, np.bincount(c, weights=e[r], minlength=n) + 2 * pull, float(e.sum())

    bend = np.bincount(ca, weights=each[ra], minlength=n) + np.bincount(cb, weights=each[rb], minlength=n)
    curve = 0.25 * np.bincount(c, weights=share[r], minlength=n) + 2 * bend + 1e-4
    scale, w, b, v, u, since, held = 4.0, np.zeros(n), 0.0, np.zeros(n), 0.0, 0, np.inf
    for _ in range(ROUNDS):
        _, g, gb = look(v, u)
        own = scale * curve
        stepped = v - g / own
        new, new_b = np.sign(stepped) * np.maximum(0, np.abs(stepped) - LASSO / own), u - gb / (0.25 * scale)
        now = look(new, new_b)[0] + LASSO * np.abs(new).sum()
        if now > held + 1e-12:  # too long a step: start again from the last good point with shorter ones
            scale, since, v, u = scale * 2, 0, w, b
            continue
        m = since / (since + 3)
        v, u, since, held = new + m * (new - w), new_b + m * (new_b - b), since + 1, now
        w, b = new, new_b
    weights = np.zeros(size, np.float32)
    weights[kept] = w
    return Model(weights, float(b))


def fit(rows: list[np.ndarray], y: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], strength: float = COUNTERFACTUAL) -> Model:
    """A model of texts' features, labels and pairs, the features screened here."""
    size = 1 << BITS
    if not len(y):
        return Model(np.zeros(size, np.float32), UNTRAINED)
    flat, label = np.concatenate(rows), np.repeat(y, [len(r) for r in rows])
    pos, neg = np.bincount(flat[label == 1], minlength=size), np.bincount(flat[label == 0], minlength=size)
    apart = _apart(pos, neg, max(1, int(y.sum())), max(1, int((1 - y).sum())))
    kept = np.sort(np.argsort(-apart, kind="stable")[: min(SCREENED, int((apart >= LEAST_APART).sum()))])
    return solve(rows, y, pairs, np.ones(len(pairs)), kept, strength)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of the task's texts of either label have each feature."""
    found = np.zeros((2, 1 << BITS), np.int64)
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            for label, own in zip(batch.column("label").to_pylist(), features(batch.column("text")), strict=True):
                found[label, own] += 1
    own = np.flatnonzero(found.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(found[1, own]), pa.array(found[0, own])], ["feature", "pos", "neg"])


def train(docs: DataFrame, labels: DataFrame, keep: Column, per_class: int = PER_CLASS, strength: float = COUNTERFACTUAL, groups: tuple = IDENTITIES) -> Model:
    """A model of docs (doc_id, text) by labels (doc_id, toxic) where keep holds; without rows of both labels its scores are
    those of no feature, and without any usable row below 0.5, so nothing is called toxic. Labels other than 0 and 1 take no
    part."""
    taken = F.broadcast(labelled_sample(labels, "toxic", keep, per_class))  # two labels: at most 2 * per_class rows
    sample = docs.select("doc_id", "text").where("text is not null").join(taken, "doc_id")
    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model(np.zeros(1 << BITS, np.float32), UNTRAINED)
    n1, n0 = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    sums = sample.mapInArrow(_counted, "feature int, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    mean = (F.col("pos") + F.col("neg") + 1) / (n1 + n0 + 2)
    apart = F.abs(F.col("pos") / n1 - F.col("neg") / n0) / F.sqrt(mean * (1 - mean) * (1 / n1 + 1 / n0))
    best = sums.withColumn("apart", apart).where(F.col("apart") >= LEAST_APART).orderBy(F.desc("apart"), "feature").limit(SCREENED).collect()
    mentions = features(pa.array([t for g in groups for t in g], pa.string()))
    kept = np.unique(np.concatenate([np.array([r.feature for r in best], np.int32), *mentions])).astype(np.int64)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kept features of the texts (kind 0) and of what is on one side only of their pairs (kind 1), by place."""
        place = np.full(1 << BITS, -1, np.int32)
        place[kept] = np.arange(len(kept))
        of = lambda data: np.sort(place[np.frombuffer(data, np.int32)])
        short = lambda x: x[x >= 0].astype(np.uint16).tobytes()
        for whole in batches:
            pairs: Counter = Counter()
            for batch in slices(whole, "text", 1 << 20):
                ids, label, texts = (batch.column(c).to_pylist() for c in ("doc_id", "label", "text"))
                own = features(batch.column("text"))
                for y, text, f in zip(label, texts, own, strict=True):
                    for (a, b), n in differences(text, f, y, groups).items():
                        pairs[short(of(a)), short(of(b))] += n
                rows = [(0, i, y, short(np.sort(place[f])), b"", 1) for i, y, f in zip(ids, label, own, strict=True)]
                yield _record(rows)
            yield _record([(1, None, None, a, b, n) for (a, b), n in pairs.items()])

    found = written(sample.mapInArrow(seen, "kind int, doc_id long, label int, a binary, b binary, n long"), "seen")  # read twice
    numbers = lambda data: kept[np.frombuffer(data, np.uint16)]
    texts = sorted(((r.doc_id, r.label, bytes(r.a)) for r in found.where("kind = 0").select("doc_id", "label", "a").collect()))
    pairs = found.where("kind = 1").groupBy("a", "b").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a", "b").limit(MOST_PAIRS).collect()
    drop(found)
    return solve([numbers(a) for _, _, a in texts], np.array([y for _, y, _ in texts]), [(numbers(r.a), numbers(r.b)) for r in pairs], np.array([float(r.n) for r in pairs]), kept, strength)


def _record(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["kind", "doc_id", "label", "a", "b", "n"])


def scored(docs: DataFrame, model: Model, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with score and predicted, called `names`, behind its columns (text string is read)."""
    out = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                score = model.score(batch.column("text"))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], out.names)

    return docs.mapInArrow(run, out)


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with their columns whatever their names, that score below 0.5. Null and empty texts have the score
    of no feature."""
    names = fresh(docs.columns, "score", "predicted")
    return scored(docs, model, tuple(names)).where(F.col(f"`{names[1]}`") == 0).drop(*names)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id long, text string; other columns are left).

    Learned from labels (doc_id, toxic) of rows that are not held out (crc32 of the id modulo 5 is 0). A null or empty text
    has the score of no feature; a null doc_id is held out. Repeated rows stay; an empty table gives no rows.
    """
    held = F.coalesce(crc_of_id() % 5 == 0, F.lit(True))
    model = train(docs, labels, ~held)
    return scored(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
