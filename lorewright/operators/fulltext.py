"""Positional full-text indexes and their BM25: ASCII words, segmented Chinese words, and character trigrams.

An index is rows (index, term, id, field, positions), one a term and field of an entry. A phrase's occurrences are found by
positions alone: its rarest term's fields are the candidates, the other terms' postings are kept for these, and starts are
the intersection of the terms' positions, each moved back by its place. A substring of three characters or more is a
phrase of trigrams. No query reads a text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewright.functions import segment
from lorewright.plans.lineage import stored

#: Fields of each index, and their weights as they take effect (fixed values).
WEIGHTS = {
    "en": {"title": 2.0, "aliases": 2.0, "search_terms": 1.0, "body": 1.0},
    "cn": {"title": 2.0, "aliases": 2.0, "search_terms": 1.5, "tags": 1.0, "body": 1.0},
    "tri": {"title": 1.5, "aliases": 1.5, "search_terms": 1.0, "body": 1.0},
}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: ASCII letters, digits and the signs that stay within words (fixed values).
WORD = re.compile(r"[0-9A-Za-z+\-./#$%^&*_=]+")
#: Fields whose postings a worker holds at once.
ROWS = 256
POSTINGS = "index string, term string, id string, field string, positions array<int>"
SIZES = "index string, id string, length long"
TOTALS = "index string, docs long, tokens long"
VOCABULARY = "index string, term string, fields long"


class Index(NamedTuple):
    """Postings, lengths of entries, totals (entries, tokens) by index, the fields that hold each term where that is kept (it
    chooses a phrase's rarest term), and the segmenter's dictionary."""

    postings: DataFrame
    sizes: DataFrame
    totals: dict[str, tuple[int, int]]
    vocabulary: DataFrame | None
    known: segment.Dictionary


def en_tokens(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def trigrams(text: str) -> list[str]:
    low = text.lower()
    return [low[i : i + 3] for i in range(len(low) - 2)]


def texts(entries: DataFrame) -> DataFrame:
    """(id, field, text), one row a field."""
    joined = lambda c: F.array_join(c, " ")
    parts = {"title": F.col("title"), "aliases": joined("aliases"), "search_terms": joined("search_terms"), "tags": joined("tags"), "body": F.col("body")}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.coalesce(v, F.lit("")).alias("text")) for k, v in parts.items()])).alias("f")
    return entries.select("id", each).select("id", "f.field", "f.text")


def _placed(rows: Iterator[tuple[str, str, str, list[str]]]) -> pd.DataFrame:
    out: list[tuple[str, str, str, str, list[int]]] = []
    for index, key, field, tokens in rows:
        found: dict[str, list[int]] = {}
        for i, t in enumerate(tokens):
            found.setdefault(t, []).append(i)
        out += [(index, t, key, field, places) for t, places in found.items()]
    return pd.DataFrame(out, columns=["index", "term", "id", "field", "positions"])


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for a in range(0, len(frame), ROWS):
            yield frame.iloc[a : a + ROWS]


def _letters(which: list[str]):
    cuts = [(w, {"en": en_tokens, "tri": trigrams}[w]) for w in which]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _pieces(frames):
            rows = list(zip(frame["id"], frame["field"], frame["text"], strict=True))
            yield _placed((index, i, f, cut(t)) for i, f, t in rows for index, cut in cuts if f in WEIGHTS[index])

    return run


def _segmented(cut: Callable[[str], list[str]]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _pieces(frames):
            yield _placed(("cn", i, f, cut(t)) for i, f, t in zip(frame["id"], frame["field"], frame["text"], strict=True))

    return run


def _words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in _pieces(frames):
        yield _placed(("cn", i, f, t) for i, f, t in zip(frame["id"], frame["field"], frame["tokens"], strict=True))


def postings(entries: DataFrame, known: segment.Dictionary, which: Iterable[str] = tuple(WEIGHTS)) -> DataFrame:
    """The indexes' postings; a field's go from its own text, so nothing is shuffled."""
    rows, letters = texts(entries), [w for w in which if w != "cn"]
    legs = [rows.mapInPandas(_letters(letters), POSTINGS)] if letters else []
    cut = segment.cutter(known) if "cn" in which else None
    if cut:
        legs.append(rows.mapInPandas(_segmented(cut), POSTINGS))
    elif "cn" in which:
        words = segment.tokenised(rows.select(F.struct("id", "field").alias("key"), "text"), known)
        legs.append(words.select("key.*", "tokens").mapInPandas(_words, POSTINGS))
    return reduce(DataFrame.unionAll, legs)


def _places(tokens: list[str], terms: set[str]) -> dict[str, list[int]]:
    found: dict[str, list[int]] = {}
    for i, t in enumerate(tokens):
        if t in terms:
            found.setdefault(t, []).append(i)
    return found


def _answers(index: str, text: str, terms: set[str], cut: Callable[[str], list[str]] | None) -> tuple[int, dict[str, list[int]]]:
    """How many tokens a text has, and where the terms are among them. A term stands in the lower-cased text, else it is no token."""
    low = text.lower()
    if index == "tri":
        return max(len(low) - 2, 0), {t: [m.start() for m in re.finditer(f"(?={re.escape(t)})", low)] for t in terms if t in low}
    said = any(t in low for t in terms)
    if index == "en":
        return len(WORD.findall(text)), _places(en_tokens(text), terms) if said else {}
    return segment.count(text, cut), _places(cut(text), terms) if said else {}


def answering(entries: DataFrame, asked: dict[str, set[str]], cut: Callable[[str], list[str]] | None) -> DataFrame:
    """The postings of the asked terms alone, of all entries, and beside them a row a field of null term with the field's length."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _pieces(frames):
            out: list[tuple] = []
            for key, field, text in zip(frame["id"], frame["field"], frame["text"], strict=True):
                for index, terms in asked.items():
                    if field in WEIGHTS[index]:
                        length, found = _answers(index, text, terms, cut)
                        out += [(index, t, key, field, places, 0) for t, places in found.items()]
                        if length:
                            out.append((index, None, key, field, [], length))
            yield pd.DataFrame(out, columns=["index", "term", "id", "field", "positions", "length"])

    return texts(entries).mapInPandas(run, POSTINGS + ", length long")


def sizes(rows: DataFrame) -> DataFrame:
    """(index, id, length): tokens of all fields."""
    return rows.groupBy("index", "id").agg(F.sum(F.size("positions")).alias("length"))


def totals(lengths: DataFrame, docs: int) -> dict[str, tuple[int, int]]:
    return {k: (docs, 0) for k in WEIGHTS} | {r["index"]: (docs, r.tokens) for r in lengths.groupBy("index").agg(F.sum("length").alias("tokens")).collect()}


def vocabulary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("index", "term").agg(F.count("*").alias("fields"))


def phrase_hits(index: Index, which: str, terms: list[str]) -> DataFrame:
    """(id, field, n): how often each field holds the terms one behind the other."""
    own = index.postings.where(F.col("index") == which)
    distinct = sorted(set(terms))
    if len(distinct) == 1 and len(terms) == 1:
        return own.where(F.col("term") == terms[0]).select("id", "field", F.size("positions").alias("n"))
    hits = own.where(F.col("term").isin(*distinct)).select("term", "id", "field", "positions")
    if index.vocabulary is not None and len(distinct) > 1:
        known = {r.term: r.fields for r in index.vocabulary.where((F.col("index") == which) & F.col("term").isin(*distinct)).collect()}  # a row a term of the query
        rarest = min(distinct, key=lambda t: (known.get(t, 0), t))
        candidates = own.where(F.col("term") == rarest).select("id", "field")
        others = own.where(F.col("term").isin(*[t for t in distinct if t != rarest])).select("term", "id", "field", "positions")
        hits = own.where(F.col("term") == rarest).select("term", "id", "field", "positions").unionByName(others.join(candidates, ["id", "field"], "left_semi"))
    met = hits.groupBy("id", "field").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at")).where(F.size("at") == len(distinct))
    return met.select("id", "field", F.size(_starts(F.col("at"), terms)).alias("n")).where("n > 0")


def _starts(at: Column, terms: list[str]) -> Column:
    """Positions from which the terms follow each other."""
    found = at[terms[0]]
    for place, term in enumerate(terms[1:], 1):
        found = F.array_intersect(found, _back(at[term], place))
    return found


def _back(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def bm25(index: Index, which: str, phrases: list[list[str]], limit: int | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """(id, score) of the entries that hold every phrase, the best `limit` by score and id (None: all). A phrase without terms
    matches nothing, as does a query without phrases."""
    spark = index.postings.sparkSession
    if not phrases or not all(phrases):
        return spark.createDataFrame([], "id string, score double")
    weight = F.coalesce(*[F.when(F.col("field") == k, v) for k, v in (weights or WEIGHTS[which]).items()], F.lit(1.0))
    legs = [phrase_hits(index, which, p).groupBy("id").agg(F.sum(weight * F.col("n")).alias("f")).withColumn("phrase", F.lit(i)) for i, p in enumerate(phrases)]
    hits = legs[0]
    for leg in legs[1:]:
        hits = hits.unionAll(leg)
    docs, tokens = index.totals[which]
    average = tokens / docs if docs and tokens else 1.0
    counts = hits.groupBy("phrase").agg(F.count("*").alias("holding"))  # a row a phrase
    idf = F.log((F.lit(docs) - F.col("holding") + 0.5) / (F.col("holding") + 0.5))
    counts = F.broadcast(counts.select("phrase", F.when(idf <= 0, LEAST_IDF).otherwise(idf).alias("idf")))
    own = index.sizes.where(F.col("index") == which).select("id", "length")
    norm = F.col("f") + K1 * (1 - B + B * F.col("length") / F.lit(float(average)))
    scored = hits.join(counts, "phrase").join(own, "id").groupBy("id").agg(F.sum(F.col("idf") * F.col("f") * (K1 + 1) / norm).alias("score"), F.count("*").alias("phrases"))
    scored = scored.where(F.col("phrases") == len(phrases)).select("id", "score")
    return scored if limit is None else scored.orderBy(F.desc("score"), "id").limit(limit)


def en_phrases(text: str) -> list[list[str]]:
    """The phrases of a segment: one a part between spaces, of the words that signs outside of WORD split it into."""
    return [en_tokens(part) for part in "".join(c if c.isascii() else " " for c in text).split()]


def cn_phrases(index: Index, text: str) -> list[list[str]]:
    return [[t] for t in segment.tokens(text, index.known.among(text), index.known.total, index.known.longest)]


def search_en(index: Index, text: str, limit: int | None = None) -> DataFrame:
    return bm25(index, "en", en_phrases(text), limit)


def search_cn(index: Index, text: str, limit: int | None = None) -> DataFrame:
    return bm25(index, "cn", cn_phrases(index, text), limit)


def search_tri(index: Index, text: str, limit: int | None = None) -> DataFrame:
    """Entries that hold the text, of three characters at least, whatever its case."""
    return bm25(index, "tri", [trigrams(text)], limit)


def occurrences(index: Index, text: str) -> DataFrame:
    """(id, score): how often an entry's fields hold a text of three characters or more, whatever its case."""
    return phrase_hits(index, "tri", trigrams(text)).groupBy("id").agg(F.sum("n").alias("score"))


def _asked(known: segment.Dictionary, which: Iterable[str], queries: Iterable[str]) -> dict[str, set[str]]:
    """The terms of queries in each index."""
    cut = {"en": lambda q: [t for p in en_phrases(q) for t in p], "tri": trigrams, "cn": lambda q: segment.tokens(q, known.among(q), known.total, known.longest)}
    return {w: {t for q in queries for t in cut[w](q)} for w in which}


def built(entries: DataFrame, more: DataFrame | None = None, which: Iterable[str] = tuple(WEIGHTS), queries: Iterable[str] | None = None) -> Index:
    """An index for this run alone, of those kinds that it asks; the postings are worked out once and kept as a table in
    spark.checkpoint.dir, of which a query reads the terms that it asks. With the texts of the run's queries, of all entries' fields only
    these texts' terms are posted, as no other is asked, and every field is counted."""
    known = segment.dictionary(entries, more) if "cn" in which else segment.Dictionary(entries.select("id"), 0, 0, 1)
    cut = segment.cutter(known) if queries is not None and "cn" in which else None
    if queries is not None and (cut or "cn" not in which):
        rows = stored(answering(entries, _asked(known, which, queries), cut))
        lengths = stored(rows.where("term is null").groupBy("index", "id").agg(F.sum("length").alias("length")))
        rows = rows.where("term is not null").drop("length")
    else:
        rows = stored(postings(entries, known, which))
        lengths = stored(sizes(rows))
    return Index(rows, lengths, totals(lengths, entries.count()), None, known)
