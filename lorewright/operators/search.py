"""Retrieval by routes: exact matches, BM25 over positional indexes, graph neighbours, vectors, fusion and ranking.

Where exact matches remain after the filters, they are the answer. Else BM25's routes are summed, graph neighbours of what
is left of them join where that route is asked for, and vector hits add to the scores. Each index's hits are cut before
filters, as ranked retrieval defines it, so fewer than `limit` rows may come back; exact hits never are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.functions.text import ascii_lower, cosine, snippet
from lorewright.operators import filters, fulltext
from lorewright.operators.query import Segment, expand_mixed, parse_query, symbol_variants
from lorewright.plans.lineage import cut

AUTHORITY_WEIGHT = 0.3
PARTIAL = 0.7
#: A segment's routes and their weights by its type (fixed values); exact+ also finds parts of titles.
ROUTES = {
    "cjk": (("cn", 1.0), ("tri", 0.5)),
    "fullwidth": (("cn", 1.0),),
    "ascii_word": (("en", 1.0),),
    "ascii_short": (("exact+", 2.0), ("en", 1.0)),
    "symbol": (("exact", 2.0), ("en", 1.0), ("variants", 0.8)),
    "mixed": (("exact", 2.0), ("en", 1.0), ("tri", 0.5)),
    "version": (("exact", 2.0), ("en", 1.0), ("tri", 0.5)),
    "number": (("exact", 2.0), ("en", 1.0)),
}
HITS = "id string, score double, backends array<string>"


def exact(entries: DataFrame, term: str, title_substring: bool = False, ids: bool = False) -> DataFrame:
    """(id, score): title 80, alias 90, term 75, tag 70, title substring 55, and with ids the id itself 1000; the best counts."""
    term = unicodedata.normalize("NFC", term).strip()
    low = ascii_lower(F.lit(term))
    holds = lambda c: F.exists(c, lambda x: ascii_lower(x) == low)
    tests = [(ids and F.col("id") == term, 1000.0), (holds("aliases"), 90.0), (ascii_lower(F.col("title")) == low, 80.0), (holds("search_terms"), 75.0), (holds("tags"), 70.0)]
    if title_substring:
        tests.append((F.contains(ascii_lower(F.col("title")), low), 55.0))
    score = F.coalesce(*[F.when(c, F.lit(s)) for c, s in tests if c is not False])
    return entries.select("id", score.alias("score")).where("score is not null")


def expand(edges: DataFrame, entries: DataFrame, seeds: DataFrame, factor: float = 0.5, archived: bool = False) -> DataFrame:
    """(id, score) of active neighbours (archived ones too, if asked) of seeds (id, score), seeds left out: factor times the best
    seed's score."""
    both = edges.select(F.col("source_id").alias("seed"), F.col("target_id").alias("id")).unionAll(edges.select(F.col("target_id").alias("seed"), F.col("source_id").alias("id")))
    near = both.join(seeds.select(F.col("id").alias("seed"), "score"), "seed").join(seeds.select("id"), "id", "left_anti")
    return near.join(entries.where(F.lit(archived) | (F.col("status") != "archived")).select("id"), "id", "left_semi").groupBy("id").agg((F.max("score") * factor).alias("score"))


def nearest(vectors: DataFrame, query: list[float], limit: int, weight: float = 1.5) -> DataFrame:
    """(id, score) of vectors (id, embedding): positive cosine times weight, the best by score and id."""
    score = cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])) * weight
    return vectors.select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def boost(results: DataFrame, authority: DataFrame, weight: float = AUTHORITY_WEIGHT) -> DataFrame:
    """(id, score): score * (1 + weight * authority / the results' largest)."""
    met = results.join(authority.select("id", "authority"), "id", "left").withColumn("authority", F.coalesce("authority", F.lit(0.0)))
    top = F.broadcast(met.agg(F.max("authority").alias("top")))  # one row
    return met.join(top, F.lit(True)).select("id", F.when(F.col("top") > 0, F.col("score") * (1 + weight * F.col("authority") / F.col("top"))).otherwise(F.col("score")).alias("score"))


def rrf(lists: DataFrame, k: int = 60) -> DataFrame:
    """(id, score): sum of 1 / (k + place) over lists (route, place from 1, id)."""
    return lists.groupBy("id").agg(F.sum(1 / (F.lit(k) + F.col("place"))).alias("score"))


def fused(entries: DataFrame, index: fulltext.Index, segments: list[Segment], limit: int | None) -> DataFrame:
    """(id, score, backends): each segment's routes by its type, each index's hits cut to `limit`; entries that miss a segment
    count PARTIAL. Symbols' variants are searched as words."""
    legs: list[DataFrame] = []

    def leg(hits: DataFrame, n: int, weight: float, backend: str) -> None:
        legs.append(hits.select("id", F.lit(n).alias("segment"), (F.col("score") * weight).alias("score"), F.lit(len(legs)).alias("leg"), F.lit(backend).alias("backend")))

    find = {"en": fulltext.search_en, "cn": fulltext.search_cn, "tri": fulltext.search_tri}
    for n, s in enumerate(segments):
        for route, weight in ROUTES[s.type]:
            if route in find:
                leg(find[route](index, s.text, limit), n, weight, f"fts_{route}")
            elif route == "variants":
                for v in symbol_variants(s.text):
                    leg(fulltext.search_en(index, v, limit), n, weight, "fts_en")
            else:
                leg(exact(entries, s.text, route == "exact+"), n, weight, "exact")
    if not legs:
        return entries.sparkSession.createDataFrame([], HITS)
    sums = reduce(DataFrame.unionAll, legs).groupBy("id").agg(F.sum("score").alias("score"), F.countDistinct("segment").alias("hits"), F.array_sort(F.collect_set(F.struct("leg", "backend"))).alias("met"))
    score = F.when(F.col("hits") < len(segments), F.col("score") * PARTIAL).otherwise(F.col("score"))
    return sums.select("id", score.alias("score"), F.array_distinct(F.col("met.backend")).alias("backends"))


def indexes_of(segments: list[Segment]) -> list[str]:
    """The full-text indexes that the segments' routes ask."""
    asked = {"en" if route == "variants" else route for s in segments for route, _ in ROUTES[s.type]}
    return [k for k in fulltext.WEIGHTS if k in asked]


def search(
    entries: DataFrame, edges: DataFrame, authority: DataFrame, query: str, kinds: list[str] | None = None, where: dict[str, object] | None = None, backends: list[str] | None = None,
    limit: int = 20, expand_graph: bool = True, archived: bool = False, index: fulltext.Index | None = None, dense: Callable[[str, int], DataFrame] | None = None,
) -> DataFrame:
    """(id, score, backends, snippet), best first.

    backends: of exact, bm25, graph and dense; exact and bm25, and dense where it is there, if none are given. graph counts
    only where it is listed and expand_graph holds. index: the kept indexes; else those that the query asks are built for it.
    dense gives (id, score) for a text and a number of hits; it is None without an embedder or without vectors. kinds, where
    (attributes) and, unless archived, the status filter each route's hits."""
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFC", query).strip())
    segments = parse_query(text)
    routes = list(dict.fromkeys(backends or ["exact", "bm25", *(["dense"] if dense else [])]))
    allowed = entries.where(F.lit(archived) | (F.col("status") != "archived"))
    allowed = filters.matching(allowed.where(F.col("kind").isin(*kinds)) if kinds else allowed, where or {}).select("id")
    named = lambda hits, backend: hits.select("id", "score", F.array(F.lit(backend)).alias("backends"))
    kept = lambda hits: cut(hits.join(allowed, "id", "left_semi"))
    ranked = lambda hits: _ranked(entries, authority, hits, [s.text for s in segments if s.type != "emoji"], limit)
    found = entries.sparkSession.createDataFrame([], HITS)
    if not segments:
        return ranked(found)
    if "exact" in routes:
        hits = kept(named(exact(entries, text, ids=True), "exact"))
        if not hits.isEmpty():
            return ranked(hits)
    most = max(5 * limit, 20)
    if "bm25" in routes:
        meant = expand_mixed([s for s in segments if s.type != "emoji"])
        asked = [v for s in meant for v in (s.text, *symbol_variants(s.text))]
        found = kept(fused(entries, fulltext.built(entries, which=indexes_of(meant), queries=asked) if index is None and meant else index, meant, most))
        if "graph" in routes and expand_graph:
            found = found.unionByName(kept(named(expand(edges, entries, found, archived=archived), "graph")))
    if "dense" in routes and dense:
        near = kept(named(dense(text, most), "dense"))
        both = found.withColumn("leg", F.lit(0)).unionByName(near.withColumn("leg", F.lit(1)))
        both = both.groupBy("id").agg(F.sum("score").alias("score"), F.array_sort(F.collect_list(F.struct("leg", "backends"))).alias("met"))
        found = near if routes == ["dense"] else both.select("id", "score", F.flatten("met.backends").alias("backends"))
    return ranked(found)


def _ranked(entries: DataFrame, authority: DataFrame, hits: DataFrame, needles: list[str], limit: int) -> DataFrame:
    best = boost(hits, authority).join(hits.select("id", "backends"), "id").orderBy(F.desc("score"), "id").limit(limit)
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    shown = entries.select("id", snippet(bare("title"), bare("body"), needles).alias("snippet"))
    return best.join(shown, "id").orderBy(F.desc("score"), "id")
