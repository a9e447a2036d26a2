"""Diagnose, local and doctor rules. Each gives findings: rule_id, severity, target_id, message."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright.functions.text import let
from lorewright.model import RELATION_TYPES
from lorewright.operators import graph, metrics
from lorewright.plans import blocks
from lorewright.plans.lineage import stored

#: How far a product of matrices may be from a sum component by component, and far more.
MARGIN = 1e-9


def _findings(rows: DataFrame, rule: str, severity: str, message: Column | str = "", target: str = "id") -> DataFrame:
    said = F.lit(message) if isinstance(message, str) else message
    return rows.select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.col(target).alias("target_id"), said.alias("message"))


def source_reachability(entries: DataFrame, reached: DataFrame) -> DataFrame:
    return _findings(entries.where("kind <> 'view'").join(reached.select("id").distinct(), "id", "left_anti"), "redline_9_source_reachability", "high")


def view_as_evidence(entries: DataFrame, edges: DataFrame) -> DataFrame:
    kinds = entries.select("id", "kind")
    met = edges.join(kinds.where("kind = 'view'").select(F.col("id").alias("target_id")), "target_id").join(kinds.where("kind <> 'view'").select(F.col("id").alias("source_id")), "source_id")
    return _findings(met.select("source_id", "target_id").distinct().select(F.col("source_id").alias("id"), "target_id"), "redline_10_view_as_evidence", "high", F.col("target_id"))


def source_context(entries: DataFrame, edges: DataFrame) -> DataFrame:
    return _findings(entries.where("kind = 'source'").join(metrics.superseded(edges), "id", "left_semi"), "decay_source_context", "medium")


def dossier_outdated(entries: DataFrame, facts: DataFrame, reached: DataFrame) -> DataFrame:
    dossiers = entries.where("kind = 'dossier'").select("id", "updated_at")
    sources = entries.where("kind = 'source'").select(F.col("id").alias("source"), F.coalesce("captured_at", "updated_at").alias("at"))
    newer = reached.join(dossiers, "id").join(sources, "source").where("at > updated_at").select("id").distinct().withColumn("newer", F.lit(True))
    own = dossiers.join(facts.select("id", "drift_score"), "id").join(newer, "id", "left")
    return _findings(own.where("drift_score >= 0.5 or newer"), "decay_dossier_outdated", "medium")


def evidence_singular(entries: DataFrame, edges: DataFrame, facts: DataFrame, stable: bool = False) -> DataFrame:
    refs = edges.where("type = 'evidence_refs'").select(F.col("source_id").alias("id")).distinct()
    own = entries.where("kind = 'concept'").where("freshness = 'stable'" if stable else "true").join(refs, "id", "left_semi").join(facts, "id").where("diversity < 2")
    return _findings(own, "push_pseudo_stable" if stable else "decay_concept_evidence_singular", "medium")


def fossil_concept(entries: DataFrame, facts: DataFrame, relevance: DataFrame, least: int = 3) -> DataFrame:
    own = entries.where("kind = 'concept'").join(facts, "id").join(relevance, "id").where((F.col("evidence_strength") < 1) & (F.col("action_relevance") >= least))
    return _findings(own, "structure_fossil_concept", "medium")


def monoculture(entries: DataFrame, facts: DataFrame) -> DataFrame:
    own = entries.where("kind in ('dossier', 'concept', 'decision')").join(facts, "id").where("sources >= 2 and diversity < 2")
    return _findings(own, "structure_monoculture_evidence", "medium")


def supersedes_cycle(edges: DataFrame) -> DataFrame:
    return _findings(graph.cycle_members(edges), "structure_supersedes_cycle", "medium")


def demote(entries: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    own = entries.where("kind in ('concept', 'dossier', 'decision')").join(facts, "id").join(metrics.contradictions(edges), "id", "left")
    return _findings(own.where("drift_score >= 0.5 or contradicts >= 2"), "action_demote", "medium")


def _sets(entries: DataFrame) -> DataFrame:
    own = entries.where("kind not in ('source', 'view')").select("id", "kind", F.array_distinct("search_terms").alias("terms"))
    return own.where("size(terms) > 0")


def _similarity(a: str, b: str) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def term_pairs(entries: DataFrame, least: float = 0.5, but: DataFrame | None = None, block: int = blocks.BLOCK) -> DataFrame:
    """(left_id, right_id, similarity): pairs of one kind whose search terms overlap by Jaccard, see `_like`."""
    return _like(stored(_sets(entries)), least, but, block)


def _like(sets: DataFrame, least: float, but: DataFrame | None, block: int = blocks.BLOCK) -> DataFrame:
    """The pairs of `_sets`. Entries of the same terms are compared as one (`plans/blocks.py`). Pairs come from an inverted index
    over each set's rarest terms: at similarity s two sets of sizes p and q share at least one of the first
    p - ceil(s * p) + 1 terms in order of rarity, so frequent terms build no pairs. A pair is made and compared under the first
    such term that both have, where their rows meet, so pairs are never shuffled. but: (left_id, right_id) of few pairs of different
    ids, left out. sets are read several times."""
    none = F.array().cast("array<string>")
    own = sets.withColumn("terms", F.array_sort("terms"))
    if but is None:
        own = own.withColumn("without", none)
    else:
        both = but.select(F.col("left_id").alias("id"), F.col("right_id").alias("other")).unionAll(but.select("right_id", "left_id"))
        own = stored(own.join(both.groupBy("id").agg(F.array_sort(F.collect_set("other")).alias("without")), "id", "left").withColumn("without", F.coalesce("without", none)))
    own = stored(blocks.alike(own, block))
    posted = own.select("id", "kind", F.explode("terms").alias("term"))
    counts = posted.groupBy("kind", "term").agg(F.count("*").alias("n"))
    ranked = posted.join(counts, ["kind", "term"]).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "term"))), lambda x: x["term"]).alias("order"))
    prefix = F.slice("order", F.lit(1), (F.size("terms") - F.ceil(F.lit(least) * F.size("terms")) + 1).cast("int"))
    own = own.join(ranked, "id").select("id", "ids", "kind", "terms", "without", F.posexplode(prefix).alias("at", "term"), "order")
    rows = stored(own.select("id", "ids", "kind", "term", "terms", "without", F.slice("order", F.lit(1), F.col("at")).alias("before")))
    met = blocks.met(rows, ["kind", "term"], block)
    met = met.where(F.least(F.size("terms_l"), F.size("terms_r")) >= least * F.greatest(F.size("terms_l"), F.size("terms_r"))).where(blocks.apart("before_l", "before_r"))
    met = met.withColumn("similarity", let(F.size(F.array_intersect("terms_l", "terms_r")), lambda n: n / (F.size("terms_l") + F.size("terms_r") - n))).where(F.col("similarity") >= least)
    # a pair left out stands with both its ids, and no id with itself
    out = blocks.pairs(met.withColumn("without", F.when(F.size("without_r") == 0, none).otherwise(F.col("without_l"))), "without", "similarity")
    out = out.where((F.size("without") == 0) | ~(F.array_contains("without", F.col("left_id")) | F.array_contains("without", F.col("right_id"))))
    return out.select("left_id", "right_id", "similarity")


def merge(entries: DataFrame, edges: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of `term_pairs` without a relation. Of relations only those between entries of like terms can leave a pair out."""
    linked = graph.neighbors(edges).select(F.col("id").alias("left_id"), F.col("neighbor").alias("right_id")).where("left_id < right_id")
    own = stored(_sets(entries))
    side = lambda s: own.select(F.col("id").alias(f"{s}_id"), F.col("kind").alias(f"{s}_kind"), F.col("terms").alias(s))
    near = linked.join(side("left"), "left_id").join(side("right"), "right_id").where("left_kind = right_kind").where(_similarity("left", "right") >= least)
    return _findings(_like(own, least, near.select("left_id", "right_id")), "action_merge", "medium", F.col("right_id"), "left_id")


def retract(entries: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    active = entries.where("kind = 'decision' and decision_status = 'active'").select("id")
    gone = edges.where("type = 'evidence_refs'").join(metrics.superseded(edges).withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(F.col("source_id").alias("id")).distinct().withColumn("gone", F.lit(True))
    return _findings(active.join(facts, "id").join(gone, "id", "left").where("drift_score >= 1 or gone"), "action_retract", "high")


def premise_shaken(entries: DataFrame, edges: DataFrame, facts: DataFrame, heat: DataFrame) -> DataFrame:
    active = entries.where("kind = 'decision' and decision_status = 'active'").select("id")
    weak = entries.where("freshness = 'volatile'").select("id").unionAll(metrics.superseded(edges)).distinct()
    shaken = edges.where("type = 'evidence_refs'").join(weak.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(F.col("source_id").alias("id")).distinct().withColumn("shaken", F.lit(True))
    own = active.join(facts, "id").join(heat.withColumnRenamed("entry_id", "id"), "id").join(shaken, "id", "left")
    return _findings(own.where("heat >= 3 and (drift_score >= 0.75 or shaken)"), "push_premise_shaken", "high")


def crystallize(entries: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """Groups of notes that nothing derives from, by tag: the first note and the first three ids."""
    absorbed = edges.where("type = 'derived_from'").select(F.col("target_id").alias("id"))
    notes = entries.where("kind = 'note'").join(absorbed, "id", "left_anti").select("id", F.explode("tags").alias("tag")).where("tag is not null and tag <> '测试'").distinct()
    order = Window.partitionBy("tag").orderBy("id")
    first = notes.withColumn("place", F.row_number().over(order)).where("place <= 3").groupBy("tag").agg(F.min("id").alias("id"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))
    groups = notes.groupBy("tag").agg(F.count("*").alias("n")).where(F.col("n") >= least).join(first, "tag")
    return _findings(groups, "push_crystallize", "medium", F.concat("tag", F.lit(":"), F.col("n").cast("string"), F.lit(":"), "ids"))


def internal_split(entries: DataFrame, edges: DataFrame) -> DataFrame:
    return _findings(entries.where("kind = 'concept'").join(metrics.contradictions(edges).where("contradicts >= 2"), "id", "left_semi"), "push_internal_split", "medium")


def divergence(entries: DataFrame, facts: DataFrame, heat: DataFrame) -> DataFrame:
    own = entries.where("kind = 'dossier'").join(facts, "id").join(heat.withColumnRenamed("entry_id", "id"), "id").where("drift_score >= 0.7 and heat >= 2")
    return _findings(own, "push_cognitive_divergence", "medium")


#: kind, target kind, least evidence strength, least action relevance, whether evidence_refs are needed.
PROMOTIONS = (("note", "dossier", 3, 1, False), ("note", "concept", 5, 3, False), ("dossier", "concept", 3, 0, True), ("concept", "decision", 0, 5, True))


def promotion_signal(entries: DataFrame, edges: DataFrame, facts: DataFrame, relevance: DataFrame, promotions: tuple = PROMOTIONS) -> DataFrame:
    refs = edges.where("type = 'evidence_refs'").select(F.col("source_id").alias("id")).distinct().withColumn("refs", F.lit(True))
    own = entries.select("id", "kind").join(facts, "id").join(relevance, "id").join(refs, "id", "left")
    fits = lambda p: (F.col("kind") == p[0]) & (F.col("evidence_strength") >= p[2]) & (F.col("action_relevance") >= p[3]) & (F.lit(not p[4]) | F.coalesce("refs", F.lit(False)))
    targets = F.array_compact(F.array(*[F.when(fits(p), F.lit(p[1])) for p in promotions]))
    return _findings(own.select("id", F.explode(targets).alias("target")), "promotion_signal", "medium", F.col("target"))


def broken_relations(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges without a target, with the source's path."""
    lost = edges.join(entries.select(F.col("id").alias("target_id")), "target_id", "left_anti")
    return lost.join(entries.select(F.col("id").alias("source_id"), "file_path"), "source_id", "left").select("source_id", "target_id", "type", "origin", "file_path")


def alias_conflicts(entries: DataFrame) -> DataFrame:
    """(alias, holders, ids) of aliases that several entries hold, archived ones left out."""
    held = entries.where("status <> 'archived'").select("id", F.explode("aliases").alias("alias")).distinct()
    return held.groupBy("alias").agg(F.count("*").alias("holders"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids")).where("holders > 1")


def orphan_relation_types(edges: DataFrame) -> DataFrame:
    return edges.where(~F.col("type").isin(*RELATION_TYPES)).select("type").distinct()


def metrics_stale(entries: DataFrame, updated: DataFrame, hours: int = 24) -> DataFrame:
    """(id, gap_hours) of entries whose metrics (entry_id, updated_at) are more than hours behind the entry."""
    met = entries.select("id", F.col("updated_at").alias("changed")).join(updated.withColumnRenamed("entry_id", "id"), "id")
    gap = (F.unix_timestamp(F.col("changed").cast("timestamp")) - F.unix_timestamp("updated_at")) / 3600
    return met.select("id", gap.alias("gap_hours")).where(F.col("gap_hours") > hours)


def term_near_duplicates(entries: DataFrame, most: int = 500, distance: int = 2, least: int = 3) -> DataFrame:
    """(left_term, right_term, distance): near spellings among the first `most` terms by (term, id), as the operator is
    defined; one bounded table meets itself by length band."""
    terms = entries.select(F.explode("search_terms").alias("term"), "id").orderBy("term", "id").limit(most).where(F.length("term") >= least).select("term").distinct().withColumn("size", F.length("term"))
    banded = terms.withColumn("band", F.explode(F.sequence(F.col("size") - distance, F.col("size") + distance)))
    met = banded.select(F.col("term").alias("left_term"), F.col("band").alias("size")).join(terms.select(F.col("term").alias("right_term"), "size"), "size").where("left_term < right_term")
    return met.withColumn("distance", F.levenshtein("left_term", "right_term", distance)).where("distance >= 0").select("left_term", "right_term", "distance")


def alias_holders(entries: DataFrame) -> DataFrame:
    """(alias, representative, member): each holder of an alias that several entries hold, beside its smallest one. Any two
    members of an alias overlap, and two entries' shared count is the number of aliases of which both are members."""
    held = entries.where("status <> 'archived'").select("id", F.explode(F.array_distinct("aliases")).alias("alias")).where("alias is not null").distinct()
    first = held.groupBy("alias").agg(F.min("id").alias("representative"), F.count("*").alias("n")).where("n > 1").drop("n")
    return held.join(first, "alias").select("alias", "representative", F.col("id").alias("member"))


def semantic_candidates(vectors: DataFrame, asked: DataFrame, threshold: float = 0.92, most: int = 10, ask: int = 1024, block: int = 8192) -> DataFrame:
    """(id, candidate, similarity) of vectors (id, kind, embedding): for each asked one (id) those of its kind at the
    threshold, the best `most` by similarity and id. Vectors that hold a null have no similarity.

    A kind's asked vectors and all its vectors are dealt into blocks of about `ask` and `block` rows, and every two meet in one group,
    which gives the best `most` of each asked one. Products of matrices say which may be among them, to MARGIN; these are summed
    component by component."""
    whole = vectors.where("kind is not null and embedding is not null").where(~F.exists("embedding", lambda x: x.isNull()))
    whole = whole.select("id", "kind", F.size("embedding").alias("dim"), F.col("embedding").cast("array<double>").alias("embedding"))
    queries = whole.join(asked.select("id").distinct(), "id", "left_semi")
    counts = whole.groupBy("kind", "dim").agg(F.ceil(F.count("*") / block).alias("blocks"))
    counts = queries.groupBy("kind", "dim").agg(F.ceil(F.count("*") / ask).alias("asks")).join(counts, ["kind", "dim"])
    at = lambda n: F.pmod(F.xxhash64("id"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = queries.join(counts, ["kind", "dim"]).select("kind", "dim", at("asks").alias("i"), every("blocks").alias("j"), F.lit(True).alias("asks"), "id", "embedding")
    right = whole.join(counts, ["kind", "dim"]).select("kind", "dim", every("asks").alias("i"), at("blocks").alias("j"), F.lit(False).alias("asks"), "id", "embedding")
    kind = vectors.schema["id"].dataType.simpleString()

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        said, others = frame[frame["asks"]], frame[~frame["asks"]]
        none = pd.DataFrame({"id": frame["id"][:0], "candidate": frame["id"][:0], "similarity": np.zeros(0)})
        if said.empty or others.empty:
            return none
        q, c = np.stack(said["embedding"].to_numpy()), np.stack(others["embedding"].to_numpy())
        with np.errstate(all="ignore"):
            norms = np.sqrt(_squares(q))[:, None] * np.sqrt(_squares(c))
            near = np.where(norms == 0, 0.0, q @ c.T / norms)
        near[np.isnan(near)] = np.inf  # not a number is above all
        near[said["id"].to_numpy()[:, None] == others["id"].to_numpy()] = -np.inf
        least = np.full(len(q), threshold)
        if near.shape[1] > most:
            least = np.maximum(least, np.partition(near, near.shape[1] - most, axis=1)[:, near.shape[1] - most])
        i, j = np.nonzero((near >= least[:, None] - MARGIN) & (near > -np.inf))
        with np.errstate(all="ignore"):
            exact = np.zeros(len(i))
            for d in range(q.shape[1]):
                exact = exact + q[i, d] * c[j, d]
            exact = np.where(norms[i, j] == 0, 0.0, exact / norms[i, j])
        found = pd.DataFrame({"id": said["id"].to_numpy()[i], "candidate": others["id"].to_numpy()[j], "similarity": exact})
        found = found[(found["similarity"] >= threshold) | found["similarity"].isna()]
        found = found.assign(above=found["similarity"].fillna(np.inf)).sort_values(["id", "above", "candidate"], ascending=[True, False, True])
        return found.groupby("id").head(most)[["id", "candidate", "similarity"]]

    met = left.unionByName(right).groupBy("kind", "dim", "i", "j").applyInPandas(best, f"id {kind}, candidate {kind}, similarity double")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "candidate"))
    return met.withColumn("place", place).where(F.col("place") <= most).select("id", "candidate", "similarity")


def _squares(rows: np.ndarray) -> np.ndarray:
    """Sums of squares, component by component from the first."""
    out = np.zeros(len(rows))
    for d in range(rows.shape[1]):
        out = out + rows[:, d] * rows[:, d]
    return out


def _sharing(frame: pd.DataFrame) -> pd.DataFrame:
    """For each (after, tags, m) of one term: a sum, over the subsets of after and the subsets but the empty one of tags, of how many
    rows of the term hold both, with the signs of inclusion and exclusion."""
    names: dict[tuple[str, str], int] = {}
    mask = lambda which, values: sum(1 << names.setdefault((which, v), len(names)) for v in values)
    rows = [(mask("term", a), mask("tag", t)) for a, t in zip(frame["after"], frame["tags"], strict=True)]
    held: dict[int, int] = {}

    def subsets(of: int) -> list[int]:
        out, s = [], of
        while s:
            out.append(s)
            s = (s - 1) & of
        return out

    for (after, tags), m in zip(rows, frame["m"].tolist(), strict=True):
        terms = [*subsets(after), 0]
        for u in subsets(tags):
            for s in terms:
                held[u | s] = held.get(u | s, 0) + m
    sums = []
    for after, tags in rows:
        terms = [(s, s.bit_count() + 1) for s in (*subsets(after), 0)]
        sums.append(sum(held[u | s] if (n + u.bit_count()) % 2 == 0 else -held[u | s] for u in subsets(tags) for s, n in terms))
    return frame[["term", "after", "tags"]].assign(n=sums)


def missing_relation_hint(entries: DataFrame, edges: DataFrame, least: int = 2, meet: int = 50, wide: int = 10) -> DataFrame:
    """Entries of which at least `least` others share a tag and a search term without a relation; the message counts them.

    Others by terms of up to `meet` holders are met one by one. Those by a more frequent (hot) term are counted and not met:
    by inclusion and exclusion over the subsets of its hot terms and tags an entry's count is a sum of how many entries hold each
    subset. Subsets are summed under their rarest term: what is sent to a term is the distinct sets of more frequent terms and tags of its
    holders, so a subset is no row, and the most frequent terms have the fewest sets. Entries of more than `wide` hot terms and tags are
    met one by one."""
    whole = lambda c: F.sort_array(F.array_distinct(F.filter(c, lambda x: x.isNotNull())))
    own = entries.where("kind <> 'source' and status <> 'archived'").select("id", whole("search_terms").alias("terms"), whole("tags").alias("tags"))
    posted = own.select("id", F.explode("terms").alias("term"))
    counts = posted.groupBy("term").agg(F.count("*").alias("n")).where("n > 1")
    posted = posted.join(counts.select("term", "n", (F.col("n") > meet).alias("is_hot")), "term")
    hot = F.transform(F.sort_array(F.collect_list(F.when(F.col("is_hot"), F.struct("n", "term")))), lambda x: x["term"])  # the rarest first
    facts = posted.groupBy("id").agg(hot.alias("hot")).join(own.select("id", "tags"), "id")
    facts = facts.withColumn("narrow", F.size("hot") + F.size("tags") <= wide).where(F.size("tags") > 0)
    posted = posted.join(facts.select("id", "narrow"), "id")
    linked = graph.neighbors(edges).where("id <> neighbor").select("id", F.col("neighbor").alias("other"))
    others = facts.select(F.col("id").alias("other"), F.col("tags").alias("others"), F.col("hot").alias("hots"), F.col("narrow").alias("narrows"))
    counted = F.col("narrow") & F.col("narrows") & F.arrays_overlap("hot", "hots")

    met = lambda a, b: a.select("id", "term").join(b.select(F.col("id").alias("other"), "term"), "term").where("id <> other").select("id", "other")
    rare, hot, broad = posted.where("not is_hot"), posted.where("is_hot"), posted.where("is_hot and not narrow")
    pairs = met(rare, rare).unionAll(met(broad, hot)).unionAll(met(hot, broad)).distinct()
    pairs = pairs.join(linked, ["id", "other"], "left_anti").join(facts, "id").join(others, "other").where(F.arrays_overlap("tags", "others") & ~counted)
    singles = pairs.groupBy("id").agg(F.count("*").alias("n"))

    members = facts.where(F.col("narrow") & (F.size("hot") > 0))
    parts = members.select("id", "hot", "tags", F.posexplode("hot").alias("at", "term")).select("id", "term", F.slice("hot", F.col("at") + 2, F.size("hot")).alias("after"), "tags")
    sums = parts.groupBy("term", "after", "tags").agg(F.count("*").alias("m")).groupBy("term").applyInPandas(_sharing, "term string, after array<string>, tags array<string>, n long")
    sums = parts.join(sums, ["term", "after", "tags"]).groupBy("id").agg((F.sum("n") - 1).alias("n"))  # the entry itself is no other
    known = linked.join(facts, "id").join(others, "other").where(counted & F.arrays_overlap("tags", "others")).groupBy("id").agg((-F.count("*")).alias("n"))
    hints = singles.unionAll(sums).unionAll(known).groupBy("id").agg(F.sum("n").cast("long").alias("n")).where(F.col("n") >= least)
    return _findings(hints, "missing_relation_hint", "medium", F.col("n").cast("string"))
