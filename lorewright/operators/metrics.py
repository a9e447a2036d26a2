"""The five entry metrics, and their distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewright.model import EVIDENCE_TYPES
from lorewright.operators.graph import reachable_sources, sources_of
from lorewright.plans.lineage import cut
from lorewright.plans.quantiles import quantiles

WINDOW_DAYS, HALF_LIFE_DAYS = 90, 30


def freshness_score(captured_at: Column, as_of: str) -> Column:
    """0.5 ** (days / 365); 0.5 for null and future dates."""
    days = F.datediff(F.lit(as_of).cast("date"), captured_at)
    return F.when(captured_at.isNull() | (days < 0), 0.5).otherwise(F.pow(F.lit(0.5), days / 365.0))


def superseded(edges: DataFrame) -> DataFrame:
    """(id) of entries with an edge superseded_by, or that another supersedes."""
    out = edges.where("type = 'superseded_by'").select(F.col("source_id").alias("id"))
    return out.unionAll(edges.where("type = 'supersedes'").select(F.col("target_id").alias("id"))).distinct()


def evidence(entries: DataFrame, edges: DataFrame, as_of: str, reached: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """(id, sources, diversity, evidence_strength, drift_score) of every entry, by the sources it reaches; these are looked up in
    `sources` (entries), where the entries are a part."""
    reached = reachable_sources(entries, edges) if reached is None else reached
    facts = (entries if sources is None else sources).where("kind = 'source'").select(F.col("id").alias("source"), "source_type", freshness_score(F.col("captured_at"), as_of).alias("fresh"))
    gone = superseded(edges).select(F.col("id").alias("source"), F.lit(1.0).alias("gone"))
    facts = facts.join(gone, "source", "left")
    sums = reached.join(facts, "source").groupBy("id").agg(F.count("*").alias("sources"), F.countDistinct("source_type").alias("diversity"), F.avg("fresh").alias("fresh"), F.avg(F.coalesce("gone", F.lit(0.0))).alias("drift"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return entries.select("id").join(sums, "id", "left").select(
        "id", zero("sources").alias("sources"), zero("diversity").alias("diversity"), F.coalesce(F.col("sources") * F.col("diversity") * F.col("fresh"), F.lit(0.0)).alias("evidence_strength"), F.coalesce("drift", F.lit(0.0)).alias("drift_score")
    )


def compression_ratio(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, compression_ratio): derived_from edges that leave an entry."""
    counts = edges.where("type = 'derived_from'").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n"))
    return entries.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("compression_ratio"))


def action_relevance(entries: DataFrame, edges: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """(id, action_relevance): for concepts evidence_refs from decisions and depends_on from concepts, for dossiers
    evidence_refs from concepts and related from decisions, else 0. users: the entries whose uses
    count, where `entries` are a part."""
    kinds = entries.select("id", "kind")
    met = edges.join((entries if users is None else users).select(F.col("id").alias("source_id"), F.col("kind").alias("from_kind")), "source_id").join(kinds.select(F.col("id").alias("target_id"), "kind"), "target_id")
    uses = F.expr("""(kind = 'concept' AND (type = 'evidence_refs' AND from_kind = 'decision' OR type = 'depends_on' AND from_kind = 'concept'))
      OR (kind = 'dossier' AND (type = 'evidence_refs' AND from_kind = 'concept' OR type = 'related' AND from_kind = 'decision'))""")
    counts = met.where(uses).groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n"))
    return entries.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("action_relevance"))


def retrieval_heat(access: DataFrame, as_of: str, window_days: int = WINDOW_DAYS, half_life_days: int = HALF_LIFE_DAYS) -> DataFrame:
    """(entry_id, heat): accesses of the window, each halved every half_life_days; future ones count whole."""
    now = F.lit(as_of).cast("timestamp")
    age = (now.cast("double") - F.col("accessed_at").cast("timestamp").cast("double")) / 86400.0
    fresh = access.where(F.col("accessed_at") >= now - F.expr(f"INTERVAL {int(window_days)} DAYS"))
    return fresh.groupBy("entry_id").agg(F.sum(F.pow(F.lit(0.5), F.greatest(age, F.lit(0.0)) / half_life_days)).alias("heat"))


def contradictions(edges: DataFrame) -> DataFrame:
    """(id, contradicts): contradicts edges in and out."""
    own = edges.where("type = 'contradicts'")
    return own.select(F.col("source_id").alias("id")).unionAll(own.select(F.col("target_id").alias("id"))).groupBy("id").agg(F.count("*").alias("contradicts"))


def entry_metrics(entries: DataFrame, edges: DataFrame, access: DataFrame, as_of: str, only: DataFrame | None = None) -> DataFrame:
    """All five metrics of every entry, or of those that `only` (id) names, with sources and diversity. With `only`, edges and accesses
    are kept by these ids before anything is counted."""
    if only is None:
        own, reached, leaving, reaching, used = entries, reachable_sources(entries, edges), edges, edges, access
    else:
        own, reached = entries.join(only, "id", "left_semi"), sources_of(only, entries, edges)
        leaving, reaching = (edges.join(only.withColumnRenamed("id", c), c, "left_semi") for c in ("source_id", "target_id"))
        used = access.join(only.withColumnRenamed("id", "entry_id"), "entry_id", "left_semi")
    heat = retrieval_heat(used, as_of).select(F.col("entry_id").alias("id"), F.col("heat").alias("retrieval_heat"))
    relevance = action_relevance(own, reaching, entries)
    rows = evidence(own, edges, as_of, reached, entries).join(compression_ratio(own, leaving), "id").join(relevance, "id").join(heat, "id", "left")
    return rows.withColumn("retrieval_heat", F.coalesce("retrieval_heat", F.lit(0.0)))


def dependants(changed: DataFrame, entries: DataFrame, edges: DataFrame, old_edges: DataFrame, hops: int = 9) -> DataFrame:
    """(id) of the entries whose metrics may differ after the entries `changed` (id) and their outgoing edges did: these, what
    their old and new edges point to (its relevance, or its being superseded), and all from which evidence edges lead to one of
    them. A walk back ends at sources, from which no evidence counts."""
    both = edges.unionByName(old_edges).select("source_id", "target_id", "type").distinct()
    near = both.join(changed.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select(F.col("target_id").alias("id"))
    found = frontier = cut(changed.select("id").unionAll(near).distinct())
    back = both.where(F.col("type").isin(*EVIDENCE_TYPES)).join(entries.where("kind = 'source'").select(F.col("id").alias("source_id")), "source_id", "left_anti")
    for _ in range(hops):
        reached = back.join(frontier.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(F.col("source_id").alias("id")).distinct()
        frontier = cut(reached.join(found, "id", "left_anti"))
        if frontier.isEmpty():
            break
        found = found.unionAll(frontier)
    return found.join(entries, "id", "left_semi")


def updated_metrics(held: DataFrame, changed: DataFrame, entries: DataFrame, edges: DataFrame, old_edges: DataFrame, access: DataFrame, as_of: str) -> DataFrame:
    """The held metrics (id and entry_metrics' columns), those of the changed entries' dependants worked out anew; entries that are gone
    go. Heat moves with the date: held rows keep the heat of the date they were worked out for."""
    touched = cut(dependants(changed, entries, edges, old_edges))
    fresh = entry_metrics(entries, edges, access, as_of, touched)
    return held.join(touched, "id", "left_anti").join(entries, "id", "left_semi").select(*fresh.columns).unionAll(fresh)


def distribution(rows: DataFrame, columns: list[str], points: tuple[float, ...] = (0.5, 0.9, 0.95)) -> DataFrame:
    """(metric, count, min, p50, p90, p95, max) of each column, percentiles by linear interpolation; 0 where empty. The
    columns are unpivoted, so one pass serves all."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("group"), F.col(c).cast("double").alias("value")) for c in columns])).alias("m")).select("m.*")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return quantiles(long, points).select(F.col("group").alias("metric"), "count", zero("min"), *[zero(f"p{int(p * 100)}") for p in points], zero("max"))
