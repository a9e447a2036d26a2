"""Registered queries of the knowledge-base engine, each with its DuckDB equivalent where SQL has one."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright import more_queries, search_queries
from lorewright.functions import text
from lorewright.model import CHAIN
from lorewright.operators import analytics, filters, graph, metrics, rules, search, titles
from lorewright.sources import views
from lorewright.sources.views import AS_OF


class Tables:
    """The views of one data set, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    entries = property(lambda self: views.entries(self.spark, self.sf_dir))
    edges = property(lambda self: views.edges(self.spark, self.sf_dir))
    access = property(lambda self: views.access_log(self.spark, self.sf_dir))
    queue = property(lambda self: views.queue(self.spark, self.sf_dir))
    authority = property(lambda self: self.entries.select("id", (F.col("n") % 17 / 17.0).alias("authority")))


class Query(NamedTuple):
    run: Callable[[Tables], DataFrame]
    views: tuple[str, ...] = ()
    sql: str | None = None


_QUERIES: dict[str, Query] = {}
_AUTHORITY = "authority AS (SELECT id, n % 17 / 17.0::DOUBLE AS authority FROM entries)"


def _add(name: str, run: Callable[[Tables], DataFrame], needs: str = "", sql: str | None = None) -> None:
    _QUERIES[name] = Query(run, tuple(needs.split()), sql)


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


# --- statistics and filters
for _column in ("kind", "status", "freshness", "domain"):
    _add(f"stats_by_{_column}", lambda t, c=_column: analytics.counts_by(t.entries, c), "entries", f"SELECT coalesce(nullif({_column}, ''), '<null>') AS value, count(*) AS n FROM entries GROUP BY 1")
_add("total_count", lambda t: t.entries.agg(F.count("*").alias("n")), "entries", "SELECT count(*) AS n FROM entries")
_add(
    "domain_list_with_vocab", lambda t: analytics.domain_list(t.entries, t.spark.sql("SELECT * FROM VALUES ('src0'), ('unused') AS v(domain)")), "entries",
    """, names AS (SELECT unnest(['src0', 'unused', '_unsorted']) AS domain),
    used AS (SELECT coalesce(nullif(domain, ''), '_unsorted') AS domain, count(*) AS n, max(updated_at) AS last_updated FROM entries GROUP BY 1)
    SELECT coalesce(u.domain, v.domain) AS domain, coalesce(n, 0) AS n, last_updated FROM used u FULL JOIN names v ON u.domain = v.domain""",
)
_add("entry_listing", lambda t: t.entries.select("id", "kind", "slug"), "entries", "SELECT id, kind, slug FROM entries")
_add("all_tags", lambda t: t.entries.select(F.explode("tags").alias("tag")).where("tag is not null").distinct(), "entries", "SELECT DISTINCT tag FROM (SELECT unnest(tags) AS tag FROM entries) WHERE tag IS NOT NULL")
_add("duplicate_ids", lambda t: t.entries.select(F.concat(F.lit("x"), (F.col("n") % 97).cast("string")).alias("id")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "entries", "SELECT 'x' || n % 97 AS id, count(*) AS n FROM entries GROUP BY 1 HAVING count(*) > 1")
_add("filter_attributes", lambda t: filters.matching(t.entries, {"kind": "concept", "status": "active"}).select("id"), "entries", "SELECT id FROM entries WHERE kind = 'concept' AND status = 'active'")
_add("filter_tags_superset", lambda t: filters.matching(t.entries, {"tags": ["en", "src0"]}).select("id"), "entries", "SELECT id FROM entries WHERE list_has_all(tags, ['en', 'src0'])")
_add("filter_unknown_key", lambda t: filters.matching(t.entries, {"colour": "red"}).select("id"), "entries", "SELECT id FROM entries WHERE FALSE")
_add("filter_expression_language", lambda t: filters.expression(t.entries, "kind = 'note' AND status != 'archived' AND freshness <> 'stable'", ("kind", "status", "freshness")).select("id"), "entries", "SELECT id FROM entries WHERE kind = 'note' AND status <> 'archived' AND freshness <> 'stable'")
_add("active_only", lambda t: t.entries.where("status <> 'archived'").select("id"), "entries", "SELECT id FROM entries WHERE status <> 'archived'")
_add("sources_by_target", lambda t: t.entries.where("kind = 'source' and watch_target = 'owner/repo3'").select("id"), "entries", "SELECT id FROM entries WHERE kind = 'source' AND watch_target = 'owner/repo3'")
_add("source_url_invalid", lambda t: filters.invalid_urls(t.entries).select("id", "source_url"), "entries", "SELECT id, source_url FROM entries WHERE kind = 'source' AND NOT regexp_matches(source_url, '^(https?|knowledge)://')")
_add("body_length_validation", lambda t: filters.body_length(t.entries).select("id", "problem"), "entries", "SELECT id, CASE WHEN strlen(body) > 40960 THEN 'too_long' ELSE 'too_short' END AS problem FROM entries WHERE strlen(body) > 40960 OR (kind <> 'source' AND length(trim(body, ' \t\n\r')) < 50)")
_add(
    "search_terms_validation", lambda t: filters.search_terms_problems(t.entries).select("id", "problem"), "entries",
    """SELECT id, unnest(list_filter([CASE WHEN len(search_terms) < 5 THEN 'too_few' END, CASE WHEN NOT regexp_matches(array_to_string(search_terms, ' '), '[\\x{4E00}-\\x{9FFF}]') THEN 'no_cjk' END,
      CASE WHEN NOT regexp_matches(array_to_string(search_terms, ' '), '[A-Za-z]') THEN 'no_ascii' END, CASE WHEN len([x FOR x IN search_terms IF length(x) > 40]) > 0 THEN 'too_long' END,
      CASE WHEN len([x FOR x IN search_terms IF x <> '' AND trim(x) = '']) > 0 THEN 'blank' END], lambda p: p IS NOT NULL)) AS problem FROM entries""",
)
_add("entry_path", lambda t: t.entries.select("id", filters.path_of(F.col("kind"), F.col("domain"), F.col("slug"), F.col("created_at")).alias("path")), "entries", "SELECT id, CASE kind WHEN 'source' THEN 'sources/' || strftime(created_at, '%Y/%m') || '/' || slug || '.md' WHEN 'view' THEN 'views/' || slug || '.md' ELSE 'entries/' || kind || '/' || coalesce(nullif(domain, ''), '_unsorted') || '/' || slug || '.md' END AS path FROM entries")
_add("review_queue_due", lambda t: filters.review_due(t.entries, AS_OF).select("id", "review_due_at"), "entries", f"SELECT id, review_due_at FROM entries WHERE kind = 'dossier' AND status <> 'archived' AND review_due_at <= DATE '{AS_OF}'")
_add("review_picks", lambda t: filters.review_picks(t.entries), "entries", "SELECT id, 'draft' AS queue FROM entries WHERE status = 'draft' UNION ALL SELECT id, freshness AS queue FROM entries WHERE freshness IN ('volatile', 'watch')")
_add("terms_flat", lambda t: t.entries.select("id", F.explode(F.array_distinct("search_terms")).alias("term")).withColumn("field", F.lit("search_terms")).unionByName(t.entries.select("id", F.explode(F.array_distinct("aliases")).alias("term")).withColumn("field", F.lit("aliases"))), "entries", "SELECT id, unnest(search_terms) AS term, 'search_terms' AS field FROM entries UNION ALL SELECT id, unnest(aliases) AS term, 'aliases' AS field FROM entries")

# --- queue and access log
_add("queue_list_filtered", lambda t: filters.queue_list(t.queue, status="pending", severity="high", since="2024-01-15").select("id", "created_at"), "queue", "SELECT id, created_at FROM queue WHERE status = 'pending' AND severity = 'high' AND created_at >= TIMESTAMP '2024-01-15'")
_add("queue_group_by_origin", lambda t: t.queue.groupBy("origin").agg(F.count("*").alias("n"), F.count(F.when(F.col("created_at") > F.lit("2024-01-20").cast("timestamp"), 1)).alias("new_count")), "queue", "SELECT origin, count(*) AS n, count(*) FILTER (created_at > TIMESTAMP '2024-01-20') AS new_count FROM queue GROUP BY 1")
_add("guardrail_daily_json_count", lambda t: filters.guardrail(t.queue), "queue", "SELECT agent_id, CAST(created_at AS DATE) AS day, json_extract_string(details_json, '$.k') AS source_id, count(*) AS n, count(*) < 10 AS allowed FROM queue GROUP BY 1, 2, 3")
_add("access_log_replay", lambda t: t.access.join(t.entries.select(F.col("id").alias("entry_id")), "entry_id", "left_semi").groupBy("entry_id", "op").agg(F.count("*").alias("n")), "entries access_log", "SELECT entry_id, op, count(*) AS n FROM access_log WHERE entry_id IN (SELECT id FROM entries) GROUP BY 1, 2")
_add("status_event_counts", lambda t: t.queue.groupBy("entry_id", "status").agg(F.count("*").alias("n")), "queue", "SELECT entry_id, status, count(*) AS n FROM queue GROUP BY 1, 2")

# --- joins over relations
_add("edge_list", lambda t: t.edges, "edges", "SELECT source_id, target_id, type, origin FROM edges")
_add("find_by_aliases", lambda t: filters.by_aliases(t.entries, ["the", "and", "la", "der"]).select("id"), "entries", "SELECT id FROM entries WHERE list_has_any(aliases, ['the', 'and', 'la', 'der'])")
_add("in_relation_counts", lambda t: t.edges.join(t.entries.select(F.col("id").alias("source_id"), F.col("kind").alias("from_kind")), "source_id").groupBy("target_id", "type", "from_kind").agg(F.count("*").alias("n")), "entries edges", "SELECT target_id, type, e.kind AS from_kind, count(*) AS n FROM edges JOIN entries e ON e.id = source_id GROUP BY 1, 2, 3")
_add("broken_relations", lambda t: rules.broken_relations(t.entries, t.edges), "entries edges", "SELECT source_id, target_id, type, origin, e.file_path FROM edges LEFT JOIN entries e ON e.id = source_id WHERE target_id NOT IN (SELECT id FROM entries)")
_add("broken_by_origin", lambda t: rules.broken_relations(t.entries, t.edges).groupBy("origin").agg(F.count("*").alias("n")), "entries edges", "SELECT origin, count(*) AS n FROM edges WHERE target_id NOT IN (SELECT id FROM entries) GROUP BY 1")
_add("broken_cleanup_plan", lambda t: rules.broken_relations(t.entries, t.edges).where("origin <> 'confirmed'").select("source_id", "target_id", "type"), "entries edges", "SELECT source_id, target_id, type FROM edges WHERE origin <> 'confirmed' AND target_id NOT IN (SELECT id FROM entries)")
_add("orphan_relation_type", lambda t: rules.orphan_relation_types(t.edges), "edges", "SELECT DISTINCT type FROM edges WHERE type = 'mystery'")
_add("alias_conflicts", lambda t: rules.alias_conflicts(t.entries), "entries", "SELECT alias, count(*) AS holders, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT id, unnest(aliases) AS alias FROM entries WHERE status <> 'archived') GROUP BY 1 HAVING count(*) > 1")
_add("metrics_stale", lambda t: _round(rules.metrics_stale(t.entries, t.access.groupBy("entry_id").agg((F.max("accessed_at") - F.expr("INTERVAL 200 DAYS")).alias("updated_at"))), "gap_hours"), "entries access_log", ", m AS (SELECT entry_id, max(accessed_at) - INTERVAL 200 DAYS AS updated_at FROM access_log GROUP BY 1) SELECT id, round((epoch(CAST(e.updated_at AS TIMESTAMP)) - floor(epoch(m.updated_at))) / 3600, 6) AS gap_hours FROM entries e JOIN m ON e.id = m.entry_id WHERE (epoch(CAST(e.updated_at AS TIMESTAMP)) - floor(epoch(m.updated_at))) / 3600 > 24")
_add("is_superseded", lambda t: metrics.superseded(t.edges), "edges", "SELECT source_id AS id FROM edges WHERE type = 'superseded_by' UNION SELECT target_id AS id FROM edges WHERE type = 'supersedes'")
_add("contradicts_count", lambda t: metrics.contradictions(t.edges), "edges", "SELECT id, count(*) AS contradicts FROM (SELECT source_id AS id FROM edges WHERE type = 'contradicts' UNION ALL SELECT target_id FROM edges WHERE type = 'contradicts') GROUP BY 1")
# distances are of characters here and of bytes there, so both sides spell other than ASCII as '?'
_add("term_near_duplicates", lambda t: rules.term_near_duplicates(t.entries.withColumn("search_terms", F.transform("search_terms", lambda x: F.regexp_replace(x, "[^\\x00-\\x7F]", "?")))), "entries", ", t AS (SELECT DISTINCT term FROM (SELECT regexp_replace(term, '[^\\x00-\\x7F]', '?', 'g') AS term, id FROM (SELECT unnest(search_terms) AS term, id FROM entries) ORDER BY 1, 2 LIMIT 500) WHERE length(term) >= 3) SELECT a.term AS left_term, b.term AS right_term, CAST(levenshtein(a.term, b.term) AS INTEGER) AS distance FROM t a JOIN t b ON a.term < b.term WHERE levenshtein(a.term, b.term) <= 2")
_add("term_jaccard_pairs", lambda t: _round(rules.term_pairs(t.entries), "similarity"), "entries", ", own AS (SELECT id, kind, search_terms AS s FROM entries WHERE kind NOT IN ('source', 'view') AND len(search_terms) > 0) SELECT a.id AS left_id, b.id AS right_id, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))::DOUBLE, 6) AS similarity FROM own a JOIN own b ON a.kind = b.kind AND a.id < b.id WHERE len(list_intersect(a.s, b.s)) >= 0.5 * len(list_distinct(list_concat(a.s, b.s)))")

# --- graph
for _direction, _sql in (("out", "SELECT source_id AS id, target_id AS neighbor FROM edges"), ("in", "SELECT target_id AS id, source_id AS neighbor FROM edges"), ("both", "SELECT source_id AS id, target_id AS neighbor FROM edges UNION SELECT target_id, source_id FROM edges")):
    _add(f"neighbors_{_direction}", lambda t, d=_direction: graph.neighbors(t.edges, direction=d, entries=t.entries), "entries edges", f"SELECT DISTINCT x.id, x.neighbor FROM ({_sql}) x JOIN entries e ON e.id = x.neighbor AND e.status <> 'archived'")
_add("out_refs", lambda t: t.edges.where(F.col("type").isin("source_refs", "evidence_refs")).select("source_id", "target_id").distinct(), "edges", "SELECT DISTINCT source_id, target_id FROM edges WHERE type IN ('source_refs', 'evidence_refs')")
_NEAR = "near AS (SELECT DISTINCT x.id, x.neighbor FROM (SELECT source_id AS id, target_id AS neighbor FROM edges UNION ALL SELECT target_id, source_id FROM edges) x JOIN entries e ON e.id = x.neighbor AND e.status <> 'archived')"
_add(
    "related_depth_2", lambda t: graph.related(t.edges, t.entries, t.entries.select("id"), 2), "entries edges",
    f", {_NEAR}, one AS (SELECT DISTINCT s.id AS seed, neighbor AS id FROM entries s JOIN near USING (id) WHERE neighbor <> s.id), two AS (SELECT DISTINCT seed, neighbor AS id FROM one JOIN near USING (id)) SELECT seed, id, 1 AS layer FROM one UNION ALL SELECT seed, id, 2 FROM two WHERE id <> seed AND (seed, id) NOT IN (SELECT seed, id FROM one)",
)
_REACH = """step AS (SELECT DISTINCT source_id AS node, target_id AS next FROM edges JOIN entries e ON e.id = target_id WHERE type IN ('source_refs', 'evidence_refs', 'derived_from')),
walk AS (SELECT id, id AS node, kind, 0 AS depth FROM entries UNION SELECT w.id, s.next, e.kind, w.depth + 1 FROM walk w JOIN step s ON s.node = w.node JOIN entries e ON e.id = s.next WHERE w.kind <> 'source' AND w.depth < 9),
reached AS (SELECT DISTINCT id, node AS source FROM walk WHERE kind = 'source')"""
_GONE = "gone AS (SELECT source_id AS id FROM edges WHERE type = 'superseded_by' UNION SELECT target_id FROM edges WHERE type = 'supersedes')"
_FACTS = f"""{_REACH}, {_GONE}, facts AS (SELECT e.id, count(r.source) AS sources, count(DISTINCT s.source_type) AS diversity,
  coalesce(count(r.source) * count(DISTINCT s.source_type) * avg(CASE WHEN r.source IS NULL THEN NULL WHEN s.captured_at IS NULL OR s.captured_at > DATE '{AS_OF}' THEN 0.5 ELSE pow(0.5, date_diff('day', s.captured_at, DATE '{AS_OF}') / 365.0) END), 0) AS evidence_strength,
  coalesce(avg(CASE WHEN r.source IS NULL THEN NULL WHEN g.id IS NULL THEN 0.0 ELSE 1.0 END), 0) AS drift_score
  FROM entries e LEFT JOIN reached r ON r.id = e.id LEFT JOIN entries s ON s.id = r.source LEFT JOIN gone g ON g.id = r.source GROUP BY 1)"""
_HEAT = f"heat AS (SELECT entry_id, sum(pow(0.5, greatest(0, (epoch(TIMESTAMP '{AS_OF}') - epoch(accessed_at)) / 86400.0) / 30)) AS heat FROM access_log WHERE accessed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAYS GROUP BY 1)"
_RELEVANCE = """relevance AS (SELECT e.id, count(*) FILTER (f.kind IS NOT NULL AND (e.kind = 'concept' AND (r.type = 'evidence_refs' AND f.kind = 'decision' OR r.type = 'depends_on' AND f.kind = 'concept') OR e.kind = 'dossier' AND (r.type = 'evidence_refs' AND f.kind = 'concept' OR r.type = 'related' AND f.kind = 'decision'))) AS action_relevance
  FROM entries e LEFT JOIN edges r ON r.target_id = e.id LEFT JOIN entries f ON f.id = r.source_id GROUP BY 1)"""
_CONTRA = "contra AS (SELECT id, count(*) AS contradicts FROM (SELECT source_id AS id FROM edges WHERE type = 'contradicts' UNION ALL SELECT target_id FROM edges WHERE type = 'contradicts') GROUP BY 1)"
_add("source_reachability", lambda t: graph.reachable_sources(t.entries, t.edges), "entries edges", f", {_REACH} SELECT id, source FROM reached")
_add("unreachable_entries", lambda t: t.entries.select("id").join(graph.reachable_sources(t.entries, t.edges).select("id"), "id", "left_anti"), "entries edges", f", {_REACH} SELECT id FROM entries WHERE id NOT IN (SELECT id FROM reached)")


def _pagerank_sql(rounds: int) -> str:
    parts = [
        "nodes AS (SELECT id FROM entries WHERE status <> 'archived'), total AS (SELECT count(*)::DOUBLE AS n FROM nodes)",
        "live AS (SELECT source_id, target_id FROM edges WHERE source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes))",
        "deg AS (SELECT source_id, count(*) AS d FROM live GROUP BY 1)", "r0 AS (SELECT id, 1 / n AS rank FROM nodes, total)",
    ]
    for i in range(rounds):
        parts.append(f"r{i + 1} AS (SELECT v.id, 0.15 / n + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE id NOT IN (SELECT source_id FROM deg)) / n + 0.85 * coalesce(g.given, 0) AS rank FROM nodes v CROSS JOIN total LEFT JOIN (SELECT target_id, sum(rank / d) AS given FROM live JOIN r{i} ON r{i}.id = live.source_id JOIN deg USING (source_id) GROUP BY 1) g ON g.target_id = v.id)")
    return ", " + ", ".join(parts) + f" SELECT id, round(rank, 9) AS rank FROM r{rounds}"


_add("pagerank_k_iterations", lambda t: graph.pagerank(t.entries, t.edges, 5, tolerance=None).select("id", F.round("rank", 9).alias("rank")), "entries edges", _pagerank_sql(5))
_add("degree", lambda t: graph.degrees(t.entries, t.edges), "entries edges", "SELECT e.id, (SELECT count(*) FROM edges WHERE source_id = e.id) AS out_degree, (SELECT count(*) FROM edges WHERE target_id = e.id) AS in_degree, (SELECT count(*) FROM edges WHERE source_id = e.id) + (SELECT count(*) FROM edges WHERE target_id = e.id) AS degree FROM entries e")
_add("isolated", lambda t: graph.isolated(t.entries, t.edges.where("type = 'supersedes'")), "entries edges", "SELECT id FROM entries WHERE id NOT IN (SELECT source_id FROM edges WHERE type = 'supersedes' UNION SELECT target_id FROM edges WHERE type = 'supersedes')")
_add("supersedes_cycle", lambda t: graph.cycle_members(t.edges), "edges", ", arcs AS (SELECT DISTINCT source_id AS a, target_id AS b FROM edges WHERE type = 'supersedes' AND source_id <> target_id), paths AS (SELECT a, b FROM arcs UNION SELECT p.a, q.b FROM paths p JOIN arcs q ON p.b = q.a) SELECT DISTINCT a AS id FROM paths WHERE a = b")
_DEG = "deg AS (SELECT id FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY 1 HAVING count(*) >= 6 AND id IN (SELECT id FROM entries))"
_add("dense_core", lambda t: graph.dense_core(t.entries, t.edges, 6), "entries edges", f", {_DEG} SELECT source_id, target_id, type FROM edges WHERE source_id IN (SELECT id FROM deg) AND target_id IN (SELECT id FROM deg)")
_add("domain_subgraph", lambda t: graph.domain_subgraph(t.entries.withColumn("domain", F.get("tags", 0)), t.edges, "en"), "entries edges", "SELECT source_id, target_id, type FROM edges WHERE source_id IN (SELECT id FROM entries WHERE tags[1] = 'en') AND target_id IN (SELECT id FROM entries WHERE tags[1] = 'en')")

# --- metrics
_add("evidence_strength", lambda t: _round(metrics.evidence(t.entries, t.edges, AS_OF), "evidence_strength").select("id", "sources", "diversity", "evidence_strength"), "entries edges", f", {_FACTS} SELECT id, sources, diversity, round(evidence_strength, 6) AS evidence_strength FROM facts")
_add("drift_score", lambda t: _round(metrics.evidence(t.entries, t.edges, AS_OF), "drift_score").select("id", "drift_score"), "entries edges", f", {_FACTS} SELECT id, round(drift_score, 6) AS drift_score FROM facts")
_add("compression_ratio", lambda t: metrics.compression_ratio(t.entries, t.edges), "entries edges", "SELECT e.id, count(r.source_id) AS compression_ratio FROM entries e LEFT JOIN edges r ON r.source_id = e.id AND r.type = 'derived_from' GROUP BY 1")
_add("action_relevance", lambda t: metrics.action_relevance(t.entries, t.edges), "entries edges", f", {_RELEVANCE} SELECT id, action_relevance FROM relevance")
_add("retrieval_heat", lambda t: _round(metrics.retrieval_heat(t.access, AS_OF), "heat"), "access_log", f", {_HEAT} SELECT entry_id, round(heat, 6) AS heat FROM heat")
_add(
    "metrics_baseline_percentiles", lambda t: _round(metrics.distribution(metrics.entry_metrics(t.entries, t.edges, t.access, AS_OF), ["evidence_strength", "drift_score", "compression_ratio", "action_relevance", "retrieval_heat"]), "min", "p50", "p90", "p95", "max"), "entries edges access_log",
    f""", {_FACTS}, {_HEAT}, {_RELEVANCE}, long AS (SELECT 'evidence_strength' AS metric, evidence_strength AS v FROM facts UNION ALL SELECT 'drift_score', drift_score FROM facts
    UNION ALL SELECT 'compression_ratio', count(r.source_id) FROM entries e LEFT JOIN edges r ON r.source_id = e.id AND r.type = 'derived_from' GROUP BY e.id
    UNION ALL SELECT 'action_relevance', action_relevance FROM relevance UNION ALL SELECT 'retrieval_heat', coalesce(heat, 0) FROM entries LEFT JOIN heat ON entry_id = id)
    SELECT metric, count(*) AS count, round(min(v), 6) AS min, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.95), 6) AS p95, round(max(v), 6) AS max FROM long GROUP BY 1""",
)


def _after_change(t: Tables) -> DataFrame:
    """The metrics of a base whose every 50th entry had no edges before, worked out from the held ones and what these edges touch."""
    entries, edges, access = t.entries, graph.cut(t.edges), t.access
    changed = entries.where("n % 50 = 7").select("id")
    old = edges.join(changed.withColumnRenamed("id", "source_id"), "source_id", "left_anti").select(*edges.columns)
    held = graph.cut(metrics.entry_metrics(entries, old, access, AS_OF))
    return _round(metrics.updated_metrics(held, changed, entries, edges, old, access, AS_OF), "evidence_strength", "drift_score", "retrieval_heat")


_add(
    "metrics_after_change", _after_change, "entries edges access_log",
    f""", {_FACTS}, {_HEAT}, {_RELEVANCE}, derived AS (SELECT source_id AS id, count(*) AS n FROM edges WHERE type = 'derived_from' GROUP BY 1)
    SELECT f.id, sources, diversity, round(evidence_strength, 6) AS evidence_strength, round(drift_score, 6) AS drift_score, coalesce(d.n, 0) AS compression_ratio, action_relevance, round(coalesce(heat, 0), 6) AS retrieval_heat
    FROM facts f LEFT JOIN derived d USING (id) JOIN relevance USING (id) LEFT JOIN heat ON entry_id = f.id""",
)
_add(
    "length_distribution", lambda t: _round(filters.length_distribution(t.entries), "p50", "p90", "p99", "rejected"), "entries",
    "SELECT kind, round(quantile_cont(length(body), 0.5), 6) AS p50, round(quantile_cont(length(body), 0.9), 6) AS p90, round(quantile_cont(length(body), 0.99), 6) AS p99, round(avg(CASE WHEN length(body) < 50 THEN 1.0 ELSE 0 END), 6) AS rejected, CASE WHEN avg(CASE WHEN length(body) < 50 THEN 1.0 ELSE 0 END) = 0 THEN 'ok' WHEN avg(CASE WHEN length(body) < 50 THEN 1.0 ELSE 0 END) <= 0.02 THEN 'tolerable' ELSE 'high' END AS verdict FROM entries GROUP BY 1",
)


# --- rules
def _facts(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    entries, edges = t.entries, t.edges
    reached = graph.reachable_sources(entries, edges)
    return entries, edges, metrics.evidence(entries, edges, AS_OF, reached)


def _rule(name: str, severity: str, run: Callable[[Tables], DataFrame], needs: str, ctes: str, select: str, message: str = "''") -> None:
    sql = f"{', ' + ctes if ctes else ''} SELECT '{name}' AS rule_id, '{severity}' AS severity, x.id AS target_id, {message} AS message FROM ({select}) x"
    _add(f"rule_{name}", run, needs, sql)


_EV, _EVA = "entries edges", "entries edges access_log"
_rule("redline_9_source_reachability", "high", lambda t: rules.source_reachability(t.entries, graph.reachable_sources(t.entries, t.edges)), _EV, _REACH, "SELECT id FROM entries WHERE kind <> 'view' AND id NOT IN (SELECT id FROM reached)")
_rule("redline_10_view_as_evidence", "high", lambda t: rules.view_as_evidence(t.entries, t.edges), _EV, "", "SELECT DISTINCT source_id AS id, target_id FROM edges JOIN entries s ON s.id = source_id AND s.kind <> 'view' JOIN entries v ON v.id = target_id AND v.kind = 'view'", "x.target_id")
_rule("decay_source_context", "medium", lambda t: rules.source_context(t.entries, t.edges), _EV, _GONE, "SELECT id FROM entries WHERE kind = 'source' AND id IN (SELECT id FROM gone)")
_rule("decay_dossier_outdated", "medium", lambda t: rules.dossier_outdated(*[(e, f, graph.reachable_sources(e, g)) for e, g, f in [_facts(t)]][0]), _EV, _FACTS, "SELECT e.id FROM entries e JOIN facts USING (id) WHERE kind = 'dossier' AND (drift_score >= 0.5 OR EXISTS (SELECT 1 FROM reached r JOIN entries s ON s.id = r.source WHERE r.id = e.id AND coalesce(s.captured_at, s.updated_at) > e.updated_at))")
for _name, _stable in (("decay_concept_evidence_singular", False), ("push_pseudo_stable", True)):
    _rule(_name, "medium", lambda t, s=_stable: rules.evidence_singular(*_facts(t), s), _EV, _FACTS, "SELECT id FROM entries JOIN facts USING (id) WHERE kind = 'concept' AND diversity < 2 AND id IN (SELECT source_id FROM edges WHERE type = 'evidence_refs')" + " AND freshness = 'stable'" * _stable)
_rule("structure_fossil_concept", "medium", lambda t: rules.fossil_concept(t.entries, _facts(t)[2], metrics.action_relevance(t.entries, t.edges), 1), _EV, f"{_FACTS}, {_RELEVANCE}", "SELECT id FROM entries JOIN facts USING (id) JOIN relevance USING (id) WHERE kind = 'concept' AND evidence_strength < 1 AND action_relevance >= 1")
_rule("structure_monoculture_evidence", "medium", lambda t: rules.monoculture(t.entries, _facts(t)[2]), _EV, _FACTS, "SELECT id FROM entries JOIN facts USING (id) WHERE kind IN ('dossier', 'concept', 'decision') AND sources >= 2 AND diversity < 2")
_rule("action_demote", "medium", lambda t: rules.demote(*_facts(t)), _EV, f"{_FACTS}, {_CONTRA}", "SELECT id FROM entries JOIN facts USING (id) LEFT JOIN contra USING (id) WHERE kind IN ('concept', 'dossier', 'decision') AND (drift_score >= 0.5 OR contradicts >= 2)")
_rule("action_retract", "high", lambda t: rules.retract(*_facts(t)), _EV, _FACTS, "SELECT id FROM entries JOIN facts USING (id) WHERE kind = 'decision' AND decision_status = 'active' AND (drift_score >= 1 OR id IN (SELECT source_id FROM edges WHERE type = 'evidence_refs' AND target_id IN (SELECT id FROM gone)))")
_rule("push_premise_shaken", "high", lambda t: rules.premise_shaken(*_facts(t), metrics.retrieval_heat(t.access, AS_OF)), _EVA, f"{_FACTS}, {_HEAT}", "SELECT id FROM entries JOIN facts USING (id) JOIN heat ON entry_id = id WHERE kind = 'decision' AND decision_status = 'active' AND heat >= 3 AND (drift_score >= 0.75 OR id IN (SELECT source_id FROM edges WHERE type = 'evidence_refs' AND target_id IN (SELECT id FROM gone UNION SELECT id FROM entries WHERE freshness = 'volatile')))")
_rule("push_crystallize", "medium", lambda t: rules.crystallize(t.entries, t.edges), _EV, "n1 AS (SELECT DISTINCT id, unnest(tags) AS tag FROM entries WHERE kind = 'note' AND id NOT IN (SELECT target_id FROM edges WHERE type = 'derived_from'))", "SELECT min(id) AS id, tag || ':' || count(*) || ':' || array_to_string(list_slice(list(id ORDER BY id), 1, 3), ',') AS m FROM n1 WHERE tag IS NOT NULL GROUP BY tag HAVING count(*) >= 3", "x.m")
_rule("push_internal_split", "medium", lambda t: rules.internal_split(t.entries, t.edges), _EV, _CONTRA, "SELECT id FROM entries JOIN contra USING (id) WHERE kind = 'concept' AND contradicts >= 2")
_rule("push_cognitive_divergence", "medium", lambda t: rules.divergence(t.entries, _facts(t)[2], metrics.retrieval_heat(t.access, AS_OF)), _EVA, f"{_FACTS}, {_HEAT}", "SELECT id FROM entries JOIN facts USING (id) JOIN heat ON entry_id = id WHERE kind = 'dossier' AND drift_score >= 0.7 AND heat >= 2")
_rule("structure_supersedes_cycle", "medium", lambda t: rules.supersedes_cycle(t.edges), "edges", "arcs AS (SELECT DISTINCT source_id AS a, target_id AS b FROM edges WHERE type = 'supersedes' AND source_id <> target_id), paths AS (SELECT a, b FROM arcs UNION SELECT p.a, q.b FROM paths p JOIN arcs q ON p.b = q.a)", "SELECT DISTINCT a AS id FROM paths WHERE a = b")
_rule("action_merge", "medium", lambda t: rules.merge(t.entries, t.edges), _EV, "own AS (SELECT id, kind, search_terms AS s FROM entries WHERE kind NOT IN ('source', 'view') AND len(search_terms) > 0)", "SELECT a.id, b.id AS other FROM own a JOIN own b ON a.kind = b.kind AND a.id < b.id WHERE len(list_intersect(a.s, b.s)) >= 0.5 * len(list_distinct(list_concat(a.s, b.s))) AND (a.id, b.id) NOT IN (SELECT source_id, target_id FROM edges UNION SELECT target_id, source_id FROM edges)", "x.other")
_PROMOTED = " UNION ALL ".join(f"SELECT id, '{to}' AS m FROM entries JOIN facts USING (id) JOIN relevance USING (id) WHERE kind = '{kind}' AND evidence_strength >= {strength} AND action_relevance >= {relevance}" + " AND id IN (SELECT source_id FROM edges WHERE type = 'evidence_refs')" * refs for kind, to, strength, relevance, refs in rules.PROMOTIONS)
_rule("promotion_signal", "medium", lambda t: rules.promotion_signal(*_facts(t), metrics.action_relevance(t.entries, t.edges)), _EV, f"{_FACTS}, {_RELEVANCE}", _PROMOTED, "x.m")

# --- text functions
_add("ascii_mask", lambda t: t.entries.select("id", text.ascii_mask(F.col("title")).alias("masked")), "entries", "SELECT id, regexp_replace(title, '[^\\x00-\\x7F]', ' ', 'g') AS masked FROM entries")
_add("slug", lambda t: t.entries.select("id", text.slug(F.col("title")).alias("slug")), "entries", "SELECT id, nullif(rtrim(left(trim(regexp_replace(regexp_replace(title, '[^0-9A-Za-z-]', '-', 'g'), '-+', '-', 'g'), '-'), 40), '-'), '') AS slug FROM entries")
_add("content_hash", lambda t: t.entries.select("id", text.content_hash(F.col("title"), F.array_join("tags", "|"), F.col("body")).alias("hash")), "entries", "SELECT id, left(sha256(concat_ws(chr(10), title, array_to_string(tags, '|'), body)), 16) AS hash FROM entries")
_add("freshness_decay", lambda t: _round(t.entries.select("id", metrics.freshness_score(F.col("captured_at"), AS_OF).alias("score")), "score"), "entries", f"SELECT id, round(CASE WHEN captured_at IS NULL OR captured_at > DATE '{AS_OF}' THEN 0.5 ELSE pow(0.5, date_diff('day', captured_at, DATE '{AS_OF}') / 365.0) END, 6) AS score FROM entries")
_add("review_due_at", lambda t: t.entries.where("kind = 'dossier'").select("id", filters.review_date(F.col("reviewed_at"), F.col("freshness")).alias("due")), "entries", "SELECT id, review_due_at AS due FROM entries WHERE kind = 'dossier'")
_add("trigrams", lambda t: t.entries.select("id", F.explode(text.trigrams(F.col("title"))).alias("gram")), "entries", "SELECT id, unnest(CASE WHEN length(title) = 0 THEN [] WHEN length(title) <= 3 THEN [title] ELSE [substring(title, i, 3) FOR i IN range(1, length(title) - 1)] END) AS gram FROM entries")
_LINES = r"[trim(regexp_replace(regexp_replace(s, '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[*_`]', '', 'g')) FOR s IN string_split(body, chr(10))]"
_READABLE = rf"[r FOR r IN {_LINES} IF length(r) >= 4 AND NOT regexp_matches(r, '^(#|\||>|```|[-+*] |\d+\. )')]"
_add("summary_line", lambda t: t.entries.select("id", analytics.summary_line(F.col("body")).alias("line")), "entries", f"SELECT id, left(({_READABLE})[1], 88) AS line FROM entries")

# --- retrieval
_add("exact_match", lambda t: search.exact(t.entries, "The", True), "entries", "SELECT id, CASE WHEN list_contains(aliases, 'the') THEN 90.0 WHEN lower(title) = 'the' THEN 80.0 WHEN list_contains(search_terms, 'the') THEN 75.0 WHEN instr(lower(title), 'the') > 0 THEN 55.0 END AS score FROM entries WHERE list_contains(aliases, 'the') OR lower(title) = 'the' OR list_contains(search_terms, 'the') OR instr(lower(title), 'the') > 0")
_SEEDS = "seeds AS (SELECT id, (n % 5 + 1)::DOUBLE AS score FROM entries WHERE n % 20 = 0)"
_add("graph_expand", lambda t: search.expand(t.edges, t.entries, t.entries.where("n % 20 = 0").select("id", (F.col("n") % 5 + 1).cast("double").alias("score"))), "entries edges", f", {_SEEDS} SELECT x.id, max(score) * 0.5 AS score FROM (SELECT source_id AS seed, target_id AS id FROM edges UNION ALL SELECT target_id, source_id FROM edges) x JOIN seeds s ON s.id = seed JOIN entries e ON e.id = x.id AND e.status <> 'archived' WHERE x.id NOT IN (SELECT id FROM seeds) GROUP BY 1")
_add("authority_boost", lambda t: _round(search.boost(t.entries.select("id", (F.col("n") % 5 + 1).cast("double").alias("score")), t.authority), "score"), "entries", f", every AS (SELECT id, (n % 5 + 1)::DOUBLE AS score FROM entries), {_AUTHORITY} SELECT id, round(score * (1 + 0.3 * authority / (SELECT max(authority) FROM authority)), 6) AS score FROM every JOIN authority USING (id)")
_add("snippet", lambda t: t.entries.select("id", text.snippet(F.col("title"), F.col("body"), ["tion", "und"]).alias("snippet")), "entries", "SELECT id, trim(CASE WHEN instr(lower(b), 'tion') > 0 THEN substring(b, greatest(instr(lower(b), 'tion') - 24, 1), instr(lower(b), 'tion') + 40 - greatest(instr(lower(b), 'tion') - 24, 1)) WHEN instr(lower(b), 'und') > 0 THEN substring(b, greatest(instr(lower(b), 'und') - 24, 1), instr(lower(b), 'und') + 39 - greatest(instr(lower(b), 'und') - 24, 1)) ELSE left(b, 96) END) AS snippet FROM (SELECT id, coalesce(nullif(body, ''), title) AS b FROM entries)")

# --- vectors
_VECTORS = "v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings)"


def _dense(t: Tables) -> DataFrame:
    vectors = t.read("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    query = list(vectors.where("id = 7").first()["embedding"])
    return _round(search.nearest(vectors, query, 20), "score")


_add("dense_topk", _dense, "", f"WITH {_VECTORS} SELECT vec_id AS id, round(1.5 * list_cosine_similarity(e, (SELECT e FROM v WHERE vec_id = 7)), 6) AS score FROM v WHERE list_cosine_similarity(e, (SELECT e FROM v WHERE vec_id = 7)) > 0 ORDER BY list_cosine_similarity(e, (SELECT e FROM v WHERE vec_id = 7)) DESC, vec_id LIMIT 20")

# --- dashboards
_LANES = {"lane_order": ("kind", "authority DESC, id"), "timeline_order": ("freshness", "status, authority DESC, id"), "domain_order": ("domain", "authority DESC, id")}
for _name, (_group, _order) in _LANES.items():
    _add(
        _name, lambda t, g=_group, s="status" in _order: analytics.placed(t.entries.join(t.authority, "id"), g, *([F.col("status")] if s else []), F.desc("authority"), F.col("id")).select("id", g, "place"), "entries",
        f", {_AUTHORITY} SELECT id, {_group}, CAST(row_number() OVER (PARTITION BY {_group} ORDER BY {_order}) AS INTEGER) AS place FROM entries JOIN authority USING (id)",
    )
_add("top_authority_per_kind", lambda t: analytics.top_per_group(t.entries.join(t.authority, "id"), "kind", 10, F.desc("authority"), F.col("id")).select("id", "kind", "place"), "entries", f", {_AUTHORITY} SELECT * FROM (SELECT id, kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY authority DESC, id) AS INTEGER) AS place FROM entries JOIN authority USING (id)) WHERE place <= 10")
_add("domain_kind_shares", lambda t: _round(analytics.kind_shares(t.entries), "share"), "entries", "SELECT coalesce(nullif(domain, ''), '_unsorted') AS domain, kind, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY coalesce(nullif(domain, ''), '_unsorted')), 6) AS share FROM entries GROUP BY 1, 2")
_add("theme_map", lambda t: _round(analytics.theme_map(t.entries, t.authority), "mean_authority"), "entries", f", {_AUTHORITY} SELECT coalesce(nullif(domain, ''), '_unsorted') AS domain, count(*) AS n, round(avg(authority), 6) AS mean_authority FROM entries JOIN authority USING (id) GROUP BY 1")
_add("cross_domain_edges", lambda t: analytics.cross_domain(t.entries, t.edges), "entries edges", "SELECT least(a.domain, b.domain) AS left_domain, greatest(a.domain, b.domain) AS right_domain, count(*) AS n FROM edges JOIN entries a ON a.id = source_id JOIN entries b ON b.id = target_id WHERE a.domain <> '' AND b.domain <> '' AND a.domain <> b.domain GROUP BY 1, 2")
_add("rel_summary", lambda t: analytics.relation_summary(t.entries, t.edges), "entries edges", "SELECT x.id, direction, type, count(*) AS n, array_to_string(list_slice(list(other ORDER BY other), 1, 3), ',') AS first_ids FROM (SELECT source_id AS id, 'out' AS direction, type, target_id AS other FROM edges UNION ALL SELECT target_id, 'in', type, source_id FROM edges) x JOIN entries e ON e.id = x.id GROUP BY 1, 2, 3")
_add("graph_stats", lambda t: _round(analytics.graph_stats(t.entries, t.edges, t.authority), "least", "most", "mean"), "entries edges", f", {_AUTHORITY} SELECT count(*) AS nodes, count(*) FILTER (id NOT IN (SELECT source_id FROM edges UNION SELECT target_id FROM edges)) AS isolated, round(min(authority), 6) AS least, round(max(authority), 6) AS most, round(avg(authority), 6) AS mean, (SELECT count(*) FROM edges) AS edges FROM entries JOIN authority USING (id)")
_add(
    "health_report", lambda t: _round(analytics.health(t.entries, t.edges, t.authority), "connectivity", "concentration", "maturity", "drafts"), "entries edges",
    f""", {_AUTHORITY}, f AS (SELECT avg(CASE WHEN id IN (SELECT source_id FROM edges UNION SELECT target_id FROM edges) THEN 1.0 ELSE 0 END) AS c, avg(CASE WHEN status IN ('active', 'authoritative') THEN 1.0 ELSE 0 END) AS m, avg(CASE WHEN status = 'draft' THEN 1.0 ELSE 0 END) AS d, sum(authority) AS s FROM entries JOIN authority USING (id)),
    top AS (SELECT sum(authority) AS a FROM (SELECT authority FROM authority ORDER BY authority DESC, id LIMIT 5))
    SELECT round(c, 6) AS connectivity, round(a / s, 6) AS concentration, round(m, 6) AS maturity, round(d, 6) AS drafts, CASE WHEN c >= 0.9 THEN 'A' WHEN c >= 0.75 THEN 'B' WHEN c >= 0.6 THEN 'C' WHEN c >= 0.4 THEN 'D' ELSE 'E' END AS connectivity_grade, CASE WHEN m >= 0.7 THEN 'A' WHEN m >= 0.55 THEN 'B' WHEN m >= 0.4 THEN 'C' WHEN m >= 0.2 THEN 'D' ELSE 'E' END AS maturity_grade FROM f, top""",
)
_add("derive_counts", lambda t: t.edges.where("type = 'derived_from'").select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit("source").alias("side")), F.struct(F.col("target_id").alias("id"), F.lit("target").alias("side")))).alias("x")).groupBy("x.id", "x.side").agg(F.count("*").alias("n")), "edges", "SELECT id, side, count(*) AS n FROM (SELECT source_id AS id, 'source' AS side FROM edges WHERE type = 'derived_from' UNION ALL SELECT target_id, 'target' FROM edges WHERE type = 'derived_from') GROUP BY 1, 2")

_add("confidence_values", lambda t: t.entries.select("id", analytics.confidence_value(F.col("confidence")).alias("value")), "entries", "SELECT id, CASE confidence WHEN 'high' THEN 0.85 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.25 ELSE 0.15 END AS value FROM entries")
_add("authority_scales", lambda t: _round(t.authority.select("id", *analytics.authority_scales(F.col("authority"))), "size", "percent", "norm"), "entries", f", {_AUTHORITY} SELECT id, round(8 + 10 * sqrt(authority), 6) AS size, greatest(round(authority * 100), 3) AS percent, round(authority, 6) AS norm FROM authority")
_add("dashboard_verdicts", lambda t: analytics.verdicts(t.entries), "entries", ", f AS (SELECT avg(CASE WHEN status IN ('active', 'authoritative') THEN 1.0 ELSE 0 END) AS m, avg(CASE WHEN freshness = 'volatile' THEN 1.0 ELSE 0 END) AS v, count(*) AS total FROM entries), top AS (SELECT kind, count(*) AS n FROM entries GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) SELECT CASE WHEN n >= 0.5 * total THEN kind END AS dominant, CASE WHEN m >= 0.7 THEN 'mature' WHEN m >= 0.4 THEN 'growing' ELSE 'young' END AS maturity, CASE WHEN v <= 0.2 THEN 'calm' WHEN v <= 0.6 THEN 'mixed' ELSE 'restless' END AS freshness FROM f, top")
_add("orphan_domains", lambda t: analytics.orphan_domains(t.entries, t.edges.where("type = 'superseded_by'")), "entries edges", ", x AS (SELECT a.domain AS p, b.domain AS q FROM edges JOIN entries a ON a.id = source_id JOIN entries b ON b.id = target_id WHERE type = 'superseded_by' AND a.domain <> '' AND b.domain <> '' AND a.domain <> b.domain) SELECT DISTINCT domain FROM entries WHERE domain <> '' AND domain NOT IN (SELECT p FROM x UNION SELECT q FROM x)")
_add("backlinks", lambda t: analytics.backlinks(t.edges), "edges", "SELECT target_id AS id, type, count(*) AS n FROM edges GROUP BY 1, 2")
_add("promotion_chain_links", lambda t: analytics.chain_links(t.entries, t.edges, CHAIN), "entries edges", ", p AS (SELECT id, CASE kind WHEN 'note' THEN 1 WHEN 'concept' THEN 2 WHEN 'decision' THEN 3 WHEN 'dossier' THEN 4 END AS p FROM entries) SELECT source_id, target_id, a.p AS from_place, b.p AS to_place FROM edges JOIN p a ON a.id = source_id JOIN p b ON b.id = target_id WHERE type = 'derived_from' AND a.p IS NOT NULL AND b.p IS NOT NULL")
_add("alias_holders", lambda t: rules.alias_holders(t.entries), "entries", ", h AS (SELECT DISTINCT id, unnest(aliases) AS alias FROM entries WHERE status <> 'archived'), f AS (SELECT alias, min(id) AS representative FROM h GROUP BY 1 HAVING count(*) > 1) SELECT alias, representative, id AS member FROM h JOIN f USING (alias)")
_add("semantic_candidates", lambda t: _round(rules.semantic_candidates(t.read("embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("kind"), "embedding"), t.read("embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("id")), 0.1), "similarity"), "", f"WITH {_VECTORS} SELECT id, candidate, round(s, 6) AS similarity FROM (SELECT a.vec_id AS id, b.vec_id AS candidate, list_cosine_similarity(a.e, b.e) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.vec_id) AS place FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.vec_id % 20 = 0 WHERE list_cosine_similarity(a.e, b.e) >= 0.1) WHERE place <= 10")
_rule(
    "missing_relation_hint", "medium", lambda t: rules.missing_relation_hint(t.entries, t.edges), _EV,
    """own AS MATERIALIZED (SELECT id, search_terms, [x FOR x IN tags IF x IS NOT NULL] AS tags FROM entries WHERE kind <> 'source' AND status <> 'archived'),
    held AS MATERIALIZED (SELECT DISTINCT id, unnest(search_terms) AS term FROM own), met AS MATERIALIZED (SELECT DISTINCT a.id, b.id AS other FROM held a JOIN held b USING (term) WHERE a.id <> b.id),
    linked AS MATERIALIZED (SELECT source_id AS id, target_id AS other FROM edges UNION SELECT target_id, source_id FROM edges),
    pairs AS (SELECT m.id, m.other FROM met m JOIN own a ON a.id = m.id JOIN own b ON b.id = m.other WHERE list_has_any(a.tags, b.tags) AND NOT EXISTS (SELECT 1 FROM linked l WHERE l.id = m.id AND l.other = m.other))""",
    "SELECT id, count(*) AS n FROM pairs GROUP BY 1 HAVING count(*) >= 2", "CAST(x.n AS VARCHAR)",
)

# --- retrieval quality
_RESULTS = "results AS (SELECT label AS query, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INTEGER) AS place, vec_id AS id FROM embeddings), grades AS (SELECT label AS query, vec_id AS id, CAST(vec_id % 4 AS INTEGER) AS grade FROM embeddings WHERE vec_id % 3 = 0)"


def _judgements(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.read("embeddings").select(F.col("label").alias("query"), F.col("vec_id").alias("id"))
    return analytics.placed(rows, "query", F.col("id")), rows.where("id % 3 = 0").withColumn("grade", (F.col("id") % 4).cast("int"))


_add("eval_recall_mrr", lambda t: _round(analytics.recall_mrr(_judgements(t)[0], _judgements(t)[1]), "recall", "mrr"), "", f"WITH {_RESULTS} SELECT g.query, round(count(DISTINCT CASE WHEN r.place <= 10 THEN g.id END) / count(DISTINCT g.id)::DOUBLE, 6) AS recall, round(coalesce(1.0::DOUBLE / min(CASE WHEN r.place <= 10 THEN r.place END), 0), 6) AS mrr FROM grades g LEFT JOIN results r ON r.query = g.query AND r.id = g.id GROUP BY 1")
_add("eval_ndcg", lambda t: _round(analytics.ndcg(*_judgements(t)), "ndcg"), "", f"WITH {_RESULTS}, best AS (SELECT query, sum((pow(2, grade) - 1) / log2(place + 1)) AS ideal FROM (SELECT query, grade, row_number() OVER (PARTITION BY query ORDER BY grade DESC, id) AS place FROM grades) WHERE place <= 10 GROUP BY 1), got AS (SELECT query, sum((pow(2, grade) - 1) / log2(place + 1)) AS dcg FROM results JOIN grades USING (query, id) WHERE place <= 10 GROUP BY 1) SELECT query, round(CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END, 6) AS ndcg FROM best LEFT JOIN got USING (query)")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused search over a data set's documents."""
    return _QUERIES["search_fused"].run(Tables(spark, sf_dir))


# --- near titles; DuckDB counts bytes, so both sides spell other than ASCII as '?', and cut titles short, so that some are near
_ASCII_TITLES = "plain AS (SELECT kind, title, min(id) AS id FROM (SELECT id, kind, left(regexp_replace(title, '[^\\x00-\\x7F]', '?', 'g'), 8) || n % 7 AS title FROM entries) WHERE kind <> 'source' AND title <> '' GROUP BY 1, 2)"
_add("duplicate_candidates", lambda t: titles.duplicate_candidates(t.entries), "entries")
_add("title_members", lambda t: titles.members(t.entries), "entries", "SELECT id, first AS representative FROM (SELECT id, min(id) OVER (PARTITION BY kind, title) AS first, count(*) OVER (PARTITION BY kind, title) AS n FROM entries WHERE kind <> 'source' AND title <> '') WHERE n > 1")
_add(
    "near_titles_by_edits", lambda t: titles.near_titles(t.entries.withColumn("title", F.concat(F.substring(F.regexp_replace("title", "[^\\x00-\\x7F]", "?"), 1, 8), F.col("n") % 7))).where("edits is not null").select("kind", "left_id", "right_id", "edits"), "entries",
    f", {_ASCII_TITLES} SELECT a.kind, a.id AS left_id, b.id AS right_id, CAST(levenshtein(a.title, b.title) AS INTEGER) AS edits FROM plain a JOIN plain b ON a.kind = b.kind AND a.id < b.id AND a.title <> b.title WHERE levenshtein(a.title, b.title) <= 2 AND greatest(length(a.title), length(b.title)) >= 4",
)
more_queries.register(_add, _round)
search_queries.register(_add, _round, _AUTHORITY)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, q=q: q.run(Tables(spark, sf_dir))) for name, q in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: (views.oracle_prelude(*q.views) + " " if q.views else "") + q.sql for name, q in _QUERIES.items() if q.sql}
