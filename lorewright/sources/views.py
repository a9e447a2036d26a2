"""The knowledge-base tables seen over the driver's tables, as SQL text that Spark and DuckDB both run.

Every operator takes plain DataFrames of these shapes; this module only maps the test tables onto them, once for both
engines. Ids are 'e' and eight digits; dates are arithmetic on the id, so nothing depends on today.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31"

_DIALECTS = {
    "spark": {
        "words": r"filter(split(text, '[ \\t\\n\\r]+'), w -> w <> '')",
        "lower_words": "transform(words, w -> lower(w))",
        "slice": "slice", "join": "array_join", "distinct": "array_sort(array_distinct({x}))", "list": "array", "size": "size", "at": "get({x}, {i} - 1)",
    },
    "duck": {
        "words": r"[w FOR w IN string_split_regex(text, '[ \t\n\r]+') IF w <> '']",
        "lower_words": "[lower(w) FOR w IN words]",
        "slice": "list_slice", "join": "array_to_string", "distinct": "list_sort(list_distinct({x}))", "list": "list_value", "size": "len", "at": "({x})[{i}]",
    },
}

_RAW = "SELECT doc_id AS n, text, lang, source, {words} AS words FROM documents"

_ENTRIES = """
SELECT 'e' || lpad(CAST(n AS STRING), 8, '0') AS id, n,
  CASE n % 6 WHEN 0 THEN 'source' WHEN 1 THEN 'note' WHEN 2 THEN 'dossier' WHEN 3 THEN 'concept' WHEN 4 THEN 'decision' ELSE 'view' END AS kind,
  CASE n % 7 WHEN 0 THEN 'draft' WHEN 1 THEN 'active' WHEN 2 THEN 'authoritative' WHEN 3 THEN 'legacy' WHEN 4 THEN 'deprecated' WHEN 5 THEN 'archived' ELSE 'active' END AS status,
  CASE n % 3 WHEN 0 THEN 'stable' WHEN 1 THEN 'watch' ELSE 'volatile' END AS freshness,
  CASE n % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS confidence,
  CASE WHEN n % 11 = 0 THEN NULL WHEN n % 13 = 0 THEN '' ELSE source END AS domain,
  {join}({slice}(words, 1, 4), ' ') AS title, text AS body,
  lower({join}({slice}(words, 1, 3), '-')) AS slug,
  DATE '2023-01-01' + CAST(n % 365 AS INT) AS created_at,
  DATE '2023-01-01' + CAST(n % 365 + n % 90 AS INT) AS updated_at,
  {aliases} AS aliases, {list}(lang, source) AS tags, {terms} AS search_terms,
  'entries/' || CAST(n % 50 AS STRING) || '/' || CAST(n AS STRING) || '.md' AS file_path,
  CASE WHEN n % 6 = 0 THEN CASE n % 5 WHEN 0 THEN 'web' WHEN 1 THEN 'doc' WHEN 2 THEN 'media' WHEN 3 THEN 'import' ELSE 'github_release' END END AS source_type,
  CASE WHEN n % 6 = 0 AND n % 13 <> 0 THEN DATE '2023-06-01' + CAST(n % 400 AS INT) END AS captured_at,
  CASE WHEN n % 6 = 0 THEN CASE WHEN n % 30 = 0 THEN 'ftp://x/' ELSE 'https://x/' END || CAST(n AS STRING) END AS source_url,
  CASE WHEN n % 6 = 0 AND n % 4 = 0 THEN 'owner/repo' || CAST(n % 9 AS STRING) END AS watch_target,
  CASE WHEN n % 6 = 2 THEN DATE '2023-09-01' + CAST(n % 120 AS INT) END AS reviewed_at,
  CASE WHEN n % 6 = 2 THEN DATE '2023-09-01' + CAST(n % 120 + CASE n % 3 WHEN 0 THEN 180 WHEN 1 THEN 30 ELSE 7 END AS INT) END AS review_due_at,
  CASE WHEN n % 6 = 4 THEN CASE WHEN n % 12 = 4 THEN 'active' ELSE 'superseded' END END AS decision_status
FROM raw
"""

_E = "'e' || lpad(CAST({x} AS STRING), 8, '0')"
_TYPE = "CASE n % 11 WHEN 0 THEN 'derived_from' WHEN 1 THEN 'related' WHEN 2 THEN 'supersedes' WHEN 3 THEN 'applied_in' WHEN 4 THEN 'evidence_for' WHEN 5 THEN 'part_of' WHEN 6 THEN 'contradicts' WHEN 7 THEN 'depends_on' WHEN 8 THEN 'derived_from' WHEN 9 THEN 'contradicts' ELSE 'mystery' END"
_ORIGIN = "CASE n % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'ai_suggested' ELSE 'ai_confirmed' END"


def _edges() -> str:
    legs = [
        ("(n * 7 + 3) % total", _TYPE, _ORIGIN, "TRUE"),
        ("(n * 13 + 5) % total", "'related'", _ORIGIN, "n % 4 = 0"),
        ("(n + 30) % total", "'supersedes'", "'confirmed'", "n % 30 = 12"),
        ("(n + total - 30) % total", "'supersedes'", "'confirmed'", "n % 60 = 42"),
        ("n + total", "'related'", _ORIGIN, "n % 97 = 0"),
        ("n - 1", "'source_refs'", "'confirmed'", "n % 6 = 1"),
        ("n - 1", "'evidence_refs'", "'confirmed'", "n % 6 IN (2, 3, 4) AND n % 5 <> 0"),
        ("n - 3", "'evidence_refs'", "'confirmed'", "n % 6 = 3 AND n % 4 = 1"),
        ("n - 2", "'evidence_refs'", "'confirmed'", "n % 6 = 2 AND n % 8 = 0"),
        ("(n + 6) % total", "'superseded_by'", "'confirmed'", "n % 12 = 10"),
        ("n + 1", "'derived_from'", "'confirmed'", "n % 18 = 2 AND n + 1 < total"),
    ]
    return "SELECT DISTINCT * FROM (" + " UNION ALL ".join(
        f"SELECT {_E.format(x='n')} AS source_id, {_E.format(x=target)} AS target_id, {kind} AS type, {origin} AS origin FROM ids WHERE {where}" for target, kind, origin, where in legs
    ) + ") legs"


_ACCESS = "SELECT 'e' || lpad(CAST(user_id AS STRING), 8, '0') AS entry_id, event_type AS op, ts AS accessed_at FROM events"
_QUEUE = """
SELECT 'mq' || CAST(event_id AS STRING) AS id, 'rule_' || event_type AS rule_id, 'e' || lpad(CAST(user_id AS STRING), 8, '0') AS entry_id,
  CASE event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'warning' END AS severity,
  CASE event_id % 4 WHEN 0 THEN 'push' WHEN 1 THEN 'digest' ELSE 'log' END AS channel,
  CASE event_id % 5 WHEN 0 THEN 'sent' WHEN 1 THEN 'resolved' WHEN 2 THEN 'dismissed' ELSE 'pending' END AS status,
  CASE event_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'diagnose' ELSE 'autonomous' END AS origin,
  'agent' || CAST(event_id % 6 AS STRING) AS agent_id, props AS details_json, ts AS created_at
FROM events
"""


def _sql(dialect: str) -> dict[str, str]:
    d = _DIALECTS[dialect]
    at = lambda i: d["at"].format(x="words", i=i)
    distinct = lambda x: d["distinct"].format(x=x)
    lower = d["lower_words"]
    aliases = distinct(f"{d['slice']}({lower}, 2, {'2' if dialect == 'spark' else '3'})")
    terms = distinct(f"{d['slice']}({lower}, 1, 8)")
    entries = _ENTRIES.format(join=d["join"], slice=d["slice"], list=d["list"], aliases=aliases, terms=terms, at=at)
    return {"raw": _RAW.format(words=d["words"]), "entries": entries, "edges": _edges(), "access_log": _ACCESS, "queue": _QUEUE}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _run(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    for name in tables:
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(text, **tables)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _run(spark, _sql("spark")["raw"], documents=_read(spark, sf_dir, "documents"))
    return _run(spark, _sql("spark")["entries"], raw=raw)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _read(spark, sf_dir, "documents").selectExpr("doc_id AS n")
    total = (ids.agg({"n": "max"}).first()[0] or 0) + 1
    return _run(spark, _edges().replace("total", str(total)), ids=ids)


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, _ACCESS, events=_read(spark, sf_dir, "events"))


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, _QUEUE, events=_read(spark, sf_dir, "events"))


def oracle_prelude(*names: str) -> str:
    """WITH RECURSIVE clause for DuckDB that defines the named views (entries, edges, access_log, queue)."""
    sql = _sql("duck")
    parts = []
    if "entries" in names:
        parts += [("raw", sql["raw"]), ("entries", sql["entries"])]
    if "edges" in names:
        total = "(SELECT max(doc_id) + 1 FROM documents)"
        parts += [("ids", f"SELECT doc_id AS n, {total} AS total FROM documents"), ("edges", sql["edges"])]
    parts += [(k, sql[k]) for k in ("access_log", "queue") if k in names]
    return "WITH RECURSIVE " + ", ".join(f"{k} AS ({v})" for k, v in parts)
