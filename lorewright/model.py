"""Schemas, enumerations and constants of the knowledge base."""

from __future__ import annotations

#: Names as the files have them (fixed values).
KINDS = ("source", "note", "dossier", "concept", "decision", "view")
STATUSES = ("draft", "active", "authoritative", "legacy", "deprecated", "archived")
FRESHNESS = ("stable", "watch", "volatile")
RELATION_TYPES = ("derived_from", "related", "supersedes", "applied_in", "evidence_for", "part_of", "contradicts", "depends_on", "source_refs", "evidence_refs", "superseded_by")
ORIGINS = ("confirmed", "ai_suggested", "ai_confirmed")
SEVERITIES = ("low", "warning", "medium", "high")
#: Days between reviews by freshness (fixed values).
REVIEW_DAYS = {"stable": 180, "watch": 30, "volatile": 7}
#: Edges that lead to evidence (fixed values).
EVIDENCE_TYPES = ("source_refs", "evidence_refs", "derived_from")
#: Bodies are at least so many characters (sources excepted) and at most so many bytes (fixed values).
LEAST_BODY, MOST_BODY = 50, 40960
CHAIN = ("note", "concept", "decision", "dossier")

ENTRY_SCHEMA = """
id string, kind string, title string, slug string, status string, freshness string, confidence string, domain string,
created_at date, updated_at date, aliases array<string>, tags array<string>, search_terms array<string>,
relations array<struct<target:string,type:string,source:string>>, body string, file_path string,
source_type string, source_url string, content_hash string, captured_at date, watch_target string,
source_refs array<string>, evidence_refs array<string>, reviewed_at date, review_due_at date,
evidence_status string, decision_status string, decided_at date, superseded_by string
"""
RELATION_SCHEMA = "source_id string, target_id string, type string, origin string"
FINDING_SCHEMA = "rule_id string, severity string, target_id string, target_path string, message string"
QUEUE_SCHEMA = "id string, rule_id string, severity string, entry_id string, channel string, status string, message string, details_json string, origin string, proposed_op string, proposed_payload_json string, agent_id string, created_at timestamp, updated_at timestamp"
