"""What an agent may do by itself: at once, within a guardrail, or only after approval."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import functions as F

from lorewright.api import KnowledgeBase, ulid
from lorewright.errors import ConflictError, NotFoundError, ValidationError
from lorewright.model import QUEUE_SCHEMA

#: What each operation needs (fixed values).
AUTONOMY = {"ingest": "auto", "update": "auto", "touch": "auto", "promote": "auto", "unlink_normal": "auto", "link": "guardrail", "unlink_critical": "approve", "rename": "approve", "domains_add": "approve", "domains_migrate": "approve"}
CRITICAL_TYPES = ("evidence_refs", "source_refs", "supersedes", "superseded_by")
LINKS_A_DAY = 10

_CALLS = {
    "ingest": lambda kb, p: kb.ingest(p["kind"], p["payload"], p.get("policy", "strict")), "update": lambda kb, p: kb.update(p["id"], p["changes"]), "touch": lambda kb, p: kb.touch(p["id"]),
    "promote": lambda kb, p: kb.promote(p["id"], p["target_kind"]), "unlink_normal": lambda kb, p: kb.unlink(p["source_id"], p["target_id"]), "unlink_critical": lambda kb, p: kb.unlink(p["source_id"], p["target_id"]),
    "link": lambda kb, p: kb.link(p["source_id"], p["target_id"], p["type"], "ai_suggested"), "rename": lambda kb, p: kb.rename(p["id"], p["slug"]), "domains_add": lambda kb, p: kb.add_domain(p["name"]), "domains_migrate": lambda kb, p: kb.migrate_domain(p["old"], p["new"]),
}


def _named(kb: KnowledgeBase, op: str, payload: dict) -> str:
    """unlink is critical where a relation between the two is."""
    if op != "unlink":
        return op
    between = kb.relations().where((F.col("source_id") == payload["source_id"]) & (F.col("target_id") == payload["target_id"]) & F.col("type").isin(*CRITICAL_TYPES))
    return "unlink_normal" if between.isEmpty() else "unlink_critical"


def _queue(kb: KnowledgeBase, rule: str, op: str, payload: dict, agent_id: str, status: str = "pending") -> str:
    now = datetime.now(UTC).replace(tzinfo=None)
    name = f"mq_{ulid()}"
    row = (name, rule, "medium", payload.get("id") or payload.get("source_id"), "digest", status, op, json.dumps({"source_id": payload.get("source_id")}), "autonomous", op, json.dumps(payload, default=str), agent_id, now, now)
    kb.tables.merge("queue", QUEUE_SCHEMA, kb.spark.createDataFrame([row], QUEUE_SCHEMA), ["id"])
    return name


def act(kb: KnowledgeBase, op: str, payload: dict, agent_id: str, body_agents: tuple[str, ...] = ()) -> dict:
    """Run an agent's operation, or queue it for approval; gives action, and result or queue_id."""
    if not agent_id.strip():
        raise ValidationError("agent_id is missing")
    op = _named(kb, op, payload)
    if op not in AUTONOMY:
        raise ValidationError(f"operation: {op}")
    blocked = op == "update" and "body" in payload["changes"] and agent_id not in body_agents
    if AUTONOMY[op] == "approve" or blocked:
        return {"action": "queued_for_approval", "queue_id": _queue(kb, "autonomous_body_update_blocked" if blocked else "autonomous_approval", op, payload, agent_id)}
    if AUTONOMY[op] == "guardrail":
        today = kb.queue().where((F.col("rule_id") == "autonomous_guardrail") & (F.col("agent_id") == agent_id) & (F.to_date("created_at") == F.lit(datetime.now(UTC).date())) & (F.get_json_object("details_json", "$.source_id") == payload["source_id"]))
        if today.count() >= LINKS_A_DAY:
            return {"action": "queued_for_approval", "queue_id": _queue(kb, "autonomous_approval", op, payload, agent_id)}
        _queue(kb, "autonomous_guardrail", op, payload, agent_id, "resolved")
    return {"action": "executed", "result": _CALLS[op](kb, payload)}


def approve(kb: KnowledgeBase, queue_id: str) -> object:
    """Run a queued proposal and resolve it."""
    row = kb.queue().where(F.col("id") == queue_id).first()
    if row is None:
        raise NotFoundError(queue_id)
    if row.status not in ("pending", "sent") or row.proposed_op not in _CALLS:
        raise ConflictError(f"{queue_id} is {row.status}")
    result = _CALLS[row.proposed_op](kb, json.loads(row.proposed_payload_json))
    kb.transition(queue_id, "resolved")
    return result


def reject(kb: KnowledgeBase, queue_id: str) -> None:
    kb.transition(queue_id, "dismissed")
