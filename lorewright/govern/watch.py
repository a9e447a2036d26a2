"""Watched targets: each is polled for its latest release; a new one becomes a source that supersedes the older ones, and the
dossiers that follow the target are touched. A target's cursor moves only when all of that is done, and one target's failure
stays its own."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, date, datetime

from pyspark.sql import functions as F

from lorewright.api import KnowledgeBase
from lorewright.errors import ConflictError, LoreError

WATCH_SCHEMA = "id string, source_type string, target string, cursor string, last_checked_at timestamp, linked_dossiers_json string, consecutive_404_count int"
#: Misses in a row after which a target rests, and how many days.
MOST_MISSES, REST_DAYS, LONGEST_BODY, TRIES = 3, 7, 5000, 2
#: Gives the latest release of a target (tag_name, html_url, body, published_at), or None where there is none.
Fetcher = Callable[[str], dict | None]


class RateLimited(LoreError):
    code = "rate_limited"


@dataclass
class Polled:
    new: list[str] = field(default_factory=list)
    unchanged: list[str] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)
    resting: list[str] = field(default_factory=list)
    errors: dict[str, str] = field(default_factory=dict)


def url_tag_hash(url: str, tag: str) -> str:
    return "sha256:" + hashlib.sha256(f"{url}|{tag}".encode()).hexdigest()


def release_day(published_at: str | None) -> date | None:
    return date.fromisoformat(published_at[:10]) if published_at else None


def known_hash(kb: KnowledgeBase, content_hash: str) -> bool:
    """Whether a source of this content is there."""
    return not kb.entries().where((F.col("kind") == "source") & (F.col("content_hash") == content_hash)).limit(1).isEmpty()


def http_releases(base: str, token: str | None = None, pause: float = 1.0) -> Fetcher:
    """A fetcher of `{base}/repos/{target}/releases/latest`: 404 is None, 403 raises RateLimited, other failures are tried
    again."""
    import urllib.error
    import urllib.request

    def fetch(target: str) -> dict | None:
        request = urllib.request.Request(f"{base}/repos/{target}/releases/latest", headers={"Authorization": f"Bearer {token}"} if token else {})
        for turn in range(TRIES + 1):
            try:
                with urllib.request.urlopen(request, timeout=30) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    return None
                if e.code == 403:
                    raise RateLimited(target) from e
                if turn == TRIES:
                    raise
            except urllib.error.URLError:
                if turn == TRIES:
                    raise
            time.sleep(pause * 2**turn)
        return None

    return fetch


def watch(kb: KnowledgeBase, target: str, dossiers: tuple[str, ...] = ()) -> str:
    """Watch a target; gives the watch's id."""
    name = "ew_" + hashlib.sha256(target.encode()).hexdigest()[:16]
    row = (name, "github_release", target, None, None, json.dumps(list(dossiers)), 0)
    kb.tables.merge("watch", WATCH_SCHEMA, kb.spark.createDataFrame([row], WATCH_SCHEMA), ["id"])
    return name


def _released(kb: KnowledgeBase, target: str, latest: dict, dossiers: list[str], terms: list[str]) -> None:
    tag, url = latest.get("tag_name") or "unknown", latest.get("html_url") or ""
    body, content_hash = latest.get("body") or "", url_tag_hash(latest.get("html_url") or "", latest.get("tag_name") or "unknown")
    if len(body) > LONGEST_BODY:
        body = body[:LONGEST_BODY] + "...(truncated)"
    made = None
    if not known_hash(kb, content_hash):
        payload = {"title": f"{target} {tag}", "source_url": url, "source_type": "github_release", "content_hash": content_hash, "captured_at": release_day(latest.get("published_at"))}
        payload |= {"tags": ["github_release"], "search_terms": terms, "watch_target": target, "body": body}
        try:
            made = kb.ingest("source", payload)
        except ConflictError:
            made = None
    if made:
        older = kb.entries().where((F.col("kind") == "source") & (F.col("watch_target") == target) & (F.col("id") != made["id"])).where("superseded_by is null")
        kb.put(older.withColumn("superseded_by", F.lit(made["id"])))
    for dossier in dossiers:
        kb.touch(dossier)


def poll(kb: KnowledgeBase, fetch: Fetcher, terms: Callable[[str, str], list[str]] | None = None) -> Polled:
    """Poll every watched target once; watches are few, each is one request."""
    terms = terms or (lambda target, tag: [f"{target} {tag}", target, tag, "发布", "release notes"])
    done, now = Polled(), datetime.now(UTC).replace(tzinfo=None)
    rows = []
    for r in kb.tables.read("watch", WATCH_SCHEMA).orderBy("id").toLocalIterator():
        cursor, misses, checked = r.cursor, r.consecutive_404_count or 0, now
        rest = misses >= MOST_MISSES and r.last_checked_at is not None and (now - r.last_checked_at).days < REST_DAYS
        if rest:
            done.resting.append(r.target)
            continue
        try:
            latest = fetch(r.target)
            if latest is None:
                misses += 1
                done.missing.append(r.target)
            elif cursor is not None and latest.get("tag_name") in (None, cursor):
                misses = 0
                done.unchanged.append(r.target)
            else:
                _released(kb, r.target, latest, json.loads(r.linked_dossiers_json or "[]"), terms(r.target, latest.get("tag_name") or "unknown"))
                cursor, misses = latest.get("tag_name") or "unknown", 0
                done.new.append(r.target)
        except Exception as e:  # any failure stays this target's; its cursor doesn't move
            done.errors[r.target] = f"{type(e).__name__}: {e}"
            continue
        rows.append((r.id, r.source_type, r.target, cursor, checked, r.linked_dossiers_json, misses))
    if rows:
        kb.tables.merge("watch", WATCH_SCHEMA, kb.spark.createDataFrame(rows, WATCH_SCHEMA), ["id"])
    return done
