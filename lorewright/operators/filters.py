"""Predicates, validations, listings and the queue's views."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewright.functions.text import CJK
from lorewright.model import LEAST_BODY, MOST_BODY, REVIEW_DAYS
from lorewright.plans.quantiles import quantiles

FALLBACK = "_unsorted"


def matching(entries: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows whose attributes equal what is wanted; tags hold a value, or all of a list. An unknown attribute fits nothing."""
    for key, value in wanted.items():
        if key not in entries.columns:
            fits = F.lit(False)
        elif key == "tags":
            values = value if isinstance(value, (list, tuple, set)) else [value]
            fits = F.size(F.array_except(F.array(*[F.lit(v) for v in values]), "tags")) == 0
        else:
            fits = F.col(key).eqNullSafe(F.lit(value))
        entries = entries.where(fits)
    return entries


_CLAUSE = re.compile(r"\s*(\w+)\s*(!=|<>|=)\s*(?:'([^']*)'|\"([^\"]*)\"|(\S+))\s*")


def clauses(expression: str, columns: tuple[str, ...], mandatory: dict[str, str] | None = None) -> list[tuple[str, str, str]]:
    """(column, operator, value) of `column op value AND ...`; columns outside the list, and missing mandatory clauses, raise."""
    out = []
    for part in re.split(r"\s+AND\s+", expression.strip(), flags=re.IGNORECASE):
        found = _CLAUSE.fullmatch(part)
        if not found or found[1] not in columns:
            raise ValueError(f"filter: {part!r}")
        out.append((found[1], "!=" if found[2] == "<>" else found[2], next(g for g in found.groups()[2:] if g is not None)))
    for column, value in (mandatory or {}).items():
        if (column, "=", value) not in out:
            raise ValueError(f"filter: {column} = {value} is mandatory")
    return out


def expression(entries: DataFrame, text: str, columns: tuple[str, ...], mandatory: dict[str, str] | None = None) -> DataFrame:
    for column, op, value in clauses(text, columns, mandatory):
        entries = entries.where(F.col(column) == value if op == "=" else F.col(column) != value)
    return entries


def by_aliases(entries: DataFrame, aliases: list[str]) -> DataFrame:
    return entries.where(F.arrays_overlap("aliases", F.array(*[F.lit(a) for a in aliases])))


def invalid_urls(entries: DataFrame) -> DataFrame:
    return entries.where((F.col("kind") == "source") & ~F.col("source_url").rlike("^(https?|knowledge)://"))


def body_length(entries: DataFrame) -> DataFrame:
    """Entries whose body breaks a bound, with problem."""
    problem = F.when(F.octet_length("body") > MOST_BODY, "too_long").when((F.col("kind") != "source") & (F.length(F.trim("body", F.lit(" \t\n\r"))) < LEAST_BODY), "too_short")
    return entries.withColumn("problem", problem).where("problem is not null")


def search_terms_problems(entries: DataFrame) -> DataFrame:
    """One row an entry and problem of its search terms."""
    terms, all_ = F.col("search_terms"), F.array_join("search_terms", " ")
    tests = {
        "too_few": F.size(terms) < 5, "no_cjk": ~all_.rlike(f"[{CJK}]"), "no_ascii": ~(all_.rlike("[A-Za-z]") | F.array_contains(terms, "")),
        "too_long": F.exists(terms, lambda t: F.length(t) > 40), "blank": F.exists(terms, lambda t: (t != "") & (F.trim(t) == "")),
        "many_empty": F.size(F.filter(terms, lambda t: t == "")) > 1, "repeated": F.size(F.array_distinct(terms)) < F.size(terms),
    }
    return entries.withColumn("problem", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in tests.items()]))))


def review_date(reviewed_at: Column, freshness: Column) -> Column:
    days = F.coalesce(*[F.when(freshness == k, v) for k, v in REVIEW_DAYS.items()])
    return F.date_add(reviewed_at, days)


def review_due(entries: DataFrame, as_of: str, archived: bool = False) -> DataFrame:
    due = entries.where((F.col("kind") == "dossier") & (F.col("review_due_at") <= F.lit(as_of).cast("date")))
    return (due if archived else due.where("status <> 'archived'")).orderBy("review_due_at", "id")


def review_picks(entries: DataFrame) -> DataFrame:
    """(id, queue): drafts, volatile and watched entries; one may be in two queues."""
    picks = F.array_compact(F.array(F.when(F.col("status") == "draft", F.lit("draft")), F.when(F.col("freshness").isin("volatile", "watch"), F.col("freshness"))))
    return entries.select("id", F.explode(picks).alias("queue"))


def path_of(kind: Column, domain: Column, slug: Column, created_at: Column) -> Column:
    place = F.coalesce(F.nullif(domain, F.lit("")), F.lit(FALLBACK))
    return F.when(kind == "source", F.concat(F.lit("sources/"), F.date_format(created_at, "yyyy/MM"), F.lit("/"), slug, F.lit(".md"))).when(kind == "view", F.concat(F.lit("views/"), slug, F.lit(".md"))).otherwise(F.concat(F.lit("entries/"), kind, F.lit("/"), place, F.lit("/"), slug, F.lit(".md")))


def queue_list(queue: DataFrame, status: str | None = None, channel: str | None = None, severity: str | None = None, since: str | None = None, origin: str | None = None) -> DataFrame:
    for column, value in (("status", status), ("channel", channel), ("severity", severity), ("origin", origin)):
        if value is not None:
            queue = queue.where(F.col(column) == value)
    return (queue if since is None else queue.where(F.col("created_at") >= F.lit(since).cast("timestamp"))).orderBy(F.desc("created_at"), "id")


def guardrail(queue: DataFrame, most: int = 10) -> DataFrame:
    """(agent_id, day, source_id, n, allowed): an agent's daily operations on one source."""
    counts = queue.groupBy("agent_id", F.to_date("created_at").alias("day"), F.get_json_object("details_json", "$.k").alias("source_id")).agg(F.count("*").alias("n"))
    return counts.withColumn("allowed", F.col("n") < most)


def length_distribution(entries: DataFrame) -> DataFrame:
    """(kind, p50, p90, p99, rejected, verdict) of body lengths."""
    size = F.length("body")
    shares = entries.groupBy("kind").agg(F.avg(F.when(size < LEAST_BODY, 1.0).otherwise(0.0)).alias("rejected"))
    spread = quantiles(entries.select(F.col("kind").alias("group"), size.cast("double").alias("value")), (0.5, 0.9, 0.99)).withColumnRenamed("group", "kind")
    rows = spread.join(shares, "kind").select("kind", "p50", "p90", "p99", "rejected")
    return rows.withColumn("verdict", F.when(F.col("rejected") == 0, "ok").when(F.col("rejected") <= 0.02, "tolerable").otherwise("high"))
