"""Maintenance jobs: archiving by a signed snapshot, clean-up of broken relations, punctuation repair of front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewright.api import KnowledgeBase
from lorewright.errors import ConflictError
from lorewright.functions.text import fix_punctuation
from lorewright.operators import filters, rules

LOG_SCHEMA = "entry_id string, action string, status string, line long"
_PLAN_COLUMNS = ("kind", "status", "freshness", "confidence", "domain")


def archive_plan(kb: KnowledgeBase, expression: str, expected: int, mandatory: dict[str, str] | None = None) -> tuple[DataFrame, str]:
    """(id, status, digest) of the entries an archive run would take, and the plan's hash; the count must be as expected."""
    rows = filters.expression(kb.entries(), expression, _PLAN_COLUMNS, mandatory).select("id", "status", F.sha2(F.concat_ws("\n", "title", "status", "body"), 256).alias("digest"))
    if (n := rows.count()) != expected:
        raise ConflictError(f"{n} entries, {expected} expected")
    return rows, signature(rows)


def signature(plan: DataFrame) -> str:
    """A hash of a plan's rows that no order changes."""
    n, x, s = plan.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("id", "status", "digest")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("digest", "id").cast("decimal(38,0)")), F.lit(0))).first()
    return f"{n}-{x & (2**64 - 1):016x}-{int(s):x}"


def log_state(log: DataFrame) -> DataFrame:
    """(entry_id, status) by the last line of each entry of an execution log."""
    return log.groupBy("entry_id").agg(F.max_by("status", "line").alias("status"))


def archive(kb: KnowledgeBase, plan: DataFrame, signed: str, log: DataFrame | None = None) -> DataFrame:
    """Archive a plan's entries that the log doesn't have as done; entries that changed since the plan stay. Gives (id,
    outcome)."""
    if signature(plan) != signed:
        raise ConflictError("the plan was changed")
    rows = plan if log is None else plan.join(log_state(log).where("status = 'done'").select(F.col("entry_id").alias("id")), "id", "left_anti")
    now = kb.entries().withColumn("now", F.sha2(F.concat_ws("\n", "title", "status", "body"), 256))
    met = rows.join(now.select("id", "now"), "id", "left").select("id", F.when(F.col("now") == F.col("digest"), "archived").when(F.col("now").isNull(), "missing").otherwise("changed").alias("outcome"))
    met = kb.spark.createDataFrame(met.collect(), "id string, outcome string")  # the plan's ids, whose number the caller stated
    changed = kb.entries().join(met.where("outcome = 'archived'").select("id"), "id", "left_semi").withColumn("status", F.lit("archived"))
    kb.put(changed)
    return met


def restore(kb: KnowledgeBase, plan: DataFrame, done: DataFrame) -> int:
    """Give the plan's entries that done (id) lists their old status; all must be archived now."""
    old = plan.join(done.select("id").distinct(), "id", "left_semi").select("id", F.col("status").alias("old"))
    rows = kb.entries().join(old, "id")
    if not rows.where("status <> 'archived'").isEmpty():
        raise ConflictError("an entry is not archived")
    n = rows.count()
    kb.put(rows.withColumn("status", F.col("old")).drop("old"))
    return n


def reconcile(kb: KnowledgeBase, plan: DataFrame, events: DataFrame) -> DataFrame:
    """(id, problem) where an entry's status and its count of archive events (entry_id, status) do not agree with a finished
    run: archived, by exactly one event."""
    counts = events.where("status = 'archived'").groupBy(F.col("entry_id").alias("id")).agg(F.count("*").alias("n"))
    rows = plan.select("id").join(kb.entries().select("id", "status"), "id", "left").join(counts, "id", "left")
    problem = F.when(F.col("status").isNull(), "missing").when(F.col("status") != "archived", "not archived").when(F.coalesce("n", F.lit(0)) != 1, "events")
    return rows.select("id", problem.alias("problem")).where("problem is not null")


def clean_relations(kb: KnowledgeBase, expected: int) -> DataFrame:
    """Drop stated relations without a target that an agent made; gives those of confirmed origin, which are left to people.
    The number of dropped keys must be as expected."""
    broken = rules.broken_relations(kb.entries(), kb.relations()).select("source_id", "target_id", "type", "origin")
    gone = broken.where("origin <> 'confirmed'")
    if (n := gone.count()) != expected:
        raise ConflictError(f"{n} relations, {expected} expected")
    keys = gone.groupBy(F.col("source_id").alias("id")).agg(F.collect_set(F.concat_ws("|", "target_id", "type")).alias("gone"))
    kept = F.filter("relations", lambda r: ~F.array_contains("gone", F.concat_ws("|", r["target"], r["type"])))
    left = kb.spark.createDataFrame(broken.where("origin = 'confirmed'").collect(), broken.schema)  # what people are to read
    if n:
        kb.put(kb.entries().join(keys, "id").withColumn("relations", kept).drop("gone"))
    return left


def punctuation_changes(files: DataFrame) -> DataFrame:
    """(file_path, before, after) of files (file_path, content) whose front matter holds full-width punctuation."""
    from lorewright.sources.markdown import SPLIT

    raw = F.regexp_extract("content", SPLIT, 1)
    return files.where(F.col("content").rlike(SPLIT)).select("file_path", raw.alias("before"), fix_punctuation(raw).alias("after")).where("before <> after")


def character_diff(before: Column, after: Column) -> Column:
    """How many characters of before are not in after, as a multiset difference."""
    count = lambda text: lambda c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    chars = F.array_distinct(F.filter(F.split(before, ""), lambda c: c != ""))
    return F.aggregate(chars, F.lit(0), lambda n, c: n + F.greatest(count(before)(c) - count(after)(c), F.lit(0)))
