"""JSON-lines logs that jobs read and write, reports, baselines, and a table of settings. Files of a log are by date; an
append never rewrites one."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.sources.markdown import json_lines
from lorewright.sources.snapshots import Snapshots

ACCESS = "entry_id string, op string, accessed_at timestamp"
DENSE_QUEUE = "entry_id string, queued_at string"
RECOVERY = "ts string, target_path string, message string"
STATUS = "entry_id string, status string, logged_at string"
FALLBACK = "ts_epoch long, token string"
PROGRESS = "ts string, entry_id string, status string, message string"
BASELINES_KEPT = 5


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all files of a log folder or file; a log that is missing is empty, bad lines are left out."""
    p, fs = _fs(spark, path)
    return json_lines(spark, path, schema) if fs.exists(p) else spark.createDataFrame([], schema)


def dense_queue(spark: SparkSession, root: str) -> DataFrame:
    return scan(spark, f"{root}/queue/dense_embed", DENSE_QUEUE)


def recovery(spark: SparkSession, root: str) -> DataFrame:
    return scan(spark, f"{root}/logs/refresh/recovery.log", RECOVERY)


def fallbacks(spark: SparkSession, root: str) -> DataFrame:
    return scan(spark, f"{root}/logs/refresh/tokenizer-fallback.log", FALLBACK)


def completed(spark: SparkSession, path: str) -> DataFrame:
    """(entry_id) that a progress log has as done."""
    return scan(spark, path, PROGRESS).where("status = 'ok'").select("entry_id").distinct()


def append(rows: DataFrame, folder: str, day: str) -> None:
    """Rows as JSON lines behind what the day's folder of a log has."""
    rows.write.mode("append").json(f"{folder}/{day}")


def status_transition(spark: SparkSession, root: str, entry_id: str, before: str | None, status: str, at: str, context: dict[str, str] | None = None) -> None:
    """One line of the status log; context adds fields."""
    row = {"entry_id": entry_id, "status": status, "logged_at": at} | ({"status_before": before} if before else {}) | (context or {})
    append(spark.createDataFrame([tuple(row.values())], ", ".join(f"`{k}` string" for k in row)), f"{root}/logs/refresh/status-events", at[:10])


def dense_error(spark: SparkSession, root: str, phase: str, message: str) -> None:
    """One line of the log of the vector route's errors."""
    now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    append(spark.createDataFrame([(now, phase, message[:500])], "ts string, phase string, message string"), f"{root}/logs/retrieval/dense-errors", now[:10])


def report(findings: DataFrame, folder: str, name: str) -> str:
    """Findings as one JSON report; gives its path."""
    path = f"{folder}/{name}"
    findings.write.mode("overwrite").json(path)
    return path


def snapshot(rows: DataFrame, root: str, name: str) -> str:
    return report(rows, f"{root}/snapshots", name)


def baseline(rows: DataFrame, root: str, name: str, keep: int = BASELINES_KEPT) -> list[str]:
    """Write a baseline and drop the oldest beyond `keep`; gives the names kept. Names sort by age."""
    report(rows, f"{root}/baselines", name)
    p, fs = _fs(rows.sparkSession, f"{root}/baselines")
    names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())
    for old in names[:-keep]:
        fs.delete(_fs(rows.sparkSession, f"{root}/baselines/{old}")[0], True)
    return names[-keep:]


def set_meta(tables: Snapshots, key: str, value: str) -> None:
    tables.merge("meta", "key string, value string", tables.spark.createDataFrame([(key, value)], "key string, value string"), ["key"])


def dictionary(entries: DataFrame, frequency: int = 5) -> DataFrame:
    """(term, frequency): the words that a segmenter is given, aliases and tags."""
    words = entries.select(F.explode(F.concat(F.coalesce("aliases", F.array()), F.coalesce("tags", F.array()))).alias("term"))
    return words.where("term is not null and trim(term) <> ''").distinct().withColumn("frequency", F.lit(frequency))
