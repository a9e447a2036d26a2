"""Markdown files with YAML front matter, and the engine's JSON-lines logs, as DataFrames."""

from __future__ import annotations

import json
import unicodedata
from datetime import date, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewright.functions.text import PUNCTUATION
from lorewright.model import ENTRY_SCHEMA, FRESHNESS, KINDS, STATUSES
from lorewright.plans.lineage import cut

DEEPEST = 4
SPLIT = r"(?s)^---\n(.*?)---\n\n*(.*)$"


def files(spark: SparkSession, root: str, roots: tuple[str, ...] = ("entries", "sources", "views")) -> DataFrame:
    """(file_path, content) of every Markdown file below the roots, paths relative to root. A root that is missing is empty.
    Spark passes over folders whose names begin with an underscore, as the one for entries without a domain does; such folders,
    up to DEEPEST below a root, are named to it."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = [f"{root}/{r}" for r in roots if (p := jvm.org.apache.hadoop.fs.Path(f"{root}/{r}")).getFileSystem(conf).exists(p)]
    for pattern in [f"{r}{'/*' * depth}/_*" for r in there for depth in range(DEEPEST)]:
        glob = jvm.org.apache.hadoop.fs.Path(pattern)
        there += [s.getPath().toString() for s in glob.getFileSystem(conf).globStatus(glob) or [] if s.isDirectory()]
    if not there:
        return spark.createDataFrame([], "file_path string, content string")
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(there, wholetext=True)
    full = F.col("_metadata.file_path")
    base = root.removeprefix("file://").rstrip("/") + "/"
    return read.select(F.substring(full, F.instr(full, base) + len(base), F.length(full)).alias("file_path"), F.col("value").alias("content"))


def _plain(value: object) -> object:
    if isinstance(value, dict):
        return {unicodedata.normalize("NFC", str(k)): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [_plain(v) for v in value]
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    return unicodedata.normalize("NFC", value) if isinstance(value, str) else value


@F.pandas_udf(T.StructType([T.StructField("json", T.StringType()), T.StructField("error", T.StringType())]))
def _yaml_json(texts: pd.Series) -> pd.DataFrame:
    import yaml

    table = str.maketrans(*PUNCTUATION)

    def one(raw: str | None) -> tuple[str | None, str | None]:
        if raw is None:
            return None, "no front matter"
        try:
            data = yaml.safe_load(raw.translate(table))
        except yaml.YAMLError as e:
            return None, str(e).split("\n")[0]
        if not isinstance(data, dict) or not all(isinstance(k, str) for k in data):
            return None, "front matter is no map of names"
        return json.dumps(_plain(data), ensure_ascii=False), None

    return pd.DataFrame([one(t) for t in texts], columns=["json", "error"])


def parsed(read: DataFrame) -> DataFrame:
    """Files as entries with error: null for a good row, else why it is set aside (its typed columns may be null)."""
    raw = F.regexp_extract("content", SPLIT, 1)
    split = read.select("file_path", F.when(F.col("content").rlike(SPLIT), raw).alias("raw"), F.regexp_extract("content", SPLIT, 2).alias("body"))
    data = split.withColumn("y", _yaml_json("raw")).withColumn("e", F.from_json("y.json", ENTRY_SCHEMA))
    fields = [f for f in data.schema["e"].dataType.fieldNames() if f not in ("body", "file_path")]
    rows = data.select(*[F.col(f"e.{f}").alias(f) for f in fields], "body", "file_path", F.col("y.error").alias("error"))
    known = F.when(F.col("id").isNull() | F.col("title").isNull(), "id or title is missing").when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "unknown kind").when(~F.col("status").isin(*STATUSES), "unknown status").when(~F.col("freshness").isin(*FRESHNESS), "unknown freshness")
    empty = F.array().cast("array<string>")
    return rows.withColumn("error", F.coalesce("error", known)).withColumns({c: F.coalesce(c, empty) for c in ("aliases", "tags", "search_terms")})


def entries(spark: SparkSession, root: str, strict_roots: bool = False) -> tuple[DataFrame, DataFrame]:
    """Good entries, and (file_path, error) of the others. strict_roots leaves views/ out."""
    rows = cut(parsed(files(spark, root, ("entries", "sources") if strict_roots else ("entries", "sources", "views"))))
    return rows.where("error is null").drop("error"), rows.where("error is not null").select("file_path", "error")


def relations(entries: DataFrame) -> DataFrame:
    """Edges of entries: stated relations, and those of source_refs, evidence_refs and a decision's superseded_by; of equal
    keys the materialized one counts."""
    stated = entries.select(F.col("id").alias("source_id"), F.explode("relations").alias("r")).select("source_id", F.col("r.target").alias("target_id"), "r.type", F.coalesce("r.source", F.lit("confirmed")).alias("origin"), F.lit(0).alias("rank"))
    legs = [stated]
    for kinds, column in ((("note",), "source_refs"), (("dossier", "concept", "decision"), "evidence_refs")):
        legs.append(entries.where(F.col("kind").isin(*kinds)).select(F.col("id").alias("source_id"), F.explode(column).alias("target_id"), F.lit(column).alias("type"), F.lit("confirmed").alias("origin"), F.lit(1).alias("rank")))
    legs.append(entries.where("kind = 'decision' and superseded_by is not null").select(F.col("id").alias("source_id"), F.col("superseded_by").alias("target_id"), F.lit("superseded_by").alias("type"), F.lit("confirmed").alias("origin"), F.lit(1).alias("rank")))
    union = legs[0]
    for leg in legs[1:]:
        union = union.unionAll(leg)
    return union.groupBy("source_id", "target_id", "type").agg(F.max_by("origin", "rank").alias("origin"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines log; blank and malformed lines, and rows with a null in a named column, are dropped."""
    rows = spark.read.schema(schema + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    names = [c for c in rows.columns if c != "_bad"]
    return rows.where(F.col("_bad").isNull()).drop("_bad").dropna(subset=names)


def access_log(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """(entry_id, op, accessed_at) of the access log's rows for known ids."""
    rows = json_lines(spark, path, "entry_id string, op string, accessed_at timestamp")
    return rows.join(known.select(F.col("id").alias("entry_id")), "entry_id", "left_semi")


def rendered(entry: dict, body: str) -> str:
    """A Markdown file of an entry's non-null fields in their order. Characters that reading replaces are escaped."""
    import yaml

    kept = {k: v for k, v in entry.items() if v not in (None, [], "") and k not in ("body", "file_path")}
    front = yaml.safe_dump(kept, allow_unicode=True, sort_keys=False)
    if set(front) & set(PUNCTUATION[0]):
        front = yaml.safe_dump(kept, sort_keys=False)
    return "---\n" + front + "---\n\n" + body.rstrip("\n") + "\n"
