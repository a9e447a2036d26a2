"""Session helpers: the shared folder, written intermediates, and bounded labelled samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Values of a sampled column that are sampled: 0 and 1 of a label, or languages.
MOST_GROUPS = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. Where that is unset, local sessions (tests) get a folder of
    their own; on a cluster it must be set, as a node's own disk is no shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lorewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _own(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/lorewright/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; the writer creates it."""
    return f"{_own(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: its lineage ends there and no loss of an executor
    undoes it."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lorewright_path = path
    return out


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables that `written` gave and that no result reads."""
    for table in tables:
        if getattr(table, "_lorewright_path", None):
            _delete(table.sparkSession, table._lorewright_path)


def remove(spark: SparkSession) -> None:
    """Delete what this application left in the shared folder; results that read it become invalid."""
    _delete(spark, _own(spark))


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores behind those that columns (in any case) or names before them have."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as decimal text."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def smallest_hashes(rows: DataFrame, group: str, most: int) -> DataFrame:
    """At most `most` rows (doc_id, group) of each group, numbered _n: those of smallest id hash.

    Rows beyond a hash that leaves out what can't be among them (but for a chance below 1e-12) go in the task that reads
    them, so what a group sends to its window's task is about `most` rows whatever its size. The hashes' bounds, a number a
    group, go with the plan; of more than MOST_GROUPS groups the most frequent are sampled. Rows of a null group take no part."""
    counts = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_count"))
    counts = counts.orderBy(F.desc("_count"), group).limit(MOST_GROUPS).collect()
    reach = lambda n: int(min(1.0, (most + 8 * most**0.5) / n) * (1 << 40))
    hashed = rows.withColumn("_u", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    bound = F.lit(-1)
    if counts:
        bounds = F.map_from_entries(F.array(*[F.struct(F.lit(r[0]), F.lit(reach(r[1]))) for r in counts]))
        bound = F.coalesce(F.try_element_at(bounds, F.col(group)), F.lit(-1))
    order = Window.partitionBy(group).orderBy("_u", "doc_id")
    near = hashed.where(F.col("_u") <= bound)
    return near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_u")


def labelled_sample(labels: DataFrame, label: str, keep: Column, per_class: int) -> DataFrame:
    """(doc_id, label) of at most per_class ids of labels 0 and 1 each. A doc_id that occurs with both counts with 1. Rows
    with a null id, or a label that is neither, take no part."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & keep)
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return smallest_hashes(rows, "label", per_class).select("doc_id", "label")
