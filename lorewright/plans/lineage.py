"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint in spark.checkpoint.dir. Where that is unset, local sessions (tests) get a folder of their
    own; on a cluster it must be set, as a node's own disk is no shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="lorewright-"))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a table written to spark.checkpoint.dir and read again. Unlike a checkpoint's, its plan keeps no sizes or constraints of
    what made it, which loops whose result meets itself would multiply from round to round."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        cut(df.limit(0))  # sets the folder
    path = f"{context.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
