"""The corpus pipeline: from raw documents to packed training windows.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns of
documents. Null and empty texts have no letters and leave at language identification; empty tables pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.llm import lang_id, minhash_dedup, mixing, packing, toxicity
from lorewright.llm.shared import crc_of_id, written
from lorewright.plans.shipping import ship


#: Per cent of shared shingles from which documents are near-duplicates here (op6's contract asks for 85), and the signature
#: collisions asked of a candidate: a pair of similarity 0.8 misses 33 of 64 with a chance of 8e-8.
NEAR_PERCENT, NEAR_MATCHES = 80, 33


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled rows that op5 doesn't hold out, scores below 0.5. Null and
    empty texts have the score of no feature and stay; repeated rows are judged alike; other columns are kept, whatever
    their names."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.train(docs, labels, F.coalesce(crc_of_id() % 5 != 0, F.lit(False))))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of the learned; those without a letter go, null and empty texts among them. Repeated
    rows are judged alike; other columns are kept, whatever their names."""
    ship(spark)
    return lang_id.known(docs, lang_id.train(docs, F.coalesce(crc_of_id() % 4 != 2, F.lit(False))))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, of similarity 0.8 on five-word shingles: that of the smallest doc_id, and of
    rows that repeat it that of the smallest text hash. Rows of null doc_id are compared with nothing and stay."""
    ship(spark)
    found = minhash_dedup.near_duplicates(docs, percent=NEAR_PERCENT, matches=NEAR_MATCHES).where("kept and doc_id is not null")
    kept = found.groupBy("doc_id").agg(F.count("*").alias("n"))
    own = docs.where("doc_id is not null")
    once = own.join(kept.where("n = 1").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    again = own.join(kept.where("n > 1").select("doc_id"), "doc_id", "left_semi")
    # one row of each id: the least by hash, found with partial aggregation, so an id of very many rows meets in no task
    first = again.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64("text")).alias("row")).select("row.*")
    return once.unionAll(first.select(*docs.columns)).unionAll(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Null texts have no words, a null source is one of its own, repeated rows
    are documents of their own; other columns are kept, whatever their names."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed windows. A null or empty text is one token; repeated rows and null ids are documents of their own."""
    ship(spark)
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("minhash_near_dedup", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Trained models and tokenisation have no SQL form; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
