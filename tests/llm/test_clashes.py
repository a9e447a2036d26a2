"""Extra columns, also such as are named like an operator's own, change nothing; repeated rows and ties have defined results."""

import corpus_pipeline
import pytest
from lorewright.llm import embedding_dedup, exact_topk, lang_id, minhash_dedup, packing, quality, toxicity, url_filter, warc
from lorewright.llm.shared import fresh
from pyspark.sql import functions as F
from tests.llm import brute

SF = "/root/testdata/sf0.001"
NAMES = ["score", "predicted", "lang_pred", "held_out", "label", "_id", "_lang", "_key", "_k", "_n", "_u", "id", "v", "x", "y", "n", "code", "shard", "asks", "token", "component", "sig", "html_", "digest", "rule", "verdict", "path"]


def clashing(df):
    return df.withColumns({c: F.lit(f"{c}!") for c in NAMES if c not in df.columns})


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("run,table", [
    (lambda d, s: lang_id.identified(d), "documents"), (lambda d, s: toxicity.judged(d, clashing(s.read.parquet(f"{SF}/labels.parquet"))), "documents"),
    (lambda d, s: quality.judged(d, clashing(s.read.parquet(f"{SF}/labels.parquet"))), "documents"), (lambda d, s: minhash_dedup.near_duplicates(d), "documents"),
    (lambda d, s: packing.packed(d).drop("sequence_id", "offset", "step_group", "tier"), "documents"), (lambda d, s: embedding_dedup.near_duplicates(d), "embeddings"),
    (lambda d, s: exact_topk.top_k(d), "embeddings"), (lambda d, s: url_filter.judged(d), "pages"), (lambda d, s: warc.round_trip(d, s).drop("archive", "offset"), "pages"),
])
def test_extra_columns_do_not_matter(spark, run, table):
    plain = spark.read.parquet(f"{SF}/{table}.parquet").limit(60).cache()
    assert rows(run(plain, spark)) == rows(run(clashing(plain), spark))


@pytest.mark.parametrize("name", ["toxicity", "language_id", "minhash_near_dedup", "mixing"])
def test_stages_keep_all_columns(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in NAMES}).withColumn("score", F.lit(77.0)).cache()
    got = stage(spark, docs, SF)
    assert got.columns == docs.columns
    found = got.collect()
    assert found and all(r.score == 77.0 and all(r[c] == f"{c}{r.doc_id}" for c in NAMES if c != "score") for r in found)


def test_fresh_names():
    assert fresh(["Score", "a"], "score", "score", "b") == ["score_", "score__", "b"]


def test_repeated_rows_and_ties(spark):
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate([(1, 0), (1, 0), (0.5, 0.5), (0, 1)])] + [(50, [1.0, 0.0]), (100, [0.0, 1.0])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in exact_topk.top_k(frame).collect()} == brute.top_products(vectors)
    twice = embedding_dedup.near_duplicates(frame.unionAll(frame)).collect()
    assert len(twice) == 2 * len(vectors) and {(r.vec_id, r.n_links) for r in twice} == {(0, 5), (1, 5), (50, 5), (2, 1), (3, 3), (100, 3)}
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    labels = spark.read.parquet(f"{SF}/labels.parquet").unionAll(spark.createDataFrame([(0, 2, 7), (1, -1, None)], "doc_id long, quality int, toxic int"))
    for op in (lang_id.identified, lambda d: toxicity.judged(d, labels), lambda d: quality.judged(d, labels)):
        once, both = op(docs), op(docs.unionAll(docs))
        assert once.count() * 2 == both.count()
