import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("change", ["doc_id < 0", "toxic null", "held out"])
def test_no_labels_keep_every_document(spark, tmp_path, change):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    some = {"doc_id < 0": lambda: labels.where("doc_id < 0"), "toxic null": lambda: labels.selectExpr("doc_id", "quality", "cast(null as int) AS toxic"), "held out": lambda: labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")}[change]()
    some.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == docs.count() > 0
