from collections import Counter

import corpus_pipeline
import numpy as np
from lorewright.llm import lang_id, packing, toxicity
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "language_id", "minhash_near_dedup", "mixing", "packing"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")

    clean = steps["toxicity"](spark, docs, SF).cache()
    bad = {r.doc_id for r in toxicity.judged(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - bad and clean.columns == columns

    known = steps["language_id"](spark, clean, SF).cache()
    assert {r.doc_id for r in known.collect()} == {r.doc_id for r in lang_id.identified(clean).where("lang_pred <> 'und'").collect()} and known.columns == columns

    kept = steps["minhash_near_dedup"](spark, known, SF).cache()
    groups = brute.minhash_groups([(r.doc_id, r.text) for r in known.collect()], corpus_pipeline.NEAR_PERCENT)
    assert {r.doc_id for r in kept.collect()} == {d for d, (_, c) in groups.items() if c == d} and kept.columns == columns

    mixed = steps["mixing"](spark, kept, SF).cache()
    sizes, target = brute.mix_targets([(r.source, r.text) for r in kept.collect()])
    taken = Counter()
    for r in mixed.collect():
        taken[r.source] += len(brute.WORD.findall(r.text))
    most = {s: max(len(brute.WORD.findall(r.text)) for r in kept.collect() if r.source == s) for s in sizes}
    assert all(abs(taken[s] - target[s]) <= max(0.05 * target[s], 0.5 * most[s]) for s in sizes) and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 3 and mixed.columns == columns

    packed = steps["packing"](spark, mixed, SF).collect()
    code = packing.encoder(packing.default_vocabulary())
    want = Counter()
    for r in mixed.collect():
        want[r.doc_id] += len(code(r.text)) + 1
    got = Counter()
    for r in packed:
        got[r.doc_id] += r.length
    assert got == want


def test_run_and_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 100
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", None, 0), (2, "", None, "a", 0), (None, "the one of no id", "en", "a", 0), (3, "the three words", "en", "b", 0), (3, "the three words", "en", "b", 0), (4, "1 2 3", "en", "b", 0)]
    rows += [(10 + i, " ".join(np.random.default_rng(i).choice(["the", "and", "river", "house"], 30)), "en", "c", 0) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 1 not in got and 2 not in got and 4 not in got
