import corpus_pipeline
from lorewright.llm import minhash_dedup
from tests.llm import brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stage_removes_near_copies_from_similarity_080(spark):
    """Pairs of 100-word texts of which one has other words at its end: 104 words share 100 - 4 - n shingles."""
    rows = []
    for k, changed in enumerate((9, 10, 11, 12, 13)):
        words = [f"w{k}x{i}" for i in range(104)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: 104 - changed] + [f"o{k}x{i}" for i in range(changed)]))]
    sets = {i: brute.shingles(t) for i, t in rows}
    near = {2 * k + 1: len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) for k in range(5)}
    assert any(0.8 <= x < 0.85 for x in near.values()) and any(x < 0.8 for x in near.values())
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], COLUMNS)
    kept = {r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()}
    assert kept == {i for i, _ in rows if near.get(i, 0) < 0.8}
    assert {r.doc_id for r in minhash_dedup.near_duplicates(docs).where("kept").collect()} == {i for i, _ in rows if near.get(i, 0) < 0.85}  # op6 stays at 0.85
