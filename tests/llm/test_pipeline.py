"""The pipeline's stages against plain versions."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "sentencepiece"]
    now, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, data).toPandas(), docs.schema)
        assert now.columns == docs.columns
        sizes.append(now.count())
    assert docs.count() >= sizes[0] >= sizes[1] > sizes[2] >= sizes[3] > 0
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    # no clean document goes for its quality
    kept = {r["doc_id"] for r in corpus_pipeline.quality_classifier(spark, docs, data).collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.98 * len(good)
    full = corpus_pipeline.run(spark, data)
    assert full.count() == sizes[-1] and "ids" in full.columns


def test_one_of_each_group_stays(spark, data):
    t = " ".join(f"w{i}" for i in range(60))
    rows = [(5, t, "en", "a", 1), (3, t + " x", "en", "b", 1), (9, "other text of some words in a row", "en", "a", 1), (9, "other text of some words in a row", "en", "a", 1), (None, t, "en", "a", 1), (7, "", "en", "a", 0), (8, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(str(r["doc_id"]) for r in corpus_pipeline.ngram_jaccard_join(spark, docs, data).collect())
    assert got == ["3", "7", "8", "9", "None"]
