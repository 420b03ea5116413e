"""Extra columns whose names hold backticks, dots or the operators' own names pass through."""

import pytest

from tessera.llm import media, simhash, toxicity

NAMES = ["a`b", "a.b", "Score x", "_toxicity", "toxicity"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, t, *range(len(NAMES))) for i, t in enumerate(["one two", None, "", "you fool"])]
    return spark.createDataFrame(rows, ["doc_id", "text", *NAMES])


def test_fingerprints(clashing):
    got = simhash.with_fingerprint(clashing)
    assert got.columns == [*clashing.columns, "fingerprint"] and {r["a`b"] for r in got.collect()} == {0}


def test_scores(clashing):
    got = toxicity.with_score(clashing, toxicity.Lexicon({"fool": 3.0}, {}))
    assert got.columns == [*clashing.columns, "score"] and {r["a.b"] for r in got.collect()} == {1}


def test_pipeline_stage(spark, clashing, tmp_path):
    import corpus_pipeline

    labels = [(i, 1, int(i == 3)) for i in range(4)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.toxicity_filter(spark, clashing, str(tmp_path))
    assert got.columns == clashing.columns and {r["_toxicity"] for r in got.collect()} == {3}


def test_images(clashing):
    got = media.png_features(media.to_png(clashing))
    assert got.count() == 4 and "a`b" in got.columns and set(media.FEATURES) <= set(got.columns)
