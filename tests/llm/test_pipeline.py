"""The pipeline's stages on odd rows, and as a whole."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(odd):
    return odd.select(*COLUMNS)


def test_every_stage_takes_odd_rows(spark, docs, sf_dir):
    import corpus_pipeline

    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = Counter(r.doc_id for r in left.collect())
        left = stage(spark, left, sf_dir)
        assert left.columns == COLUMNS, name
        assert not Counter(r.doc_id for r in left.collect()) - before, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, left, sf_dir)
    assert Counter(r.doc_id for r in left.collect()) == Counter(
        r.doc_id for r in pieces.where("start = 0").collect()
    )


def test_every_stage_takes_an_empty_table(spark, empty, sf_dir):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty.select(*COLUMNS), sf_dir).count() == 0


def test_a_decision_is_about_one_row(spark, sf_dir):
    """Repeated and missing ids: the good row of an id stays when another one goes."""
    import corpus_pipeline

    good = "the old man went down to the sea with the boat and the nets of the village " * 4
    other = "a letter from the north told of long winters and of roads that nobody walks any more " * 4
    rows = [(1, good), (1, "12 34 !!"), (None, good), (None, "55 66 ??"), (2, good), (2, other), (None, other)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.language_id(spark, df, sf_dir).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(r for r in rows if "the" in r[1] or "from" in r[1])
    alone = corpus_pipeline.near_duplicates(spark, df, sf_dir).collect()
    assert Counter((r.doc_id, r.text) for r in alone) == Counter(
        [(1, good), (2, other), (1, "12 34 !!"), (None, "55 66 ??")]
    )


def test_whole_pipeline_against_its_stages(spark, sf_dir):
    """Pieces cover the masked texts of what the stages keep, each once; no secrets and no
    near copies are among them."""
    import corpus_pipeline

    pieces = corpus_pipeline.run(spark, sf_dir)
    by_doc = pieces.groupBy("doc_id").agg(
        F.sum("length").alias("n"), F.first("doc_tokens").alias("tokens"), F.min("start").alias("start")
    ).collect()
    assert by_doc and all(r.n == r.tokens and r.start == 0 for r in by_doc)
    left = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, sf_dir)
    assert {r.doc_id for r in by_doc} == {r.doc_id for r in left.collect()}
    sizes = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r.n for r in sizes) <= 2048
