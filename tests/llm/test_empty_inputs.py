"""Models and stages over empty tables, without labels, without languages."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexloom.llm import pipeline_stages as P
from lexloom.llm import queries as Q
from lexloom.llm.language_id import fit_languages, identify
from lexloom.llm.toxicity import fit_toxicity, score_toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Folders of tables: none holds no row at all, bare holds documents without labels and languages."""
    root = tmp_path_factory.mktemp("tables")
    docs = [(1, "the court said so", None, "s", 17), (2, None, None, None, 0), (3, "", None, "s", 0)]
    for name, rows in (("none", []), ("bare", docs)):
        spark.createDataFrame(rows, DOCS).write.parquet(f"{root}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/{name}/labels.parquet")
    return str(root)


@pytest.mark.parametrize("name", ["op1_toxicity", "op7_language_id", "op11_suffix_dedup", "op12_fill_in_middle"])
def test_queries(spark, tables, name):
    assert Q.queries()[name](spark, os.path.join(tables, "none")).collect() == []
    got = Q.queries()[name](spark, os.path.join(tables, "bare")).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3]


def test_nothing_learnt(spark, tables):
    docs, labels = (spark.read.parquet(f"{tables}/bare/{t}.parquet") for t in ("documents", "labels"))
    assert all(0 <= r.score <= 1 for r in score_toxicity(docs, fit_toxicity(docs, labels)).collect())
    assert {r.lang_pred for r in identify(docs, fit_languages(docs)).collect()} == {"und"}


def test_stages_of_no_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/none/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, f"{tables}/none")
        assert got.count() == 0, name
        if stage is not P.tokenize:
            assert got.columns == docs.columns
    assert corpus_pipeline.run(spark, f"{tables}/none").count() == 0


def test_pipeline_without_labels_or_languages(spark, tables):
    docs = spark.read.parquet(f"{tables}/bare/documents.parquet")
    assert P.drop_toxic(spark, docs, f"{tables}/bare").count() == 3
    assert P.drop_unknown_language(spark, docs, f"{tables}/bare").count() == 0
    assert P.drop_near_duplicates(spark, docs.unionAll(docs), f"{tables}/bare").where(F.col("text") == "the court said so").count() == 1
