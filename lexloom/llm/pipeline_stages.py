"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import broadcast_if_small, columns_of, unused, written
from .bpe import digests, encode
from .jaccard_join import jaccard_components
from .language_id import UNKNOWN, fit_languages, identify
from .mixing import mix
from .toxicity import fit_toxicity, score_toxicity

#: Documents go from this toxicity score on, where op1_toxicity calls them toxic, and below this probability of their
#: language.
REJECT_TOXIC, MIN_LANGUAGE = 0.3, 0.4
#: Words of the encoder's dictionary and of a task's own: fewer than by default, as executors that ran the stages before
#: have less memory left.
SHARED_WORDS = 60_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below REJECT_TOXIC; learnt from the labels table. Null and empty texts and
    documents without a label stay; repeated rows are each judged alike; an empty table stays empty; columns of any
    name pass unchanged."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = unused("__toxicity", docs.columns)
    return score_toxicity(docs, model, docs.columns, score).where(F.col(score) < REJECT_TOXIC).drop(score)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be told; lang becomes the prediction. Null texts and texts without a letter
    go; of an empty table, or one without any lang, nothing is learnt and nothing stays; repeated rows are each judged
    alike; other columns of any name pass unchanged."""
    names = [unused(f"__{n}", docs.columns) for n in ("language", "probability", "bits")]
    found = identify(docs, fit_languages(docs), docs.columns, tuple(names))
    stay = found.where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= MIN_LANGUAGE))
    return stay.withColumn("lang", F.col(names[0])).drop(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links: the one with the least doc_id. Where doc_ids repeat or are null, each
    row is a document of its own, null ids come last and of rows with one doc_id any one stays. Null, empty and blank
    texts link with nothing, so their rows all stay; columns of any name pass unchanged; an empty table stays empty."""
    total, different = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    row = unused("__row", docs.columns)
    if total == different:
        found = written(jaccard_components(docs).where("doc_id = component_id").select("doc_id"), "kept")
        return docs.join(broadcast_if_small(found), "doc_id", "left_semi").select(*columns_of(docs))
    keyed = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = jaccard_components(keyed, row, "text").select(F.col("doc_id").alias("id"), "component_id")
    ids = keyed.select(F.col(row).alias("id"), F.col("doc_id").alias("doc"))
    first = found.join(ids, "id").groupBy("component_id").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "id")).alias("first"))
    stay = written(first.select(F.col("first.id").alias(row)), "kept")
    return keyed.join(broadcast_if_small(stay), row, "left_semi").drop(row)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics come near their tempered shares. Null and empty texts
    hold no tokens and go; a null source or language is a value of its own; repeated rows share one draw; columns of any
    name pass unchanged; an empty table stays empty."""
    names = [unused(f"__{n}", docs.columns) for n in ("n_tokens", "mix_topic", "weight", "probability", "sampled")]
    return mix(docs, outputs=names).where(F.col(names[4])).drop(*names)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, n_tokens and the digests of ids and decoded bytes. Null and empty texts
    have no tokens; repeated rows and null doc_ids each give a row; other columns are left out; an empty table gives an
    empty result."""
    return digests(encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, dictionary=SHARED_WORDS, remembered=SHARED_WORDS))
