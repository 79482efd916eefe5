"""From raw documents to packed training sequences, in five stages.

`STAGES` lists (name, function) in order; a function takes (spark, docs, sf_dir) and
returns a DataFrame.  All but the last return the columns of documents, with whole rows
taken out; each works on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardspark.llm import decontamination, dedup, language, packing, quality
from wardspark.llm.common import read, stage


def _reserved(docs: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as no column of documents has."""
    lead = "_"
    while any(lead + name in docs.columns for name in names):
        lead += "_"
    return [lead + name for name in names]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without text or letters go."""
    name, score = _reserved(docs, "language", "language_score")
    found = language.predict_languages(docs, language.learn_languages(docs), (name, score))
    return found.where(F.col(name) != language.UNKNOWN).drop(name, score)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose neighbours vote for quality."""
    model = quality.learn_quality(docs, read(spark, sf_dir, "labels"))
    score, good = _reserved(docs, "quality_score", "is_good")
    return quality.score_quality(docs, model, (score, good)).where(F.col(good) == 1).drop(score, good)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return dedup.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontamination.without_passages(docs, read(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, placed in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

# Learned models and token ids have no SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each one's rows are written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs
