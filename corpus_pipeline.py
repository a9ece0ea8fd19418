"""A training-corpus pipeline over `documents`: each stage is one operator of adloom.llm and works on all its predecessor kept.

Cases, for every stage: rows with a null doc_id are judged like others; a null text is an empty one; repeated rows are
each judged; other columns, whatever their names, are carried; no documents in, none out. With empty `labels` the base rule
alone rejects and every score is the same; with an empty `benchmark` nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adloom.llm import bpe, decontaminate, quality_rules, quality_trees, simhash
from adloom.llm.common import TEXT_ROWS, table, written


def _quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a learned rule rejects go: a null, empty or short text always does."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def _quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold go. The trees learn from the labels of all documents, also those the rules have rejected: what they kept has hardly a bad one to learn from."""
    return quality_trees.keep_good(docs, table(spark, sf_dir, "labels"), learn_from=table(spark, sf_dir, "documents"))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays; rows without a doc_id all do."""
    return simhash.keep_one(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def _bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and decoded text of every document; an empty text has no ids."""
    return bpe.encode(docs)


STAGES = [
    ("quality rules", _quality_rules),
    ("quality classifier", _quality_classifier),
    ("SimHash near-dedup", _near_dedup),
    ("benchmark decontamination", _decontamination),
    ("BPE encoding and decoding", _bpe),
]
#: The first two stages learn from data, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES one after another over documents; each result is written as Parquet and reread."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), TEXT_ROWS)
    return STAGES[-1][1](spark, docs, sf_dir)
