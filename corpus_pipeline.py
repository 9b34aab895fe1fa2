"""A training corpus from ``documents``: quality rules, language identification, near-copy
removal, source mixing and packing. Every stage reads what the one before kept.

Extra columns of the table pass through unchanged; a stage keeps them in one struct, so
their names cannot clash with its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.llm import jaccard_join, language_id, mixing, packing, quality_rules
from tidepanel.llm.common import cut_lineage, table
from tidepanel.llm.queries import tokenizer_path

ACCEPTED = language_id.LANGUAGES


def _held(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text", "lang", "source")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of policy v1 rejects."""
    ledger = quality_rules.ledger(quality_rules.measure(_held(docs), keep=("row",)))
    return quality_rules.apply_policy(ledger, "v1").filter("kept").select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose fused posterior is sure of one of the accepted languages; the declared
    language is evidence and the source stands for the host."""
    found = language_id.identify(_held(docs), declared="lang", host=F.col("source"), keep=("row",))
    return found.filter(F.col("language").isin(*ACCEPTED) & (F.col("confidence") >= language_id.CONFIDENCE)).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.take(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality),
    ("language_id", language),
    ("ngram_jaccard_join", near_copies),
    ("source_mixing", mixture),
    ("best_fit_packing", sequences),
]

# Tokens, seeded sampling and text likelihoods have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
