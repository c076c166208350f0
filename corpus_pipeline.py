"""From raw documents to packed token sequences: quality rules, near-duplicates, secrets, source weights, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import mixing, ngram_join, packing, quality_rules, secret_scan
from loomgraph.llm.common import discard, materialize, table

#: Five words and similarity 0.8; the 3 words and 90 percent of op5 are its own contract.
NEAR_COPIES = ngram_join.JoinRule(words=5, percent=80)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their failing lines."""
    return quality_rules.clean_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, by NEAR_COPIES."""
    return ngram_join.distinct_documents(docs, rule=NEAR_COPIES)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return secret_scan.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", keep_quality), ("n-gram Jaccard join", drop_near_copies), ("secret scans", redact_secrets), ("mixing sources", mix_sources), ("packing", pack)]

#: Tokens of a byte-pair encoding and a packing plan are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        discard(*written)  # the stage before has no reader any more
        written = [docs]
    out = STAGES[-1][1](spark, docs, sf_dir)
    discard(*written)  # packing has written its pieces
    return out
