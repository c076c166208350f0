"""Candidates against known nodes: duplicates, conflicts, scores, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Weight of a source type in the score. Fixed values.
SOURCE_WEIGHTS = {"dataset": 1.0, "execution": 0.8, "document": 0.6}


#: Weight of the confidence, and that of definitions which dictionary mode finds in documents. Fixed values.
CONFIDENCE, DICTIONARY_CONFIDENCE = 0.7, 0.85
DEFINITION_METHODS = ("definition_extractor", "pattern_v1")


def quality_score(confidence, source_type, filled, method=None, mode="document"):
    """0.7 confidence (0.85 for definitions of documents in dictionary mode) + 0.2 source weight + 0.1 share of the three optional fields that are filled, within 0 and 1."""
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in SOURCE_WEIGHTS.items() for x in p]), source_type), F.lit(0.5))
    trusted = F.when((source_type == "document") & method.isin(*DEFINITION_METHODS), DICTIONARY_CONFIDENCE).otherwise(CONFIDENCE) if mode == "dictionary" else F.lit(CONFIDENCE)
    held = F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), trusted * held + 0.2 * weight + 0.1 * filled / 3))


def decide(candidates: DataFrame, nodes: DataFrame, mode: str = "document") -> DataFrame:
    """candidate_id, decision, score, node_id: conflict (a node of the same place with another value, the least id of these) before merge before reject (score below 0.5) before accept.

    candidates: candidate_id, value, source_id, chunk_id, method, source_type, confidence, filled; nodes: id, value, source_id,
    chunk_id, method. Every lookup is an equi-join on a side that an aggregate has made unique.
    """
    same = nodes.groupBy("value").agg(F.min("id").alias("exact_id"))
    loose = nodes.groupBy(F.lower(F.trim("value")).alias("_k")).agg(F.min("id").alias("loose_id"))
    spot = ["source_id", "chunk_id", "method"]
    each = nodes.filter("value is not null").groupBy(*spot, "value").agg(F.min("id").alias("id"))
    # The two least ids of different values are enough: one of them is not the candidate's own. The limit is taken before the shuffle, too.
    two = each.withColumn("_n", F.row_number().over(Window.partitionBy(*spot).orderBy("id"))).filter("_n <= 2")
    place = two.groupBy(*spot).agg(F.min(F.struct("id", "value")).alias("least"), F.max(F.struct("id", "value")).alias("next"))
    out = candidates.join(same, "value", "left").join(loose, F.lower(F.trim("value")) == F.col("_k"), "left").join(place, spot, "left")
    differs = lambda which: F.when(F.col(f"{which}.value") != F.col("value"), F.col(f"{which}.id"))
    rival = F.when(F.col("chunk_id").isNotNull(), F.coalesce(differs("least"), differs("next")))
    known = F.coalesce("exact_id", "loose_id")
    score = quality_score(F.col("confidence"), F.col("source_type"), F.col("filled"), F.col("method"), mode)
    decision = F.when(rival.isNotNull(), "conflict").when(known.isNotNull(), "merge").when(score < 0.5, "reject").otherwise("accept")
    return out.select("candidate_id", decision.alias("decision"), F.round(score, 6).alias("score"), F.coalesce(rival, known).alias("node_id"))
