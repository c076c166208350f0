"""Category of a chunk from weighted phrase and structure rules; one generated column per category, no join."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stripped

#: (category, phrases, structure pattern, priority). Fixed values.
RULES = (
    ("formula", (), r"[\w\d]\s*=\s*[\w\d]", 5),
    ("formula", (), r"[\w\d][\s\w\d]*[\+\-\*\/\^][\s\w\d]*[\+\-\*\/\^][\s\w\d]*[\w\d]", 5),
    ("formula", (), r"[a-zA-Z]\w*\s*[\^]\s*\d|[a-zA-Z]\w*\s*[\*\/]\s*[a-zA-Z]", 4),
    ("definition", ("is defined as", "is known as", "is described as"), None, 3),
    ("definition", ("refers to", "denotes", "designates"), None, 3),
    ("definition", ("means", "is called", "is termed"), None, 3),
    ("definition", ("is a type of", "is an instance of", "is a kind of"), None, 3),
    ("definition", (), r"^[A-Za-z][^:]{1,40}:\s+\S", 2),
    ("procedure", ("first", "second", "third", "then", "next", "finally", "after that", "subsequently"), None, 4),
    ("procedure", ("step", "steps", "begin by", "start by", "proceed to"), None, 4),
    ("procedure", (), r"^(step\s+\d|first\b|then\b|next\b|finally\b)", 4),
    ("example", ("for example", "for instance", "as an example"), None, 3),
    ("example", ("e.g.", "i.e.", "such as", "including", "like"), None, 3),
    ("example", ("consider", "take the case", "suppose that", "imagine", "assume"), None, 2),
    ("claim", ("causes", "results in", "leads to", "produces", "prevents", "enables", "increases", "decreases"), None, 2),
    ("claim", ("is", "are", "has", "have", "was", "were", "equals", "contains", "consists of"), None, 2),
    ("claim", ("always", "never", "must", "cannot", "all", "every", "none", "typically"), None, 2),
)
CATEGORIES = ("claim", "definition", "example", "formula", "procedure")
_EDGE = r"[^\p{L}\p{N}_]"


def phrase_pattern(phrase: str) -> str:
    return f"(^|{_EDGE}){re.escape(phrase)}($|{_EDGE})".replace(r"\ ", " ")


def _score(text: Column, category: str, boost: int) -> Column:
    total = F.lit(0)
    for own, phrases, structure, priority in RULES:
        if own == category:
            hits = [(text.contains(p) & text.rlike(phrase_pattern(p))).cast("int") for p in phrases] + ([text.rlike("(?i)" + structure).cast("int")] if structure else [])
            n = sum(hits[1:], hits[0])
            total = total + F.when(n > 0, n + priority).otherwise(0)
    return F.when(total > 0, total + boost).otherwise(0) if category == "definition" else total


def classify(chunks: DataFrame, dictionary: bool = False) -> DataFrame:
    """chunks and category, score, confidence; the greatest score wins, ties go to the first category by name."""
    text = F.lower(stripped("text"))
    scores = F.array(*[F.struct(_score(text, c, 4 if dictionary else 0).alias("score"), F.lit(c).alias("category")) for c in CATEGORIES])
    ranked = chunks.withColumn("_s", scores).withColumn("score", F.array_max(F.transform("_s", lambda x: x["score"])))
    winner = F.element_at(F.filter("_s", lambda x: x["score"] == F.col("score")), 1)["category"]
    return ranked.withColumn("category", F.when(F.col("score") > 0, winner).otherwise("unknown")).withColumn("confidence", F.least(F.lit(1.0), F.col("score") / 10)).drop("_s")
