"""What a log of executions tells: patterns worth an encoding, faults of candidates, and replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frequent_encodings(graphs: DataFrame, least: int = 3) -> DataFrame:
    """signature, frequency, ratio: signatures that occur `least` times or more, and what naming each once would save."""
    n = graphs.groupBy("signature").agg(F.count(F.lit(1)).alias("frequency")).filter(F.col("frequency") >= least)
    return n.withColumn("ratio", 1 - 1 / F.col("frequency"))


def candidate_faults(deterministic: Column, lossless: Column, cheaper: Column, version: Column, benchmarked: Column) -> Column:
    """Array of the rules that a candidate breaks; empty if it passes."""
    tests = (("deterministic", deterministic), ("lossless_unless_declared", lossless), ("improves_cost", cheaper), ("versioned", version.isNotNull() & (version != "")), ("passes_benchmarks", benchmarked))
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in tests]), lambda x: x.isNotNull())


def replayed(events: DataFrame) -> DataFrame:
    """trace, stages (consecutive repeats once, joined by arrows), last_of per stage as a map, from events (trace, seq, stage, payload).

    The repeats go in a window over one trace; a trace is one query's dozen of events.
    """
    before = F.lag("stage").over(Window.partitionBy("trace").orderBy("seq"))
    marked = events.withColumn("_new", ~before.eqNullSafe(F.col("stage")))
    stages = F.array_sort(F.collect_list(F.when(F.col("_new"), F.struct("seq", "stage"))))
    last = marked.groupBy("trace", "stage").agg(F.max_by("payload", "seq").alias("payload"))
    last = last.groupBy("trace").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("stage", "payload")))).alias("last_of"))
    out = marked.groupBy("trace").agg(F.array_join(F.transform(stages, lambda x: x["stage"]), " → ").alias("stages"))
    return out.join(last, "trace")


def without_nulls(record: Column) -> Column:
    """A map without its null values: what lossless compression leaves of a record whose missing keys read as null."""
    return F.map_filter(record, lambda _, v: v.isNotNull())
