"""Dense numbers and ranks over a whole table, without bringing a group or the table into one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

Order = list[str | Column]


def numbered(df: DataFrame, order: Order, column: str = "number", after: int = 0) -> DataFrame:
    """df with `column`, after + 1, after + 2, ... in the order given. Rows equal in it are numbered by their place in df.

    Rows are sorted in ranges, which are written; a range's first number is the count of the rows in earlier ranges, of which the
    driver sees one number a range.
    """
    return _placed(df, order, column, after).drop("_range")


def _placed(df: DataFrame, order: Order, column: str, after: int = 0) -> DataFrame:
    spark, by = df.sparkSession, [*(F.col(c) if isinstance(c, str) else c for c in order), F.col("_tie")]
    held = written(df, "to-number").withColumn("_tie", F.monotonically_increasing_id())
    ranges = held.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by).drop("_tie")
    ranges = written(ranges.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "numbered")
    sizes = sorted(map(tuple, ranges.groupBy("_range").count().collect()))  # one row a range
    starts = list(accumulate((n for _, n in sizes), initial=after))
    first = spark.createDataFrame([(r, start) for (r, _), start in zip(sizes, starts, strict=False)], "_range int, _start long")
    return ranges.join(F.broadcast(first), "_range").withColumn(column, F.col("_start") + F.col("_at") + 1).drop("_at", "_start")


def ranked(df: DataFrame, groups: list[str], order: Order, column: str = "rank") -> DataFrame:
    """df with `column`, the place of each row within its group, from 1. Groups are compared with nulls as equal.

    A group spans as many ranges as it needs. Its rows find the group's first number by (group, range), so that the join is as even
    as the ranges are.
    """
    placed = _placed(df, [*groups, *order], "_number")
    per = placed.groupBy(*groups, "_range").agg(F.min("_number").alias("_first"))
    starts = per.groupBy(*groups).agg(F.min("_first").alias("_start"), F.collect_list("_range").alias("_ranges"))  # at most as many as there are ranges
    starts = starts.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), "_start", F.explode("_ranges").alias("_r"))
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return placed.join(starts, same).withColumn(column, F.col("_number") - F.col("_start") + 1).select(*df.columns, column)
