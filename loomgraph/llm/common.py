"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

#: ASCII white space, the only word separators of these operators: \x20 and \x09-\x0D.
#: bytes.split() and bytes.lower() of Python work on exactly this set and on A-Z.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, megabytes: int = 8) -> None:
    """Arrow batches sent to Python hold at most about this much, however long single texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; one of our own only where it names none and runs in one process (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


_SCOPES: list[list[DataFrame]] = []


@contextmanager
def temporary_tables() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that materialize() writes inside are deleted at the end, also after a failure, but for those given to keep().

    What leaves the block must read kept tables only. Kept tables belong to the block around this one, if there is one.
    """
    own: list[DataFrame] = []
    last: list[DataFrame] = []

    def keep(t: DataFrame) -> DataFrame:
        last.append(t)
        return t

    _SCOPES.append(own)
    try:
        yield keep
    finally:
        _SCOPES.pop()
        discard(*(t for t in own if not any(t is k for k in last)))
        if _SCOPES:
            _SCOPES[-1].extend(last)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends at replicated files, not at an executor."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.written_at = at
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() whose readers have all been written themselves."""
    for t in tables:
        discard_folder(t.sparkSession, t.written_at)


def discard_folder(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if its row count is within the bound; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= most_rows else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_ranges(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """df range-partitioned and sorted on keys, as a written table; `_pid` numbers the ranges, `_at` rises within each.

    Rows equal in all keys are told apart by their place in df (which is read from files, so that a task that runs again finds
    the same places); very many of them spread over ranges like any others.
    """
    order = [*keys, F.col("_tie")]
    placed = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    return materialize(placed.drop("_tie").withColumns({"_pid": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), name)


def before(order: str, *groups: str) -> WindowSpec:
    """All earlier rows of the groups."""
    return Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def placed_by(df: DataFrame, group: str, order: list[str | Column], name: str, sums: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """df in ranges of (group with nulls last, order), and its starts: a row for each group and range that has it.

    A start has `_g`, `_p`, the number of rows of the group in earlier ranges as `_before`, its first place as `_first`, and sums.
    """
    placed = in_ranges(df, [F.col(group).asc_nulls_last(), *[F.col(c) if isinstance(c, str) else c for c in order]], name)
    starts = placed.groupBy(group, "_pid").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(c) for c in sums])
    starts = starts.select(F.col(group).alias("_g"), F.col("_pid").alias("_p"), "_first", F.coalesce(F.sum("_n").over(before("_pid", group)), F.lit(0)).alias("_before"), *sums)
    return placed, materialize(starts, f"{name}-starts")


def with_rank(placed: DataFrame, starts: DataFrame, group: str) -> DataFrame:
    starts = small(starts.select("_g", "_p", "_first", "_before"))
    out = placed.join(starts, placed[group].eqNullSafe(starts["_g"]) & (placed["_pid"] == starts["_p"]))
    return out.withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_pid", "_at", "_g", "_p", "_first", "_before")


def ranked(df: DataFrame, group: str, order: list[str | Column], name: str) -> DataFrame:
    """Add `rank` (from 1) of each row within its group, without bringing a group into one task.

    Rows are range-partitioned on (group, order), so a hot group spans many partitions; the position in a partition
    comes from the sorted order and only per-partition group starts (a few rows a partition) go through a window.
    Rows equal in group and order are interchangeable. Null groups form a group of their own.
    """
    return with_rank(*placed_by(df, group, order, name), group)


def sums_before(df: DataFrame, order: list[Column], sums: list[str], name: str) -> DataFrame:
    """Add `<column>_before` for each of sums: its total over the rows that come earlier in the order (0 for the first).

    The order must tell all rows apart, so that no range is hot; sums run within each range, and only one row a range goes
    through a window of its own.
    """
    placed = in_ranges(df, order, name)
    ranges = placed.groupBy("_pid").agg(*[F.sum(c).alias(c) for c in sums])
    ranges = ranges.select("_pid", *[F.coalesce(F.sum(c).over(before("_pid")), F.lit(0)).alias(f"_{c}") for c in sums])
    out = placed.join(F.broadcast(ranges), "_pid")  # at most one row for each shuffle partition
    return out.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(before("_at", "_pid")), F.lit(0)) + F.col(f"_{c}") for c in sums}).drop("_pid", "_at", *(f"_{c}" for c in sums))


def components(nodes: DataFrame, edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """(node, label) for every row of nodes; label is the smallest node reachable over edges (a, b).

    Random contraction: in each round every node moves to the neighbour (or itself) with the smallest hash under the
    round's salt, and on to that one's choice; end points of edges are replaced, loops dropped. A constant share of the
    nodes disappears each round whatever the shape (path, star, clique). Every round is a written table.
    """
    current = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    current = materialize(current, f"{name}-edges")
    touched = current.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = touched.select("node", F.col("node").alias("root"))
    for salt in range(most_rounds):
        if current.isEmpty():
            break
        both = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pick = lambda c: F.struct(F.xxhash64(c, F.lit(salt)).alias("h"), F.col(c).alias("to"))
        to = both.groupBy("a").agg(F.min(pick("b")).alias("m")).select(F.col("a").alias("v"), F.least(F.col("m"), pick("a"))["to"].alias("p"))
        step = to.alias("x").join(to.alias("y"), F.col("x.p") == F.col("y.v")).select(F.col("x.v").alias("v"), F.col("y.p").alias("p"))
        step = materialize(step, f"{name}-step")
        roots = roots.join(small(step), roots["root"] == step["v"], "left").select("node", F.coalesce("p", "root").alias("root"))
        a, b = step.select(F.col("v").alias("a"), F.col("p").alias("pa")), step.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = current.join(a, "a").join(b, "b").filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        current = materialize(moved.distinct(), f"{name}-edges")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = materialize(roots, f"{name}-roots")
    least = roots.groupBy("root").agg(F.min("node").alias("label"))
    label = roots.join(least, "root").select("node", "label")
    return nodes.select("node").join(label, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
