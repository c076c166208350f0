"""Mixing sources to target weights by systematic sampling.

Size of a document: its number of words. Sources, in code point order with null last, weigh 5, 2, 1, 5, 2, 1, ... and share
the words of the whole corpus by weight; a target stops at `most` (3) times its source's size and the excess goes to the
others by weight until none is above. All documents of a source have the same expected copies r = target / source size.
Ordered by (size, key) within the source, document number i emits floor(u + r i) - floor(u + r (i - 1)) copies, where u is
the source's one random offset: one copy for each integer that the prefix sum of expected copies crosses. Because the order
is by size, the words taken miss the target by about one document at most.

The prefix sum is distributed (`common.ranked`): a source that holds a third of the corpus spreads over many partitions.
Targets need only the table of sources (one row per source, an aggregate), whose running sums are distributed too. u comes from SHA-256 of seed and source, so
reruns agree. Defined cases: null text has size 0 and takes 0 words; very long texts are counted whole; null sources form one source; rows equal in source,
size and key are interchangeable; an empty table gives an empty result; extra columns pass through `mix_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import before, discard, materialize, placed_by, ranked, small, sums_before, temporary_tables, with_rank

WEIGHTS = (5, 2, 1)


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(starts: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, source_size, target), one row per source, from the starts of `placed_by` source with the sums of size.

    A source's place in code point order is the number of sources that begin in earlier ranges, or before it in its own. It is
    capped if its cap is within its share of what the sources with a smaller cap per weight leave; these come first in order of
    cap / weight, so running sums decide without iterating. Sums run range by range: with URLs as sources this table grows
    with the corpus, and no task sees all of it.
    """
    per = starts.groupBy(F.col("_g").alias("source")).agg(F.sum("size").alias("source_size"), F.min(F.struct("_p", "_first")).alias("_at")).select("source", "source_size", "_at.*")
    begun = per.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before("_p")), F.lit(0)).alias("_begun"))
    nth = F.col("_begun") + F.row_number().over(Window.partitionBy("_p").orderBy("_first")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int")).cast("long")
    per = per.join(F.broadcast(begun), "_p")  # at most one row for each shuffle partition
    per = per.select("source", "source_size", weight.alias("w"), (F.col("source_size") * most).alias("cap"))
    per = sums_before(per, [F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()], ["cap", "w"], "mixing-caps")
    total = lambda df, *columns: [x or 0 for x in df.agg(*map(F.sum, columns)).first()]
    all_size, all_w = total(per, "source_size", "w")
    wide = lambda c: c.cast("decimal(19,0)")  # noqa: E731  # products of words and weights may pass 64 bits
    within_share = wide(F.col("cap")) * wide(F.lit(all_w) - F.col("w_before")) <= wide(F.col("w")) * wide(F.lit(all_size) - F.col("cap_before"))
    per = per.withColumn("capped", within_share)
    capped_size, capped_w = total(per.filter("capped"), "cap", "w")
    left = (F.col("w") * F.lit(all_size - capped_size)).cast("double") / F.lit(float(max(all_w - capped_w, 1)))
    return per.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(left).alias("target"))


def offset(seed: str) -> Column:
    """A number in [0, 1) with 20 bits from the seed and the source, so that sums with ranks stay exact."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("\0null")))
    return F.conv(F.substring(F.sha2(named, 256), 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))


def copies_of(df: DataFrame, keep: list[str], source: str, size: Column, key: str, seed: str, weights: tuple[int, ...], most: int, name: str) -> DataFrame:
    sized = df.select(*keep, F.col(source).alias("source"), size.alias("size"), F.col(key).alias("_key"))
    sized = materialize(sized, f"{name}-sizes")  # texts are read once; cutting ranges reads its input twice
    placed, starts = placed_by(sized, "source", ["size", "_key"], name, ("size",))
    discard(sized)
    with temporary_tables() as keep_table:
        targets = keep_table(materialize(source_targets(starts, weights, most), f"{name}-targets"))
    targets = small(targets).withColumnRenamed("source", "_s")
    placed = with_rank(placed, starts, "source")
    joined = placed.join(targets, placed["source"].eqNullSafe(targets["_s"])).drop("_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = joined.withColumns({"_rate": rate, "_u": offset(seed)})
    upto = lambda r: F.floor(F.col("_u") + F.col("_rate") * r)
    return joined.withColumn("copies", upto(F.col("rank")) - upto(F.col("rank") - 1)).drop("_rate", "_u", "rank")


def mixing_plan(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix-1", weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """key, size, source_size, target, taken (words that the mix takes), copies: one row per row of df."""
    out = copies_of(df, [], source, n_words(text), key, seed, weights, most, "mixing")
    return out.select(F.col("_key").alias(key), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix_documents(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix-1", weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """df with every row repeated as often as the mix takes it (not at all for 0 copies); columns stay as they are.

    Only (source, size, key) is sorted; rows take their copies from a table with one row for each such triple, by a null-safe
    join. Rows that share a triple have the lesser number of copies, and the first by hash of the text have one more, so that
    the sum is that of the plan. No text is written or sorted but those of such rows.
    """
    numbered = df.toDF(*(f"_c{i}" for i in range(len(df.columns))))
    at = {c: f"_c{df.columns.index(c)}" for c in (key, text, source)}
    with temporary_tables() as keep:
        plan = copies_of(numbered, [], at[source], n_words(at[text]), at[key], seed, weights, most, "mixing-plan")
        per = plan.groupBy("source", "size", "_key").agg(F.min("copies").alias("_least"), (F.sum("copies") - F.count(F.lit(1)) * F.min("copies")).alias("_extra"))
        per = keep(materialize(per.filter("_least + _extra > 0").withColumn("_g", F.monotonically_increasing_id()), "mixing-copies"))
    same = F.col(at[source]).eqNullSafe(F.col("source")) & n_words(at[text]).eqNullSafe(F.col("size")) & F.col(at[key]).eqNullSafe(F.col("_key"))
    out = numbered.join(small(per), same).drop("source", "size", "_key").withColumnRenamed("_least", "copies")
    if not per.filter("_extra > 0").isEmpty():
        uneven = ranked(out.filter("_extra > 0").withColumn("_h", F.xxhash64(at[text])), "_g", ["_h"], "mixing-uneven").drop("_h")
        uneven = uneven.withColumn("copies", F.col("copies") + F.when(F.col("rank") <= F.col("_extra"), 1).otherwise(0)).drop("rank")
        out = out.filter("_extra = 0").unionByName(uneven)
    out = out.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(df.columns)))
