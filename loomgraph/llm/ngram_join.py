"""N-gram Jaccard join: candidates must share prefix tokens under several different global orders, before exact verification.

A document's set holds its distinct `words`-word shingles (64-bit hashes of them). Equal sets are one node, named by a 64-bit
hash of the set, so copies need no join to collapse: their rows are equal, and aggregates merge them before they shuffle. (A
false match of two hashes has a chance of 2^-64; of n different sets n^2 / 2^65 pairs would be taken for copies, 0.03 of 10^9.)
Steps, each a written table where it is read more than once:

1. One pass over all texts: set size, node, and per task counts of shingles in 2^20 buckets. The counts of all documents add up
   to a table of bounded size (1 MB in logarithms) that gives the global orders: rarer buckets first. Buckets only guide the
   orders; any total order gives the same result.
2. Prefix filter under the first order: two sets with Jaccard >= t share a token among their first n - ceil(t n) + 1. Prefixes
   under two more orders (coarser rarity classes, other permutations) are kept as 16-bit tokens, for the intersection. So are
   parity bits: one for each shingle, up to the next power of two; bits that differ are no more than tokens that only one set
   has, and wider ones fold to narrower. 1024 folded bits go into joins, all of them into the last filter. No filter loses a link.
3. Stars: in each posting the node of the smallest key leads (copies come after what they copy), and all others are paired with it: as many pairs as postings, however
   large a group of near copies is. Pairs must pass the size filter and share tokens under all orders; what is left is verified
   on the full sets. Verified pairs give components.
4. Rest: a link that the stars did not find joins two components. So only postings with several components are left, and of
   those only pairs without the leader, with one side outside its component. They pass the same filters inside the join, are
   verified, and complete the components. No pair with a link between components is skipped, so the components are exact.

Hot keys: counting and leaders are aggregates with partial sums, equal sets collapse before pairing, and joins on hot tokens,
nodes or leaders are plain equi-joins of written tables, which the skew join splits.

Defined cases: A-Z are lower-cased, words are runs of characters other than \\x20 and \\x09-\\x0D; a text of fewer words than a
shingle has its whole sequence as one; null, empty and blank texts have empty sets and link with nothing; very long texts are
read whole; rows that repeat a key are one document with several texts; rows without a key link with nothing and have no
component; an empty table gives an empty result; other columns pass by, whatever their names. Keys are whole numbers (they are
cast to long; a key that is no number has no component).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, components, discard, materialize, small, temporary_tables

_BITS = 20
_SLICE = 1 << 12
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


@dataclass(frozen=True)
class JoinRule:
    """Documents link if percent * union <= 100 * intersection."""

    words: int = 3
    percent: int = 90

    def prefix(self, n: int) -> int:
        return n - -(-n * self.percent // 100) + 1


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(_ODD[salt % 5])
        h = (h ^ (h >> np.uint64(32))) * np.uint64(_ODD[(salt + 1) % 5])
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    own = text.lower().split()
    n = len(own)
    if not n:
        return np.zeros(0, np.uint64)
    if n < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(own), seed=n)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, n)
    with np.errstate(over="ignore"):
        out = np.zeros(n - words + 1, np.uint64)
        for i in range(words):
            out = (out ^ (out >> np.uint64(27))) * np.uint64(_ODD[i % 5]) + h[i : n - words + 1 + i]
    return np.unique(_mixed(out, 0))


def links(a: np.ndarray, b: np.ndarray, rule: JoinRule) -> bool:
    if not len(a) or not len(b):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= rule.percent * (len(a) + len(b) - both)


def prefixes(h: np.ndarray, rarity: np.ndarray, rule: JoinRule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First tokens of a set under three global orders; 64-bit under the first, 16-bit under the others."""
    p = rule.prefix(len(h)) - 1
    q = rarity[(h >> np.uint64(64 - _BITS)).astype(np.int64)].astype(np.uint64)
    first = h[np.argpartition((q << np.uint64(56)) | (_mixed(h, 1) >> np.uint64(8)), p)[: p + 1]] if len(h) > 1 else h
    more = []
    for salt in (2, 3):
        m = _mixed(h, salt)
        key = ((q >> np.uint64(4)) << np.uint64(60)) | (m >> np.uint64(4))
        at = np.argpartition(key, p)[: p + 1] if len(h) > 1 else slice(None)
        more.append(np.unique((m[at] & np.uint64(0xFFFF)).astype(np.uint16)).view(np.int16))
    return first.view(np.int64), more[0], more[1]


def node_of(h: np.ndarray) -> int:
    """The name of a set: a signed 64-bit hash."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))).view(np.int64))


def parities(h: np.ndarray) -> np.ndarray:
    """One bit per token, up to a power of two and 1024 at least, as longs: the parity of the number of tokens in each bucket."""
    width = max(1024, 1 << (len(h) - 1).bit_length())
    bits = np.bincount((_mixed(h, 4) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.to_pylist()]


def _counted(rule: JoinRule):
    """Rows of documents (id, n, node) and, at the end of a task, of its bucket counts (slice, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, task = np.zeros(1 << _BITS, np.uint32), 0
        for batch in batches:
            sets = [shingle_set(t, rule.words) for t in _texts(batch.column(1))]
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
            counts += np.bincount((flat >> np.uint64(64 - _BITS)).astype(np.int64), minlength=1 << _BITS).astype(np.uint32)
            ids = batch.column(0)
            task = xxhash.xxh3_64_intdigest(str(ids[0]) + str(len(ids))) if not task and len(ids) else task
            nothing = pa.nulls(len(sets), pa.int32())
            nodes = pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), nodes, nothing, nothing, pa.nulls(len(sets), pa.binary())], names=_COUNTED)
        if counts.any():
            slices = [counts[i : i + _SLICE].tobytes() for i in range(0, len(counts), _SLICE)]
            m = len(slices)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(range(m), pa.int32()), pa.array([task % 1000] * m, pa.int32()), pa.array(slices, pa.binary())], names=_COUNTED)

    return run


_COUNTED = ["id", "n", "node", "slice", "part", "counts"]


def _summed(table: pa.Table) -> pa.Table:
    total = np.zeros(_SLICE, np.uint64)
    for c in table["counts"]:
        raw = c.as_buffer()
        total += np.frombuffer(raw, np.uint32 if raw.size == 4 * _SLICE else np.uint64)
    return pa.table({"slice": table["slice"][:1], "counts": pa.array([total.tobytes()], pa.binary())})


def rarity_table(counted: DataFrame) -> np.ndarray:
    """Logarithm (in 1/8 of an octave, 8 bits) of each bucket's count over all documents; two levels of sums, 1 MB in the end."""
    schema = "slice int, counts binary"
    level = counted.filter("slice is not null").groupBy("slice", "part").applyInArrow(_summed, schema)
    rows = level.groupBy("slice").applyInArrow(_summed, schema).collect()
    out = np.zeros(1 << _BITS)
    for r in rows:
        out[r["slice"] * _SLICE : (r["slice"] + 1) * _SLICE] = np.frombuffer(bytes(r["counts"]), np.uint64)
    return np.minimum(255, 8 * np.log2(out + 1)).astype(np.uint8)


_SIGNED = "node long, id long, n int, p1 array<long>, p2 array<short>, p3 array<short>, odd array<long>"
_FOLDED = [f"f{i}" for i in range(16)]


def _signed(rule: JoinRule, rarity):
    """A row for each node of a task, or more: copies that one task sees are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = rarity.value, set()
        for batch in batches:
            own: dict[int, np.ndarray] = {}
            ids: dict[int, int] = {}
            for i, t in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                h = shingle_set(t, rule.words)
                if len(h) and (node := node_of(h)) not in seen:
                    own[node], ids[node] = h, i
                    seen.add(node)
            signed = [(*prefixes(h, table, rule), parities(h)) for h in own.values()]
            columns = [pa.array([x[i] for x in signed], pa.list_(k)) for i, k in enumerate((pa.int64(), pa.int16(), pa.int16(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(ids.values(), pa.int64()), pa.array(map(len, own.values()), pa.int32()), *columns], names=["node", "id", "n", "p1", "p2", "p3", "odd"])

    return run


def _verified(rule: JoinRule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = None, np.zeros(0, np.uint64)  # pairs with the same first text come one after another
        for batch in batches:
            good = []
            for a, b, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch.column(2)), _texts(batch.column(3)), strict=True):
                if ta != known:
                    known, own = ta, shingle_set(ta, rule.words)
                other = shingle_set(tb, rule.words)
                good.append(links(own, other, rule) and node_of(own) == a and node_of(other) == b)  # a repeated key has texts of other nodes
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _alike(a: str, b: str, rule: JoinRule) -> Column:
    """The size filter."""
    return (F.col(f"{a}.n") * 100 >= F.col(f"{b}.n") * rule.percent) & (F.col(f"{b}.n") * 100 >= F.col(f"{a}.n") * rule.percent)


def _few(differing: Column, a: str, b: str, rule: JoinRule) -> Column:
    """No more differing parities than linked sets may have differing tokens."""
    return differing * (100 + rule.percent) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (100 - rule.percent)


def _folded(i: int) -> Column:
    """The i-th of 16 longs to which parities fold."""
    return F.aggregate(F.filter("odd", lambda _, at: at % 16 == i), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))


def _near_folded(a: str, b: str, rule: JoinRule) -> Column:
    first, *more = (F.bit_count(F.col(f"{a}.{f}").bitwiseXOR(F.col(f"{b}.{f}"))) for f in _FOLDED)
    return _few(sum(more, first), a, b, rule)


def _near(a: str, b: str, rule: JoinRule) -> Column:
    """By all parities; sets of similar size have as many, or one has twice as many."""
    x, y = F.col(f"{a}.odd"), F.col(f"{b}.odd")
    half = lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) / 2), F.slice(c, F.size(c) / 2 + 1, F.size(c) / 2), lambda p, q: p.bitwiseXOR(q))
    left, right = F.when(F.size(x) > F.size(y), half(x)).otherwise(x), F.when(F.size(y) > F.size(x), half(y)).otherwise(y)
    return _few(F.aggregate(F.zip_with(left, right, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, m: n + m), a, b, rule)


def filtered(pairs: DataFrame, signed: DataFrame, rule: JoinRule) -> DataFrame:
    """The pairs (a, b), a written table, of similar size that share tokens under the other orders and are near by parities."""
    sides = small(materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ngram-filter-sides"))
    sign = materialize(signed.select("node", "n", "p2", "p3", "odd").join(sides, "node", "left_semi").dropDuplicates(["node"]), "ngram-filter")
    y = sign.alias("y").join(small(pairs), F.col("b") == F.col("y.node"))
    share = F.arrays_overlap(F.col("x.p2"), F.col("y.p2")) & F.arrays_overlap(F.col("x.p3"), F.col("y.p3"))
    return sign.alias("x").join(y, F.col("a") == F.col("x.node")).filter(_alike("x", "y", rule)).filter(share).filter(_near("x", "y", rule)).select("a", "b")


def verify(pairs: DataFrame, texts: DataFrame, reps: DataFrame, rule: JoinRule) -> DataFrame:
    """The pairs (a, b), a written table, whose texts link; written too. Only texts of some pair are dealt out."""
    sides = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sides = materialize(reps.join(sides, "node").select("node", F.col("rep").alias("id")), "ngram-sides")
    own = materialize(texts.join(small(sides), "id").select("node", "text"), "ngram-texts")
    b = own.select(F.col("node").alias("b"), F.col("text").alias("text_b")).join(small(pairs), "b")
    both = b.join(own.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    out = materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(_verified(rule), "a long, b long").distinct(), "ngram-verified")
    discard(sides, own)
    return out


def labelled_sets(df: DataFrame, key: str, text: str, rule: JoinRule) -> tuple[DataFrame, DataFrame]:
    """Two written tables: (id, n, node) for each row of df, and (_k, label) for each node."""
    spark = df.sparkSession
    bounded_batches(spark, 4)
    texts = df.select(F.col(key).try_cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    counted = materialize(texts.mapInArrow(_counted(rule), "id long, n long, node long, slice int, part int, counts binary"), "ngram-sets")
    documents = materialize(counted.filter("slice is null").select("id", "n", "node"), "ngram-documents")
    rarity = spark.sparkContext.broadcast(rarity_table(counted))
    discard(counted)
    texts = texts.filter("id is not null")
    named = documents.filter("node is not null and id is not null")
    reps = materialize(named.groupBy("node").agg(F.min("id").alias("rep")), "ngram-reps")
    signed = materialize(texts.mapInArrow(_signed(rule, rarity), _SIGNED), "ngram-prefixes")

    postings = signed.select("node", "id", "n", F.explode("p1").alias("token"))
    leaders = postings.groupBy("token").agg(F.min_by("node", "id").alias("leader"), F.min_by("n", "id").alias("leader_n"), F.min("n").alias("_least"), F.max("n").alias("_most"), F.count(F.lit(1)).alias("_rows"))
    leaders = leaders.filter("_rows > 1").filter((F.col("_rows") > 2) | (F.col("_least") * 100 >= F.col("_most") * rule.percent))  # two sets of unlike size are no pair
    leaders = materialize(leaders.select("token", "leader", "leader_n"), "ngram-leaders")
    shared = materialize(postings.drop("id").join(leaders, "token").filter("node <> leader"), "ngram-postings")  # shuffled at every size
    discard(leaders)
    star = shared.filter((F.col("n") * 100 >= F.col("leader_n") * rule.percent) & (F.col("leader_n") * 100 >= F.col("n") * rule.percent))
    pairs = materialize(star.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "ngram-star-pairs")
    star = materialize(filtered(pairs, signed, rule), "ngram-stars")
    found = verify(star, texts, reps, rule)
    label = materialize(components(reps.select("node"), found, "ngram-stars"), "ngram-labels")

    # The leader's own pairs are decided; what is open is between the others of a posting.
    told = shared.join(label, "node").select("token", "node", "n", "leader", "label")
    some = told.groupBy("token").agg(F.min("label").alias("_l"), F.max("label").alias("_m"), F.min("n").alias("_least"), F.max("n").alias("_most"), F.count(F.lit(1)).alias("_rows"))
    some = some.filter("_l <> _m").filter((F.col("_rows") > 2) | (F.col("_least") * 100 >= F.col("_most") * rule.percent)).select("token")
    some = materialize(some, "ngram-open-tokens")
    heads = label.select(F.col("node").alias("leader"), F.col("label").alias("lead_label"))
    told = materialize(told.join(small(some), "token", "left_semi").join(heads, "leader").select("token", "node", "n", "label", "lead_label"), "ngram-open")
    discard(shared, some)
    ids = materialize(told.select("node").distinct(), "ngram-open-nodes")
    short = signed.join(small(ids), "node", "left_semi").select("node", *(_folded(i).alias(f) for i, f in enumerate(_FOLDED))).distinct()
    rest = materialize(told.join(short, "node"), "ngram-rest")
    discard(told, ids)
    outside, every = rest.filter("label <> lead_label").alias("x"), rest.alias("y")
    once = (F.col("y.label") == F.col("y.lead_label")) | (F.col("x.node") < F.col("y.node"))
    more = outside.join(every, (F.col("x.token") == F.col("y.token")) & (F.col("x.label") != F.col("y.label")) & once & _alike("x", "y", rule) & _near_folded("x", "y", rule))
    more = more.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    more = materialize(more.join(star, ["a", "b"], "left_anti"), "ngram-rest-pairs")
    discard(rest)
    more_star = materialize(filtered(more, signed, rule), "ngram-rest-stars")
    discard(signed)
    # Rows that repeat a key are linked: each node of such a key with the key's least node.
    twice = materialize(named.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("_b")).filter("a < _b").select("id", "a"), "ngram-twice")
    sure = named.join(small(twice), "id").select("a", F.col("node").alias("b")).filter("a <> b").distinct()
    extra = verify(more_star, texts, reps, rule) if not more_star.isEmpty() else spark.createDataFrame([], "a long, b long")
    sure = materialize(extra.unionByName(sure), "ngram-rest-links")
    if not sure.isEmpty():
        over = lambda c: F.col(c).alias("node")
        linked = sure.join(label.select(over("node").alias("a"), F.col("label").alias("la")), "a").join(label.select(over("node").alias("b"), F.col("label").alias("lb")), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        joined = components(label.select(F.col("label").alias("node")).distinct(), linked, "ngram-all")
        label = materialize(label.join(joined.select(F.col("node").alias("label"), F.col("label").alias("least")), "label").select("node", F.col("least").alias("label")), "ngram-all-labels")
    # A component is named by its smallest key.
    keys = reps.join(label, "node")
    least = materialize(keys.groupBy("label").agg(F.min("rep").alias("component")), "ngram-least")
    final = label.join(least, "label").select(F.col("node").alias("_k"), F.col("component").alias("label"))
    return documents, materialize(final, "ngram-final")


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", rule: JoinRule = JoinRule()) -> DataFrame:
    """key, n_shingles, component_id (smallest key reachable by links): one row per row of df."""
    with temporary_tables() as keep:
        documents, final = map(keep, labelled_sets(df, key, text, rule))
    out = documents.join(final, F.col("node") == F.col("_k"), "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("label", "id")).alias("component_id"))


def distinct_documents(df: DataFrame, key: str = "doc_id", text: str = "text", rule: JoinRule = JoinRule()) -> DataFrame:
    """df with one document of each group of linked ones: that with the smallest key, of a repeated key the first by text.

    Documents without links and rows without a key stay as they are.
    """
    with temporary_tables() as keep:
        groups = keep(materialize(jaccard_components(df, key, text, rule), "ngram-groups"))
        gone = keep(materialize(groups.filter(F.col("component_id") != F.col(key)).select(F.col(key).alias("_gone")).distinct(), "ngram-gone"))
    kept = df.join(small(gone), F.col(key) == F.col("_gone"), "left_anti")
    again = groups.filter("component_id is not null").groupBy(key).count().filter("count > 1").select(F.col(key).alias("_again"))
    if again.isEmpty():
        return kept
    first = kept.join(again, F.col(key) == F.col("_again"), "left_semi").withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(text)))
    return kept.join(again, F.col(key) == F.col("_again"), "left_anti").unionByName(first.filter("_nth = 1").drop("_nth"))
