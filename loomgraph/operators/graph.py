"""Nodes, edges and provenance: building, merging, decay. Grouping keys are content hashes, sums are partial before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import node_id, trace_id
from .numbering import ranked

DECAY, FLOOR = 0.95, 0.01


def edge_table(triples: DataFrame, confidence: float = 0.75) -> DataFrame:
    """src, dst, relation, salience, n_documents, first_doc: one row per distinct edge of (doc_id, src, relation, dst)."""
    return triples.groupBy("src", "dst", "relation").agg(F.lit(confidence).alias("salience"), F.count_distinct("doc_id").alias("n_documents"), F.min("doc_id").alias("first_doc"))


def term_nodes(edges: DataFrame, sem_type: str = "Entity", salience: float = 0.5) -> DataFrame:
    """id, value, sem_type, salience: one node per distinct term of the edges."""
    values = edges.select(F.explode(F.array("src", "dst")).alias("value")).distinct()
    return values.select(node_id(F.lit(sem_type), F.col("value")).alias("id"), "value", F.lit(sem_type).alias("sem_type"), F.lit(salience).alias("salience"))


def definition_nodes(definitions: DataFrame) -> DataFrame:
    """id, value, term, definition, confidence, doc_id: one node per distinct statement; of repeats the smallest (doc_id, pos) stays."""
    said = F.concat("term", F.lit(" is "), "definition", F.lit("."))
    rows = definitions.select(node_id(F.lit("Entity"), said).alias("id"), said.alias("value"), "term", "definition", "confidence", "doc_id", "pos")
    first = rows.groupBy("id").agg(F.min(F.struct("doc_id", "pos", "value", "term", "definition", "confidence")).alias("f"))
    return first.select("id", "f.value", "f.term", "f.definition", "f.confidence", "f.doc_id")


def insert_absent(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """nodes and those of new whose id is not there."""
    return nodes.unionByName(new.dropDuplicates(["id"]).join(nodes.select("id"), "id", "left_anti"))


def insert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges with new ones, both src, dst, relation, salience, trace_ids: a known edge keeps its salience and takes trace ids that it lacks.

    trace_ids is a map from id to step, so that merging is a union of keys; one aggregate over both tables.
    """
    both = edges.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    each = both.select("src", "dst", "relation", "salience", "_new", F.explode_outer(F.map_entries("trace_ids")).alias("_e"))
    first = each.groupBy("src", "dst", "relation").agg(F.min_by("salience", F.struct("_new", -F.col("salience"))).alias("salience"), F.min("_new").alias("_least"))
    ids = each.filter("_e is not null").groupBy("src", "dst", "relation", F.col("_e.key").alias("_id")).agg(F.min_by(F.col("_e.value"), F.struct("_new", "_e.value")).alias("_step"))
    ids = ids.groupBy("src", "dst", "relation").agg(F.count(F.lit(1)).alias("n_traces"), F.min(F.struct("_step", "_id")).alias("_f"))
    out = first.join(ids, ["src", "dst", "relation"], "left")
    return out.select("src", "dst", "relation", "salience", (F.col("_least") == 1).alias("is_new"), F.coalesce("n_traces", F.lit(0)).alias("n_traces"), F.col("_f._id").alias("first_trace"))


#: Kinds of sources that a provenance may name. Fixed values.
SOURCE_TYPES = ("dataset", "document", "execution")


def provenance_faults(source_id, source_type, method, confidence, trace, step):
    """Array of what is wrong with a provenance; empty if nothing is."""
    missing = lambda c: c.isNull() | (c == "")
    tests = (
        ("source_id", missing(source_id)), ("source_type", missing(source_type) | ~source_type.isin(*SOURCE_TYPES)), ("extraction_method", missing(method)),
        ("confidence", confidence.isNull() | ~confidence.between(0.0, 1.0)), ("trace_id", missing(trace)), ("timestamp_index", step.isNull() | (step < 0)),
    )
    return F.filter(F.array(*[F.when(F.coalesce(wrong, F.lit(True)), name) for name, wrong in tests]), lambda x: x.isNotNull())


def merge_outcome(known_value, known_traces, new_value, new_trace):
    """conflict (another value), known (the trace is there) or merged."""
    return F.when(~known_value.eqNullSafe(new_value), "conflict").when(F.array_contains(known_traces, new_trace), "known").otherwise("merged")


def chosen_provenance(results: DataFrame, lookups: DataFrame) -> DataFrame:
    """results (id, value, operator) with source_id, method, confidence: that of the first dataset lookup with the value, else the execution's."""
    hits = lookups.filter("hit").groupBy(F.col("value").alias("_v")).agg(F.min_by("dataset", "seq").alias("_d"))
    out = results.join(hits, F.col("value") == F.col("_v"), "left")
    found = F.col("_d").isNotNull()
    return out.select(*results.columns, F.when(found, F.concat(F.lit("dataset:"), "_d")).otherwise(F.concat(F.lit("execution:"), "operator")).alias("source_id"), F.when(found, "dataset_lookup").otherwise("execution").alias("method"), F.when(found, 1.0).otherwise(0.9).alias("confidence"))


#: Types of leaves that become nodes, and what a first and a later mention adds to salience. Fixed values.
TRACKED = ("Entity", "Relation", "Event", "State", "Process")
ROOT, ROOT_AGAIN, LEAF, LEAF_AGAIN = 1.0, 0.5, 0.8, 0.25


def imported(bundles: DataFrame, last: int) -> DataFrame:
    """node, salience, n after importing execution results (step, graph, node, type, is_root) in order of step, with decay after each step.

    A node that is new counts as its role says; later mentions reinforce it. Leaves of other types, and the root among its own
    leaves, are left out. All mentions are summed as later ones; what the first one adds beyond that is put on its step. So a
    node that every result mentions needs aggregates only.
    """
    kept = bundle_mentions(bundles)
    again = F.when(F.col("is_root"), ROOT_AGAIN).otherwise(LEAF_AGAIN)
    per = kept.groupBy("node", "step").agg(F.sum(again).alias("amount"), F.count(F.lit(1)).alias("n"))
    first = kept.groupBy("node").agg(F.min(F.struct("step", "graph", (~F.col("is_root")).alias("leaf"))).alias("f"))
    news = first.select("node", "f.step", F.when(F.col("f.leaf"), LEAF - LEAF_AGAIN).otherwise(ROOT - ROOT_AGAIN).alias("amount"))
    said = per.select("node", "step", "amount").unionByName(news)
    return reinforced(said, "node", "step", "amount", last).join(per.groupBy("node").agg(F.sum("n").alias("n")), "node")


def bundle_mentions(bundles: DataFrame) -> DataFrame:
    """Roots and tracked leaves other than their root, with the root of their graph as `root`."""
    roots = bundles.filter("is_root").select("step", "graph", F.col("node").alias("root"))
    return bundles.join(roots, ["step", "graph"]).filter(F.col("is_root") | (F.col("type").isin(*TRACKED) & (F.col("node") != F.col("root"))))


def imported_edges(bundles: DataFrame, salience: float = ROOT) -> DataFrame:
    """src, dst, relation, salience, step, graph: leaf -> root, labelled with the leaf's type; of repeats the first import stays."""
    leaves = bundle_mentions(bundles).filter("not is_root")
    first = leaves.groupBy(F.col("node").alias("src"), F.col("root").alias("dst"), F.col("type").alias("relation")).agg(F.min(F.struct("step", "graph")).alias("f"))
    return first.select("src", "dst", "relation", F.lit(salience).alias("salience"), "f.step", "f.graph")


def imported_events(bundles: DataFrame, failures: DataFrame) -> DataFrame:
    """step, graph, event_type, node, metadata: add_node or reinforce_node for each root, failure for each failed graph (step, graph, errors).

    A root adds its node if no mention comes before it. A failure with errors is an event without a node; failures make no nodes.
    """
    first = bundle_mentions(bundles).groupBy("node").agg(F.min(F.struct("step", "graph", (~F.col("is_root")).alias("leaf"))).alias("f"))
    roots = bundles.filter("is_root").select("step", "graph", "node").join(first, "node")
    is_new = (F.col("step") == F.col("f.step")) & (F.col("graph") == F.col("f.graph"))
    told = roots.select("step", "graph", F.when(is_new, "add_node").otherwise("reinforce_node").alias("event_type"), "node", F.lit("").alias("metadata"))
    failed = failures.filter(F.size("errors") > 0)
    text = F.concat(F.lit("graph "), F.col("graph").cast("string"), F.lit(": "), F.col("errors")[0])
    return told.unionByName(failed.select("step", "graph", F.lit("failure").alias("event_type"), F.lit(None).cast("string").alias("node"), text.alias("metadata")))


def by(table: DataFrame, **equals) -> DataFrame:
    """Rows of nodes or edges with the given values; filters reach the scan."""
    for column, value in equals.items():
        table = table.filter(F.col(column) == value)
    return table


def provenance(triples: DataFrame, method: str = "relationship_extractor", confidence: float = 0.75) -> DataFrame:
    """src, dst, relation, trace_id, source_id, step, confidence: one row per edge and source, the first statement of each."""
    rows = triples.groupBy("src", "dst", "relation", "doc_id").agg(F.min("pos").alias("step"))
    source = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    return rows.select("src", "dst", "relation", trace_id(source, method, F.col("step")).alias("trace_id"), source.alias("source_id"), "step", F.lit(confidence).alias("confidence"))


def merged_provenance(prov: DataFrame) -> DataFrame:
    """src, dst, relation, trace_id, place (from 1): distinct trace ids of an edge in order of (step, trace_id), one row each.

    A trace id counts with its first step. Rows, not a list, ranked over sorted ranges: an edge that a third of all documents
    state is spread over many tasks.
    """
    once = prov.groupBy("src", "dst", "relation", "trace_id").agg(F.min("step").alias("step"))
    return ranked(once, ["src", "dst", "relation"], ["step", "trace_id"], "place").select("src", "dst", "relation", "trace_id", F.col("place").cast("int").alias("place"))


def top_provenance(prov: DataFrame, n: int = 3) -> DataFrame:
    """The n provenance rows per edge with the greatest confidence, then the least trace id.

    Every task keeps n rows of an edge at most before they meet: the limit on the rank is taken on both sides of the shuffle.
    """
    order = Window.partitionBy("src", "dst", "relation").orderBy(F.desc("confidence"), "trace_id")
    return prov.dropDuplicates(["src", "dst", "relation", "trace_id"]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def decayed(salience, steps):
    """Salience after a number of steps without reinforcement."""
    return F.greatest(F.lit(FLOOR), salience * F.pow(F.lit(DECAY), steps))


#: Steps of a node that are folded together before its blocks are.
BLOCK = 512


def reinforced(events: DataFrame, node: str, step: str, amount: str, last: int) -> DataFrame:
    """node, salience at step `last`: every step adds its amounts, then decays, never below the floor.

    Amounts of a step add up first (an aggregate with partial sums). What a run of steps makes of a salience x is max(low, x * rate + gain),
    and two such runs make another of that form. So a node's steps are folded in blocks of BLOCK steps, in tasks of their
    own, and only the blocks of a node meet: a node with a million steps is two thousand rows there.
    """
    per = events.groupBy(F.col(node).alias("node"), F.col(step).alias("step")).agg(F.sum(amount).alias("amount"))
    one = F.struct(F.col("step").cast("long").alias("first"), F.col("step").cast("long").alias("last"), F.lit(FLOOR).alias("low"), F.lit(DECAY).alias("rate"), (F.col("amount") * DECAY).cast("double").alias("gain"))
    runs = per.select("node", F.floor(F.col("step") / BLOCK).alias("_block"), one.alias("run"))

    def then(a, b):
        """Run a, the steps without amounts between, run b."""
        rate = b["rate"] * F.pow(F.lit(DECAY), b["first"] - a["last"] - 1)
        low = F.greatest(b["low"], F.when(b["first"] - a["last"] > 1, F.lit(FLOOR) * b["rate"] + b["gain"]).otherwise(b["low"]), a["low"] * rate + b["gain"])
        return F.struct(a["first"].alias("first"), b["last"].alias("last"), low.alias("low"), (a["rate"] * rate).alias("rate"), (a["gain"] * rate + b["gain"]).alias("gain"))

    def folded(rows: DataFrame, *keys: str) -> DataFrame:
        in_order = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("run")).alias("s"))
        return in_order.select(*keys, F.aggregate(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), F.element_at("s", 1), then).alias("run"))

    done = folded(folded(runs, "node", "_block"), "node")
    salience = F.greatest(F.col("run.low"), F.col("run.gain"))  # a node begins with 0
    return done.select("node", F.round(decayed(salience, F.lit(last) - F.col("run.last")), 9).alias("salience"))
