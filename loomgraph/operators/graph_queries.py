"""Questions to the graph, for many terms at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import definition_term, query_term
from ..session import written


def get_definitions(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """term, found, definition, confidence, node_id, n_candidates for each term: the best by confidence, then least node id.

    The best candidate per term is an aggregate, taken before the join to the terms.
    """
    order = F.struct((-F.col("confidence")).alias("c"), F.col("id"), F.col("definition"))
    best = nodes.groupBy(definition_term(F.col("term")).alias("_k")).agg(F.min(order).alias("b"), F.count(F.lit(1)).alias("n"))
    out = asked.join(best, definition_term(F.col("term")) == F.col("_k"), "left")
    return out.select("term", F.col("b").isNotNull().alias("found"), F.coalesce("b.definition", F.concat(F.lit("No definition found for '"), F.col("term"), F.lit("'."))).alias("definition"), (-F.col("b.c")).alias("confidence"), F.col("b.id").alias("node_id"), F.coalesce("n", F.lit(0)).alias("n_candidates"))


def get_relationships(asked: DataFrame, edges: DataFrame, relation: str) -> DataFrame:
    """term, target, salience, rank: outgoing edges of each term, by salience, then name."""
    own = edges.filter(F.col("relation") == relation)
    out = asked.join(own, query_term(F.col("term")) == F.col("src")).select("term", F.col("dst").alias("target"), "salience")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("salience"), "target")))


def closure(sources: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """source, target, depth, path: all simple paths from each source, up to a mandatory depth.

    One equi-join per step; a path that meets one of its own nodes ends. Edges are deduplicated and pruned to (src, dst).
    """
    steps = edges.select("src", "dst").distinct()
    now = sources.select(F.col("source"), F.col("source").alias("target"), F.lit(0).alias("depth"), F.array("source").alias("path"))
    found = None
    for _ in range(depth):
        now = now.join(steps, F.col("target") == F.col("src")).filter(~F.array_contains("path", F.col("dst")))
        now = now.select("source", F.col("dst").alias("target"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("dst")).alias("path"))
        found = now if found is None else found.unionByName(now)
    return found.withColumn("path", F.array_join("path", ">"))


#: Paths of one task, rows of either side that meet in one block, and rows of a join's key from which it is dealt over tasks. Fixed values.
PATHS_A_TASK, SIDE, HOT = 8_000_000, 4096, 65_536
#: Continuations of a node from which edges to it may be walked forward. Fixed value.
WIDE = 64


def _inner(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """steps: distinct edges between two nodes, dealt by dst; inner: steps that another one leads to.

    Most edges of a wide graph start where none ends. They meet the rest once, in the last step, so only inner ones are walked.
    """
    own = edges.select("src", "dst").filter("src <> dst")
    ends = own.select(F.col("dst").alias("node")).distinct()
    return own.repartition("dst").distinct(), written(own.join(ends, F.col("src") == F.col("node"), "left_semi").distinct(), "inner")


def _counted(df: DataFrame, key: str, count: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias(count))


def _led_to(steps: DataFrame, rest: DataFrame, edges: DataFrame, head: dict[str, Column] = {}, tail: dict[str, Column] = {}) -> DataFrame:
    """steps with columns head, joined to rest with columns tail by dst = node; edges has a row or more for each of steps.

    A node whose edges and rest make many rows is cut on both sides: blocks of SIDE edges meet blocks of SIDE rows of rest, dealt over tasks.
    So what is shuffled goes by the rows of both sides and by the SIDE-th part of the rows made, and a task holds one block. There head and
    tail are made once for each row of a block, not for each row of the join.
    """
    pairs = F.col("_r") * F.col("_s")
    many = _counted(rest, "node", "_r").filter("_r > 1").join(_counted(edges, "dst", "_s"), "_hot").filter(pairs > HOT)
    many = written(many.select("_hot", F.ceil(F.col("_s") / SIDE).alias("_of_i"), F.ceil(F.col("_r") / SIDE).alias("_of_j"), pairs.cast("double").alias("_pairs")), "hot-nodes")
    made = many.agg(F.sum("_pairs")).first()[0]
    if made is None:
        return steps.join(rest, F.col("dst") == F.col("node")).withColumns(head | tail)
    cool = lambda df, key: df.join(many, F.col(key) == F.col("_hot"), "left_anti")
    cut = lambda df, key, own, other: df.join(many, F.col(key) == F.col("_hot")).withColumn(own, F.pmod(F.xxhash64(*df.columns), f"_of{own}")).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"_of{other}") - 1))).select(*df.columns, "_i", "_j")
    tasks = max(min(int(made // PATHS_A_TASK) + 1, 10_000), int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left, right = cut(steps, "dst", "_i", "_j"), cut(rest, "node", "_j", "_i").withColumnsRenamed({"_i": "_ri", "_j": "_rj"})
    heavy = left.repartition(tasks, "dst", "_i", "_j").withColumns(head).join(right.repartition(tasks, "node", "_ri", "_rj").withColumns(tail), (F.col("dst") == F.col("node")) & (F.col("_i") == F.col("_ri")) & (F.col("_j") == F.col("_rj")))
    return cool(steps, "dst").join(cool(rest, "node"), F.col("dst") == F.col("node")).withColumns(head | tail).unionByName(heavy.drop("_i", "_j", "_ri", "_rj"))


def closure_of_all(edges: DataFrame, depth: int = 3) -> DataFrame:
    """What closure() gives when every node is a source: walked from the ends, so that only edges are shuffled, not their paths.

    rest holds the simple paths of up to so many steps that go on from a node; the last join makes the rows. The longest of them are not
    made for an edge u -> v that has fewer edges to u than there are ways on from v: there the edges to u are walked on to v.
    """
    steps, inner = _inner(edges)
    out = steps.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit(1).alias("depth"), F.concat_ws(">", "src", "dst").alias("path"))
    if depth == 1:
        return out
    one = inner.select(F.col("src").alias("node"), F.array("dst").alias("nodes"))
    longer = lambda by, rest: by.join(rest, F.col("dst") == F.col("node")).filter(~F.array_contains("nodes", F.col("src"))).select(F.col("src").alias("node"), F.concat(F.array("dst"), "nodes").alias("nodes"))
    tail = {"target": F.element_at("nodes", -1), "_steps": F.size("nodes"), "_tail": F.concat_ws(">", F.lit(""), "nodes")}
    made = lambda walked, by, head: _led_to(walked, rest, by, {"_head": F.concat_ws(">", *head)}, tail).filter(" and ".join(f"not array_contains(nodes, {c})" for c in head[:-1])).select(F.col("src").alias("source"), "target", (F.col("_steps") + len(head) - 1).alias("depth"), F.concat("_head", "_tail").alias("path"))
    rest, forward = one, None
    for k in range(depth - 2):
        by = inner
        if k == depth - 3:
            rest = rest if k == 0 else written(rest, "rest")
            wide = written(_counted(rest, "node", "_on").filter(F.col("_on") > WIDE), "wide-nodes")
            if not wide.isEmpty():
                to_wide = inner.join(wide, F.col("dst") == F.col("_hot")).drop("_hot").join(_counted(edges, "dst", "_to"), F.col("src") == F.col("_hot")).filter("_to < _on")
                to_wide = written(to_wide.select(F.col("src").alias("via"), F.col("dst").alias("wide")), "to-wide-nodes")
                by = inner.join(to_wide, (F.col("src") == F.col("via")) & (F.col("dst") == F.col("wide")), "left_anti")
                walked = written(steps.join(to_wide, F.col("dst") == F.col("via")).filter("src <> wide").select("src", "via", F.col("wide").alias("dst")), "walked")
                forward = made(walked, walked, ["src", "via", "dst"])
        rest = one.unionByName(longer(by, rest))
    rest = rest if depth == 2 else written(rest, "rest")
    out = out.unionByName(made(steps, edges, ["src", "dst"]))
    return out if forward is None else out.unionByName(forward)


def composed(paths: DataFrame) -> DataFrame:
    """source, target, kind, depth, n_paths: direct targets and, where there is no direct way, indirect ones."""
    out = paths.groupBy("source", "target").agg(F.min("depth").alias("depth"), F.count(F.lit(1)).alias("all_paths"), F.count_if(F.col("depth") == 1).alias("direct_paths"))
    return out.select("source", "target", F.when(F.col("depth") == 1, "direct").otherwise("indirect").alias("kind"), "depth", F.when(F.col("depth") == 1, F.col("direct_paths")).otherwise(F.col("all_paths")).alias("n_paths"))


def cycles(edges: DataFrame) -> DataFrame:
    """src, dst: edges that are answered in the other direction."""
    e = edges.select("src", "dst").distinct()
    return e.alias("x").join(e.alias("y"), (F.col("x.src") == F.col("y.dst")) & (F.col("x.dst") == F.col("y.src"))).select("x.src", "x.dst")


def dataset_lookup(asked: DataFrame, dataset: DataFrame, name: str) -> DataFrame:
    """key, value, hit: the exact key's value, else that of the first key equal in lower case without outer space, else a miss mark."""
    exact = dataset.groupBy("key").agg(F.min_by("value", "seq").alias("exact"))
    loose = dataset.groupBy(F.lower(F.trim("key")).alias("_k")).agg(F.min_by("value", "seq").alias("loose"))
    out = asked.join(exact, "key", "left").join(loose, F.lower(F.trim("key")) == F.col("_k"), "left")
    miss = F.concat(F.lit(f"__lookup_miss__:{name}:"), F.col("key"))
    return out.select("key", F.coalesce("exact", "loose", miss).alias("value"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("loose").isNotNull(), "normalized").otherwise("miss").alias("hit"))


def related_closure(asked: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """term, relation, target, depth, path, n_provenance: all simple paths over edges of the asked relation, one row each.

    asked: term, relation; edges: src, dst, relation, n_provenance. The provenance of a path is that of its edges, counted with
    repeats. One equi-join a step, on (relation, node).
    """
    steps = edges.select(F.col("relation").alias("_rel"), "src", "dst", "n_provenance")
    now = asked.distinct().select("term", "relation", query_term(F.col("term")).alias("_at")).withColumns({"depth": F.lit(0), "path": F.array("_at"), "_n": F.lit(0).cast("long")})
    found = None
    for _ in range(depth):
        now = now.join(steps, (F.col("_at") == F.col("src")) & (F.col("relation") == F.col("_rel"))).filter(~F.array_contains("path", F.col("dst")))
        now = now.select("term", "relation", F.col("dst").alias("_at"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("dst")).alias("path"), (F.col("_n") + F.col("n_provenance")).alias("_n"))
        found = now if found is None else found.unionByName(now)
    return found.select("term", "relation", F.col("_at").alias("target"), "depth", F.array_join("path", " → ").alias("path"), F.col("_n").alias("n_provenance"))


def closure_flags(asked: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """term, relation, n_paths, cycle, fallback: whether a path of fewer than `depth` steps meets one of its own nodes, and whether there is no path."""
    steps = edges.select(F.col("relation").alias("_rel"), "src", "dst")
    asked = asked.distinct()
    now = asked.select("term", "relation", query_term(F.col("term")).alias("_at")).withColumn("path", F.array("_at"))
    all_steps = None
    for _ in range(depth):
        now = now.join(steps, (F.col("_at") == F.col("src")) & (F.col("relation") == F.col("_rel")))
        now = now.select("term", "relation", F.col("dst").alias("_at"), F.array_contains("path", F.col("dst")).alias("_cycle"), F.concat("path", F.array("dst")).alias("path"))
        all_steps = now if all_steps is None else all_steps.unionByName(now)
        now = now.filter("not _cycle").drop("_cycle")
    per = all_steps.groupBy(F.col("term").alias("_t"), F.col("relation").alias("_r")).agg(F.count_if(~F.col("_cycle")).alias("n"), F.max("_cycle").alias("c"))
    out = asked.join(per, (F.col("term") == F.col("_t")) & (F.col("relation") == F.col("_r")), "left")
    return out.select("term", "relation", F.coalesce("n", F.lit(0)).alias("n_paths"), F.coalesce("c", F.lit(False)).alias("cycle"), (F.coalesce("n", F.lit(0)) == 0).alias("fallback"))


def registered_definitions(said: DataFrame) -> DataFrame:
    """said (term, definition, source_id, confidence, step, seq) with one row per normalized term and source: the first by seq."""
    first = said.groupBy(definition_term(F.col("term")).alias("key"), "source_id").agg(F.min(F.struct("seq", "term", "definition", "confidence", "step")).alias("f"))
    return first.select("key", "source_id", "f.term", "f.definition", "f.confidence", "f.step")


def ranked_definitions(asked: DataFrame, registered: DataFrame, nodes: DataFrame) -> DataFrame:
    """term, hit, definition, node_id, confidence, n_candidates, n_provenance: the best of registered ones (salience 1) and of definition nodes.

    registered: key, definition, confidence, step, node_id; nodes: id, term, definition, confidence, salience, step, n_provenance.
    Order: confidence, salience and step falling, then node id. A node that is registered too counts twice in n_provenance.
    """
    known = registered.select("key", "definition", "confidence", F.lit(1.0).alias("salience"), "step", "node_id")
    own = nodes.select(definition_term(F.col("term")).alias("key"), "definition", "confidence", "salience", "step", F.col("id").alias("node_id"))
    counts = nodes.select(F.col("id").alias("node_id"), "n_provenance")
    every = known.unionByName(own).join(counts, "node_id", "left")
    order = F.struct(-F.col("confidence"), -F.col("salience"), -F.col("step"), F.coalesce("node_id", F.lit("")))
    best = every.groupBy("key").agg(F.min_by(F.struct("definition", "node_id", "confidence"), order).alias("b"), F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("n_provenance", F.lit(0))).alias("p"))
    out = asked.join(best, definition_term(F.col("term")) == F.col("key"), "left")
    return out.select("term", F.col("b").isNotNull().alias("hit"), F.col("b.definition").alias("definition"), F.col("b.node_id").alias("node_id"), F.coalesce("b.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("n", F.lit(0)).alias("n_candidates"), F.coalesce("p", F.lit(0)).alias("n_provenance"))


def provenance_line(source_path: Column, source_id: Column, chunk: Column, location: Column, confidence: Column) -> Column:
    """[source: file | chunk: id | loc: place | conf: 0.00], without what is missing; the file is the last part of the path."""
    filled = lambda c: F.when(c.isNotNull() & (c != ""), c)
    source = F.coalesce(F.regexp_extract(filled(source_path), r"([^/]*)$", 1), filled(source_id))
    parts = [F.concat(F.lit(name), value) for name, value in (("source: ", source), ("chunk: ", filled(chunk)), ("loc: ", filled(location)), ("conf: ", F.format_string("%.2f", confidence)))]
    return F.concat(F.lit("["), F.concat_ws(" | ", *parts), F.lit("]"))


def contains(asked: DataFrame, dataset: DataFrame) -> DataFrame:
    """Rows of asked (key) that the dataset has, as they are or in lower case without outer space."""
    return asked.join(dataset.select(F.lower(F.trim("key")).alias("_k")).distinct(), F.lower(F.trim("key")) == F.col("_k"), "left_semi")


def is_miss(value: Column) -> Column:
    return value.startswith("__lookup_miss__")


def registry(versions: DataFrame) -> DataFrame:
    """name, version, content, is_latest, conflict: one row per version of versions (name, version, content, seq), its first content.

    A version that is registered again with the same content is no news, with another one a conflict; the version that was
    registered last stands for the name.
    """
    per = versions.groupBy("name", "version").agg(F.min_by("content", "seq").alias("content"), F.min("seq").alias("_seq"), (F.count_distinct("content") > 1).alias("conflict"))
    last = F.max("_seq").over(Window.partitionBy("name"))
    return per.select("name", "version", "content", (F.col("_seq") == last).alias("is_latest"), "conflict")


#: Types of keys and values that a dataset may have. Fixed values.
SEMANTIC_TYPES = ("Entity", "Relation", "Event", "State", "Process", "Constraint", "Abstraction")


def dataset_faults(name: Column, version: Column, source: Column, records: Column, key_type: Column, value_type: Column) -> Column:
    """Array of what is wrong with a dataset; empty if nothing is. records is its JSON text, which must be an object."""
    empty = lambda c: c.isNull() | (c == "")
    tests = (
        ("name must be non-empty", empty(name)), ("version must be non-empty", empty(version)), ("provenance must include 'source' key", empty(source)), ("records must be a dict", F.coalesce(~F.trim(records).rlike(r"(?s)^\{.*\}$"), F.lit(True))),
        ("key_type is not a valid SemanticType", F.coalesce(~key_type.isin(*SEMANTIC_TYPES), F.lit(True))), ("value_type is not a valid SemanticType", F.coalesce(~value_type.isin(*SEMANTIC_TYPES), F.lit(True))),
    )
    return F.filter(F.array(*[F.when(wrong, text) for text, wrong in tests]), lambda x: x.isNotNull())


# Composition


def _looping(steps: DataFrame, rounds: int) -> DataFrame | None:
    """Edges of which every cycle has all: edges no cycle can hold are peeled off from both ends, `rounds` times; None if nothing is left."""
    for _ in range(rounds):
        steps = steps.join(steps.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        steps = written(steps.join(steps.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "peeled")
        if steps.isEmpty():
            return None
    return steps


def _near_loops(inner: DataFrame, depth: int) -> DataFrame | None:
    """node: those from which a cycle may be met within `depth` steps; None if there is no cycle."""
    loops = _looping(inner, depth)
    if loops is None:
        return None
    near = written(loops.select(F.col("src").alias("node")).distinct(), "near")
    for _ in range(depth):
        near = written(inner.join(near, F.col("dst") == F.col("node"), "left_semi").select(F.col("src").alias("node")).unionByName(near).distinct(), "near")
    return near


def composed_by_counts(sources: DataFrame | None, edges: DataFrame, depth: int = 3) -> DataFrame:
    """What composed(closure(...)) gives, without a row for each path; without sources, for all nodes.

    rest holds, for each node that an edge leads to, (target, steps, count of paths); counts of the same pair add up before the next
    step, so that the work goes by pairs, not by paths. Where no cycle is near, every walk is a simple path. Cycles are what is left
    when edges without a predecessor or successor are peeled off; nodes that come to one are held with the counts that
    pass them, and a step back to a held node is none. All other edges meet the counts once, in the last join.
    """
    steps, inner = _inner(edges)
    ends = edges.filter("src <> dst").select(F.col("dst").alias("node")).distinct()
    if sources is not None:
        steps = steps.join(sources.select(F.col("source").alias("src")).distinct(), "src", "left_semi").select("src", "dst")
    near = _near_loops(inner, depth)
    held = (lambda df: df.withColumn("_near", F.lit(False))) if near is None else (lambda df: df.join(near.withColumn("_near", F.lit(True)), "node", "left"))
    none = F.array().cast("array<string>")
    kept = F.when(F.col("_near"), F.array("node")).otherwise(none)
    one = written(held(ends).select("node", F.col("node").alias("target"), F.lit(0).alias("steps"), F.lit(1).cast("long").alias("n"), kept.alias("held")), "none-yet")
    rest = one
    for _ in range(depth - 1):
        longer = inner.join(rest, F.col("dst") == F.col("node")).filter(~F.array_contains("held", F.col("src"))).groupBy(F.col("src").alias("node"), "target", (F.col("steps") + 1).alias("steps"), "held").agg(F.sum("n").alias("n"))
        rest = one.unionByName(held(longer).withColumn("held", F.concat(kept, "held")).drop("_near"))
    out = _led_to(steps, rest if depth == 1 else written(rest, "rest"), edges).filter(~F.array_contains("held", F.col("src")))
    out = out.groupBy(F.col("src").alias("source"), "target").agg(F.min("steps").alias("_least"), F.sum("n").alias("n"))
    is_direct = F.col("_least") == 0  # one distinct edge
    return out.select("source", "target", F.when(is_direct, "direct").otherwise("indirect").alias("kind"), (F.col("_least") + 1).alias("depth"), F.when(is_direct, F.lit(1).cast("long")).otherwise(F.col("n")).alias("n_paths"))


def reached(asked: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of edges that a path from asked (term, relation) can take, with `inner`: whether an edge of the same relation leads to its src.

    Such an edge starts at an asked node or where another one ends. All edges are shuffled once here, so that what follows goes by those that count.
    """
    node = lambda df, relation, at, end: df.select(F.col(relation).alias("_rel"), at.alias("_node"), F.lit(end).alias("inner"))
    nodes = node(asked, "relation", query_term(F.col("term")), False).unionByName(node(edges, "relation", F.col("dst"), True)).groupBy("_rel", "_node").agg(F.max("inner").alias("inner"))
    return edges.join(nodes, (F.col("relation") == F.col("_rel")) & (F.col("src") == F.col("_node"))).select(*(edges[c] for c in edges.columns if c != "inner"), nodes["inner"])


#: Inner nodes up to which the traces of longer paths are picked before they are shuffled. Fixed value.
INNER_NODES = 100_000


def composed_by_relation(asked: DataFrame, edges: DataFrame, prov: DataFrame, depth: int = 3) -> DataFrame:
    """term, relation, target, kind, depth, n_paths, first_path, n_provenance, best_trace: targets over edges of the asked relation.

    A direct target hides indirect ways to it. first_path is the shortest kept path, then the least; provenance is that of
    the edges of all kept paths, each trace id once; the best has the greatest confidence, then the least id.
    prov: src, dst, relation, trace_id, confidence; edges: src, dst, relation, best as reached() gives them.

    A direct target is one edge, so it takes what its edge's traces come to, without a row for each path. Only longer paths are written, cut into
    their edges and grouped; their first steps are those that lead to an inner edge.
    """
    key, edge = ["term", "relation", "target"], ["relation", "src", "dst"]
    steps = (edges if "inner" in edges.columns else written(reached(asked, edges), "reached")).filter("src <> dst").select(*edge, "inner")
    starts = asked.select("term", "relation", query_term(F.col("term")).alias("_at")).repartition("relation", "_at").distinct()

    blank = [F.lit(None).cast(t).alias(c) for c, t in (("trace_id", prov.schema["trace_id"].dataType), ("confidence", prov.schema["confidence"].dataType))]
    both = steps.select(*edge, F.lit(False).alias("_prov"), *blank).unionByName(prov.select(*edge, F.lit(True).alias("_prov"), "trace_id", "confidence"))
    once = both.repartition("relation", "src").groupBy(*edge, "_prov", "trace_id").agg(F.max("confidence").alias("confidence"))
    best = F.min_by("trace_id", F.when(F.col("_prov"), F.struct(-F.col("confidence"), "trace_id")))
    each = once.groupBy(*edge).agg(F.count_if("_prov").alias("n_provenance"), best.alias("best_trace"), F.min("_prov").alias("_no_step")).filter("not _no_step")
    e = each.select(F.col("relation").alias("_rel"), "src", F.col("dst").alias("target"), "n_provenance", "best_trace")
    at = (F.col("relation") == F.col("_rel")) & (F.col("_at") == F.col("src"))
    direct = starts.join(e, at).select(*key, F.lit("direct").alias("kind"), F.lit(1).alias("depth"), F.lit(1).cast("long").alias("n_paths"), F.concat_ws(" → ", "src", "target").alias("first_path"), "n_provenance", "best_trace")
    if depth == 1:
        return direct

    inner = written(steps.filter("inner").select(F.col("relation").alias("_rel"), "src", "dst").distinct(), "inner")
    first = steps.join(inner.select("_rel", F.col("src").alias("_next")), (F.col("relation") == F.col("_rel")) & (F.col("dst") == F.col("_next")), "left_semi").select(F.col("relation").alias("_rel"), "src", "dst")
    now = starts.join(first.repartition("_rel", "src").distinct(), at).select("term", "relation", F.array("src", "dst").alias("path"))
    longer = None
    for _ in range(depth - 1):
        now = now.join(inner, (F.col("relation") == F.col("_rel")) & (F.element_at("path", -1) == F.col("src"))).filter(~F.array_contains("path", F.col("dst"))).select("term", "relation", F.concat("path", F.array("dst")).alias("path"))
        longer = now if longer is None else longer.unionByName(now)
    longer = longer.select("term", "relation", F.element_at("path", -1).alias("target"), "path")
    is_direct = (F.col("relation") == F.col("_rel")) & (F.get("path", F.lit(0)) == F.col("src")) & (F.col("target") == F.col("dst"))
    kept = written(longer.join(steps.select(F.col("relation").alias("_rel"), "src", "dst"), is_direct, "left_anti"), "kept-paths")
    hops = kept.select(*key, F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("src"), F.element_at("path", i + 1).alias("dst")))).alias("h")).select(*key, "h.src", "h.dst").distinct()
    nodes = inner.select("_rel", F.col("src").alias("_node")).distinct()
    if nodes.limit(INNER_NODES + 1).count() <= INNER_NODES:  # edges of longer paths lead to an inner node or start at one
        met = lambda at: prov.join(F.broadcast(nodes), (F.col("relation") == F.col("_rel")) & (F.col(at) == F.col("_node")), "left_semi")
        prov = met("dst").unionByName(met("src"))  # twice is as good as once
    traces = hops.join(prov, edge).groupBy(*key, "trace_id").agg(F.max("confidence").alias("confidence"))
    told = traces.groupBy(*key).agg(F.count(F.lit(1)).alias("n_provenance"), F.min_by("trace_id", F.struct(-F.col("confidence"), "trace_id")).alias("best_trace"))
    path = F.array_join("path", " → ")
    out = kept.groupBy(*key).agg((F.min(F.size("path")) - 1).alias("depth"), F.count(F.lit(1)).alias("n_paths"), F.min_by(path, F.struct(F.size("path"), path)).alias("first_path")).join(told, key, "left")
    return direct.unionByName(out.select(*key, F.lit("indirect").alias("kind"), "depth", "n_paths", "first_path", F.coalesce("n_provenance", F.lit(0)).alias("n_provenance"), "best_trace"))


def one_hop(asked: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """term, relation, hit, target, is_node, salience, confidence, rank: outgoing edges of each asked (term, relation), a row without target where there is none.

    edges: src, dst, relation, salience, confidence (the greatest of their provenance, null without any); nodes: value. Order: confidence falling
    (0 without any), then target. A target without a node is named, but is_node is false.
    """
    asked = asked.select("term", "relation").distinct().withColumn("_at", query_term(F.col("term")))
    own = edges.select(F.col("src").alias("_at"), "relation", F.col("dst").alias("target"), "salience", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    known = nodes.select(F.col("value").alias("target")).distinct().withColumn("_node", F.lit(True))
    out = asked.join(own, ["_at", "relation"], "left").join(known, "target", "left")
    rank = F.row_number().over(Window.partitionBy("term", "relation").orderBy(F.desc("confidence"), "target"))
    hit = F.col("target").isNotNull()
    return out.select("term", "relation", hit.alias("hit"), "target", F.when(hit, F.coalesce("_node", F.lit(False))).alias("is_node"), "salience", F.when(hit, F.col("confidence")).alias("confidence"), F.when(hit, rank).alias("rank"))
