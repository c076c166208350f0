"""Stored graphs, resumed books, stream states, compositions with cycles, numbering, SQL functions: small cases and plans."""

import math
import os
import random
import uuid
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import sql as sql_functions
from loomgraph.functions import typed
from loomgraph.operators import chunking, extraction, graph, graph_queries, numbering, validation
from loomgraph.sources.graph_store import GraphStore, rebuilt_definitions
from loomgraph.plans import stored
from loomgraph.streaming import books, salience

EDGE, TRACE = "src string, dst string, relation string, salience double, step long", "src string, dst string, relation string, trace_id string, step long"
NODE = "id string, value string, sem_type string, salience double, step long, source_id string, method string, confidence double, trace_id string"


@pytest.fixture
def store(spark, tmp_path):
    return GraphStore(spark, f"file://{tmp_path}/graph", 16)


def edges(spark, n, salience=0.75, first=0):
    return spark.range(first, first + n).selectExpr("concat('s', id) as src", "concat('d', id % 3) as dst", "'r' as relation", f"{salience}D as salience", "id as step")


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_upsert_leaves_other_buckets_and_versions(spark, store, tmp_path):
    assert store.read("edges").count() == 0 and store.manifest()["version"] == 0
    assert store.upsert(edges=edges(spark, 200)) == 1
    before, first = files(tmp_path), store.manifest()
    again = spark.createDataFrame([("s7", "d1", "r", 0.1, 1), ("s7", "new", "r", 0.5, 3), (None, None, None, None, None), (None, None, None, None, None)], EDGE)
    assert store.upsert(edges=again) == 2
    second = store.manifest()
    changed = [b for b, at in second["tables"]["edges"].items() if first["tables"]["edges"].get(b) != at]
    assert 1 <= len(changed) <= 2 and before.items() <= files(tmp_path).items()
    rows = {(r.src, r.dst): r.salience for r in store.read("edges").collect()}
    assert len(rows) == 202 and rows["s7", "d1"] == 0.75 and rows["s7", "new"] == 0.5 and rows[None, None] is None
    assert store.read("edges", version=1).count() == 200
    assert store.vacuum(1) == len([b for b in changed if b in first["tables"]["edges"]]) and store.versions() == [2] and store.read("edges").count() == 202


class Late(GraphStore):
    """Another writer publishes first, once."""

    rival = None

    def _publish(self, manifest):
        if self.rival:
            rival, self.rival = self.rival, None
            GraphStore(self.spark, self.path, self.buckets).upsert(**rival)
        return super()._publish(manifest)


def test_a_lost_race_is_merged_again(spark, store):
    event = spark.range(40).selectExpr("id as step", "'add_node' as event_type", "concat('n', id) as node", "'' as metadata")
    trace = spark.createDataFrame([("a", "b", "r", "t1", 5)], TRACE)
    late = Late(spark, store.path, 16)
    late.rival = {"edges": spark.createDataFrame([("a", "b", "r", 0.3, 9)], EDGE), "traces": trace, "events": event}
    version = late.upsert(edges=spark.createDataFrame([("a", "b", "r", 0.9, 1), ("c", "d", "r", 0.9, 1)], EDGE), traces=spark.createDataFrame([("a", "b", "r", "t1", 1), ("a", "b", "r", "t2", 1)], TRACE), events=event)
    assert version == 2
    assert sorted(map(tuple, store.read("edges").collect())) == [("a", "b", "r", 0.3, 9), ("c", "d", "r", 0.9, 1)]
    assert sorted((r.trace_id, r.step) for r in store.read("traces").collect()) == [("t1", 5), ("t2", 1)]
    assert sorted(r.number for r in store.read("events").collect()) == list(range(1, 81))
    with pytest.raises(ValueError):
        GraphStore(spark, store.path, 8).upsert(edges=edges(spark, 1))


def test_lookups_read_one_bucket_and_filters_reach_it(spark, store):
    store.upsert(edges=edges(spark, 3000))
    one = store.find("edges", src="s77")
    assert len(one.inputFiles()) < 3 < len(store.read("edges").inputFiles()) and [r.step for r in one.collect()] == [77]
    assert "EqualTo(src,s77)" in one._jdf.queryExecution().executedPlan().toString()
    asked = spark.createDataFrame([("s5",), ("s6",), ("nobody",), (None,)], "src string")
    assert sorted(r.src for r in store.find_all("edges", asked).collect()) == ["s5", "s6"]


def test_bucketed_tables_join_without_a_shuffle(spark, store):
    store.upsert(edges=edges(spark, 500), nodes=spark.range(500).selectExpr("concat('n', id) as id", "concat('s', id) as value", "'Entity' as sem_type", "1D as salience", "id as step", "'x' as source_id", "'m' as method", "0.5D as confidence", "'t' as trace_id", "parse_json('{}') as metadata"))
    names = [f"{t}_{uuid.uuid4().hex}" for t in ("edges", "nodes")]
    try:
        left, right = store.bucketed("edges", names[0], "src", 4), store.bucketed("nodes", names[1], "value", 4)
        joined = left.hint("merge").join(right, F.col("src") == F.col("value"))
        assert joined.count() == 500 and "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_definitions_are_rebuilt_after_a_load(spark, store):
    rows = spark.createDataFrame([("1", "a is b.", "Entity", 1.0, 4, "doc:1", "m", 0.7, "t"), ("2", "c is d.", "Entity", 1.0, 5, None, None, None, None), ("3", "x", "Entity", 1.0, 0, "s", "m", 0.5, "t"), ("4", "y", "Entity", 1.0, 0, "s", "m", 0.5, "t")], NODE)
    about = F.expr("""element_at(map('1', '{"category": "definition", "term": "a", "definition_text": "a is b."}', '2', '{"category": "definition", "term": "c"}', '3', '{"category": "definition", "term": ""}', '4', '{"other": [1]}'), id)""")
    store.upsert(nodes=rows.withColumn("metadata", F.parse_json(about)))
    found = rebuilt_definitions(store.read("nodes"))
    assert sorted(map(tuple, found.collect())) == [("a", "a is b.", "doc:1", 0.7, 4, "1"), ("c", "c is d.", "unknown", 0.8, 5, "2")]
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "metadata:variant" not in scan  # the scan reads paths, not whole metadata


BOOKS = [(k, f"front\nChapter 1: Terms\nForce {k} is a push. Mass is matter of a body.\nA port depends on ships and trade.\nA harbour is a place for ships.\n# Chapter Two\nThe harbour number {k} is a very old place on a long coast.\n\nTrade uses ships of all nations and ports.\nCHAPTER III\n") for k in range(12)]


def contents(store):
    out = [sorted(map(tuple, store.read(t).drop("metadata").collect()), key=repr) for t in ("nodes", "edges", "traces")]
    return [*out, sorted(map(tuple, rebuilt_definitions(store.read("nodes")).collect()), key=repr)]


def test_a_stopped_book_run_goes_on(spark, tmp_path):
    rows = spark.createDataFrame([*BOOKS, (None, "Chapter 1\nlost"), (99, None), (98, "")], "doc_id long, text string")
    for k in range(3):
        rows.filter(F.coalesce(F.col("doc_id"), F.lit(0)) % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stores = [GraphStore(spark, f"file://{tmp_path}/g{k}", 8) for k in range(2)]
    stream = lambda: books.book_stream(spark, f"{tmp_path}/in", 1)
    whole = books.ingest_books(stream(), f"file://{tmp_path}/a0", stores[0], 2)
    seen = []

    def stop(batch, part):
        seen.append((batch, part))
        if len(seen) in (2, 3):
            raise RuntimeError("stopped")

    for _ in range(2):
        with pytest.raises(Exception, match="stopped"):
            books.ingest_books(stream(), f"file://{tmp_path}/a1", stores[1], 2, stop)
    resumed = books.ingest_books(stream(), f"file://{tmp_path}/a1", stores[1], 2, stop)
    assert len(seen) == len(set(seen)) == 6  # no part is done twice
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, resumed.collect()), key=repr) and contents(stores[0]) == contents(stores[1])
    assert whole.filter("status = 'complete'").count() == 24 and books.book_status(whole).filter("chapters = 3").count() == 12
    version = stores[1].manifest()["version"]
    assert books.ingest_books(stream(), f"file://{tmp_path}/a1", stores[1], 2).count() == resumed.count() and stores[1].manifest()["version"] == version
    nodes = stores[0].read("nodes").select(F.variant_get("metadata", "$.chunk_mode", "string").alias("mode"), F.variant_get("metadata", "$.line_index", "int").alias("line"))
    assert {r.mode for r in nodes.collect()} == {"glossary", "paragraph"} and nodes.filter("(mode = 'glossary') <> (line is not null)").count() == 0


def plain_salience(rows, last):
    per = defaultdict(lambda: defaultdict(float))
    for node, step, amount in rows:
        per[node][step] += amount
    out = {}
    for node, steps in per.items():
        s = 0.0
        for t in range(min(steps), last + 1):
            s = max(0.01, (s + steps.get(t, 0.0)) * 0.95)
        out[node] = round(s, 9)
    return out


def test_salience_of_many_steps_and_over_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(1, t, 0.5) for t in range(1, 2000)] + [(rng.randint(2, 40), rng.randint(1, 2000), rng.choice([0.25, 0.5, -0.4])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "node long, step long, amount double")
    want = plain_salience(rows, 2000)
    assert {r.node: r.salience for r in graph.reinforced(df, "node", "step", "amount", 2000).collect()} == pytest.approx(want, abs=2e-9)
    at = f"file://{tmp_path}/in"
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(at)
    for lo, hi in ((0, 500), (500, 1300)):
        df.filter((F.col("step") > lo) & (F.col("step") <= hi)).coalesce(1).write.mode("append").parquet(at)
    salience.run_salience(spark, stream(), 1300, at=f"file://{tmp_path}/state").count()
    df.filter("step > 1300").coalesce(1).write.mode("append").parquet(at)
    got = salience.run_salience(spark, stream(), 2000, at=f"file://{tmp_path}/state")  # goes on with the state of the first call
    assert {r.node: r.salience for r in got.collect()} == pytest.approx(want, abs=2e-9)


def test_numbers_and_ranks_of_hot_groups(spark):
    rows = spark.range(4000).selectExpr("if(id % 3 = 0, null, id % 5) as g", "if(id % 2 = 0, 7, id % 100) as x", "id")
    got = numbering.ranked(rows, ["g"], ["x", "id"]).collect()
    want = defaultdict(list)
    for r in rows.collect():
        want[r.g].append((r.x, r.id))
    assert {(r.g, r.id): r["rank"] for r in got} == {(g, i): k + 1 for g, own in want.items() for k, (_, i) in enumerate(sorted(own))}
    numbers = numbering.numbered(rows.select("g"), ["g"], after=10)
    assert sorted(r.number for r in numbers.collect()) == list(range(11, 4011)) and numbering.numbered(rows.limit(0), ["x"]).count() == 0
    # One edge with all traces: tasks keep three rows each before the shuffle, places are those of one sorted list.
    prov = spark.range(5000).selectExpr("if(id < 9000, 'a', 'z') as src", "'b' as dst", "'r' as relation", "concat('t', id) as trace_id", "id % 50 as step", "(id % 10) / 10.0D as confidence")
    top = graph.top_provenance(prov)
    assert [(r.trace_id, r["rank"]) for r in top.orderBy("rank").collect()] == [("t1009", 1), ("t1019", 2), ("t1029", 3)] and top._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2
    places = graph.merged_provenance(prov).orderBy("place").collect()
    assert [r.trace_id for r in places] == [f"t{i}" for i in sorted(range(5000), key=lambda i: (i % 50, f"t{i}"))] and [r.place for r in places] == list(range(1, 5001))


def simple_paths(links, source, depth):
    out, now = [], [[source]]
    for _ in range(depth):
        now = [p + [y] for p in now for y in sorted(links[p[-1]]) if y not in p]
        out += now
    return out


def test_many_small_files_of_books_are_one_batch(spark, tmp_path, monkeypatch):
    """Batches go by bytes, as each of them rewrites the store; a stopped run keeps its chapters, so that they are made once."""
    spark.createDataFrame([(str(i), BOOKS[0][1]) for i in range(20)], "doc_id string, text string").repartition(20, "doc_id").write.option("maxRecordsPerFile", 1).parquet(f"file://{tmp_path}/in")
    store, made, own = GraphStore(spark, f"file://{tmp_path}/g", 2), [], books.chunking.chapters
    monkeypatch.setattr(books.chunking, "chapters", lambda df: made.append(1) or own(df))
    stream = lambda: books.book_stream(spark, f"{tmp_path}/in")

    def stop(batch, part):
        raise RuntimeError(f"behind part {part}")

    with pytest.raises(Exception, match="behind part 0"):
        books.ingest_books(stream(), f"file://{tmp_path}/a", store, 2, stop)
    done = books.ingest_books(stream(), f"file://{tmp_path}/a", store, 2)
    assert done.select("doc_id").distinct().count() == 20 and done.groupBy("doc_id", "chapter").count().filter("count > 1").isEmpty()
    assert store.manifest()["version"] == 2 and len(made) == 1
    assert not (tmp_path / "a" / "chapters" / "batch=0").exists()


@pytest.mark.parametrize("seed", range(3))
def test_composition_by_counts_equals_paths(spark, seed):
    rng = random.Random(seed)
    pairs = {(f"n{rng.randint(0, 14)}", f"n{rng.randint(15, 29)}") for _ in range(25)} | {(f"n{rng.randint(15, 29)}", f"n{rng.randint(30, 40)}") for _ in range(25)} | {(f"m{a}", f"m{b}") for a, b in ((rng.randint(0, 6), rng.randint(0, 6)) for _ in range(9))} | {("n1", "m1"), ("n20", "m2")}
    links = defaultdict(set)
    for a, b in pairs:
        links[a].add(b)
    want = {}
    for s in list(links):
        per = defaultdict(list)
        for p in simple_paths(links, s, 5):
            per[p[-1]].append(len(p) - 1)
        for t, depths in per.items():
            want[s, t] = ("direct", 1, depths.count(1)) if 1 in depths else ("indirect", min(depths), len(depths))
    df = spark.createDataFrame(sorted(pairs), "src string, dst string")
    got = graph_queries.composed_by_counts(df.select(F.col("src").alias("source")), df, 5)
    assert {(r.source, r.target): (r.kind, r.depth, r.n_paths) for r in got.collect()} == want


def test_direct_targets_hide_indirect_ones(spark):
    rows = spark.createDataFrame([("a", "b", "depends_on"), ("a", "c", "depends_on"), ("c", "b", "depends_on"), ("b", "d", "depends_on"), ("c", "d", "depends_on"), ("a", "z", "is_a")], "src string, dst string, relation string")
    prov = rows.select("src", "dst", "relation", F.concat(F.lit("t"), "src").alias("trace_id"), F.when(F.col("src") == "c", 0.9).otherwise(0.5).alias("confidence"))
    asked = spark.createDataFrame([("A", "depends_on"), ("nothing", "is_a")], "term string, relation string")
    got = {r.target: (r.kind, r.depth, r.n_paths, r.first_path, r.n_provenance, r.best_trace) for r in graph_queries.composed_by_relation(asked, rows, prov).collect()}
    assert got == {"b": ("direct", 1, 1, "a → b", 1, "ta"), "c": ("direct", 1, 1, "a → c", 1, "ta"), "d": ("indirect", 2, 3, "a → b → d", 3, "tc")}
    best = rows.join(prov, ["src", "dst", "relation"]).select("src", "dst", "relation", F.lit(0.75).alias("salience"), "confidence")
    hops = graph_queries.one_hop(asked, best, spark.createDataFrame([("b",)], "value string")).orderBy("term", "rank").collect()
    assert [(r.term, r.hit, r.target, r.is_node, r["rank"]) for r in hops] == [("A", True, "b", True, 1), ("A", True, "c", False, 2), ("nothing", False, None, None, None)]


@pytest.mark.parametrize("few", (0, 100_000))
def test_composition_by_relation_writes_longer_paths_only(spark, monkeypatch, few):
    """Against plain paths with cycles, self-loops, repeated edges and traces; edges that no asked path can take are dropped before anything is written."""
    rng = random.Random(5)
    pairs = {(f"n{rng.randint(0, 9)}", f"n{rng.randint(0, 9)}", rng.choice("rs")) for _ in range(40)}
    beside = [(f"far{i}", f"end{i}", "r") for i in range(50)]
    links = defaultdict(lambda: defaultdict(set))
    for a, b, r in pairs:
        links[r][a].add(b)
    traces = [(a, b, r, f"t{(len(a) + int(b[1:]) + i) % 7}", i / 4) for a, b, r in sorted(pairs) for i in range(int(b[1:]) % 3)]
    asked = [(t, r) for t in ("N0", "n1", "n2", "n0", "none") for r in "rs"]
    want, direct, indirect = {}, 0, 0
    for term, r in asked:
        per = defaultdict(list)
        for p in simple_paths(links[r], term.lower(), 3):
            per[p[-1]].append(p)
        for t, ways in per.items():
            kept = sorted((len(p) - 1, " → ".join(p), tuple(p)) for p in ways if len(p) == 2 or min(map(len, ways)) > 2)
            direct, indirect = direct + (kept[0][0] == 1), indirect + (len(kept) if kept[0][0] > 1 else 0)
            told = defaultdict(list)
            for a, b in {(a, b) for _, _, p in kept for a, b in zip(p, p[1:])}:
                for x in traces:
                    if x[:3] == (a, b, r):
                        told[x[3]].append(x[4])
            best = min(told, key=lambda k: (-max(told[k]), k)) if told else None
            want[term, r, t] = ("direct" if kept[0][0] == 1 else "indirect", kept[0][0], len(kept), kept[0][1], len(told), best)
    tables, own = {}, graph_queries.written
    monkeypatch.setattr(graph_queries, "INNER_NODES", few)
    monkeypatch.setattr(graph_queries, "written", lambda df, name: tables.setdefault(name, own(df, name)))
    edges = spark.createDataFrame(sorted(pairs) * 2 + beside, "src string, dst string, relation string")
    prov = spark.createDataFrame(traces * 2, "src string, dst string, relation string, trace_id string, confidence double")
    got = graph_queries.composed_by_relation(spark.createDataFrame(asked * 2, "term string, relation string"), edges, prov).collect()
    assert len(got) == len(want) and {(x.term, x.relation, x.target): (x.kind, x.depth, x.n_paths, x.first_path, x.n_provenance, x.best_trace) for x in got} == want
    assert direct and tables["kept-paths"].count() == indirect > 0
    assert tables["reached"].filter("src like 'far%'").count() == 0


def test_conflicts_name_a_node_with_another_value(spark):
    place = ("doc", "c", "m")
    nodes = spark.createDataFrame([("n1", "A", *place), ("n2", "B", *place), ("n3", "A", *place), ("n4", "C", *place), ("n5", None, *place)], "id string, value string, source_id string, chunk_id string, method string")
    asked = spark.createDataFrame([(k, v, *place, "document", 0.9, 3) for k, v in enumerate(["A", "B", "C", "Z", None])], "candidate_id long, value string, source_id string, chunk_id string, method string, source_type string, confidence double, filled int")
    assert {r.candidate_id: (r.decision, r.node_id) for r in validation.decide(asked, nodes).collect()} == {0: ("conflict", "n2"), 1: ("conflict", "n1"), 2: ("conflict", "n1"), 3: ("conflict", "n1"), 4: ("accept", None)}


def test_patterns_over_line_breaks(spark):
    texts = ["Force is big\n is mass times speed.", "Force is mass times speed.", "Water is wet\r\n consists of ice and steam.", "A is b times c."]
    got = extraction.relationships(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted((r.doc_id, r.pattern, r.src, r.dst) for r in got.filter("doc_id < 2").collect()) == [(0, "is_times", "force is big", "mass"), (0, "is_times", "force is big", "speed"), (1, "is_times", "force", "mass"), (1, "is_times", "force", "speed")]


def test_imported_bundles(spark):
    rows = [(1, 1, "r", "State", True), (1, 1, "x", "Entity", False), (1, 1, "k", "Constraint", False), (1, 2, "r", "State", True), (1, 2, "r", "State", False), (2, 3, "x", "Entity", True), (2, 3, "r", "State", False)]
    df = spark.createDataFrame(rows, "step long, graph long, node string, type string, is_root boolean")
    assert sorted((r.src, r.dst, r.relation, r.step, r.graph) for r in graph.imported_edges(df).collect()) == [("r", "x", "State", 2, 3), ("x", "r", "Entity", 1, 1)]
    failures = spark.createDataFrame([(2, 9, ["bad", "worse"]), (2, 10, []), (2, 11, None)], "step long, graph long, errors array<string>")
    got = sorted(map(tuple, graph.imported_events(df, failures).collect()))
    assert got == [(1, 1, "add_node", "r", ""), (1, 2, "reinforce_node", "r", ""), (2, 3, "reinforce_node", "x", ""), (2, 9, "failure", None, "graph 9: bad")]
    per = {r.node: (r.salience, r.n) for r in graph.imported(df, 2).collect()}
    assert per == {"r": (round(((1.0 + 0.5) * 0.95 + 0.25) * 0.95, 9), 3), "x": (round((0.8 * 0.95 + 0.5) * 0.95, 9), 2)}


def test_quadratics_over_the_whole_range_of_long(spark):
    def plain(a, b, c):
        if a == 1 and (q := b * b - 4 * c) >= 0 and (r := math.isqrt(q)) ** 2 == q:
            return f"(x - {(-b + r) // 2})(x - {(-b - r) // 2})"
        return f"factor({a}x^2 + {b}x + {c})"

    rng, rows = random.Random(4), [(1, -5, 6), (1, 0, -4), (1, 2, 5), (2, 1, 1), (1, 0, 0), (1, 2**63 - 1, 0), (1, -(2**63), 0), (1, 2**63 - 1, 2**63 - 1), (1, 0, -(2**63))]
    for _ in range(500):
        p, q = rng.randint(-(2**31), 2**31), rng.randint(-(2**31), 2**31)
        rows += [(1, -(p + q), p * q + rng.choice([0, 0, 1])), (1, rng.randint(-(2**63), 2**63 - 1), rng.randint(-(2**63), 2**63 - 1)), (1, rng.randint(-(2**62), 2**62), 0)]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    for r in df.select("*", typed.factor_quadratic(F.col("a"), F.col("b"), F.col("c")).alias("f")).collect():
        assert r.f == plain(r.a, r.b, r.c)


VALUES = {"DOUBLE": [1.5, -2.0, 0.0, None], "STRING": ["x", "", "it's %s", None], "INT": [0, -1, 5, None], "ARRAY<STRING>": [["b", "a"], [], None, ["x", None]], "MAP<STRING, STRING>": [{"x": "1"}, {}, None, {"": "e"}]}


def test_sql_functions_equal_columns(spark):
    names = sql_functions.register(spark)
    assert len(names) == len(sql_functions.definitions()) > 100
    for operator, (parameters, _) in sql_functions.definitions().items():
        kinds = [p.split(" ", 1)[1] for p in parameters.replace("STRING, STRING>", "STRING;STRING>").split(", ")]
        kinds = [k.replace(";", ", ") for k in kinds]
        rows = [tuple(VALUES[k][(i + 2 * j) % 4] for j, k in enumerate(kinds)) for i in range(4)]
        df = spark.createDataFrame(rows, ", ".join(f"{'abcd'[j]} {k}" for j, k in enumerate(kinds)))
        columns = [F.col("abcd"[j]) for j in range(len(kinds))]
        if operator in ("math.ADD",):
            assert spark.sql(f"SELECT {sql_functions.function_name(operator)}(1, 2)").first()[0] == 3.0
        both = df.select(F.expr(f"{sql_functions.function_name(operator)}({', '.join('abcd'[: len(kinds)])})").alias("s"), typed.apply(operator, *columns).alias("c"))
        for r in both.collect():
            assert r.s == r.c, operator


def test_units_of_rows(spark):
    rows = spark.createDataFrame([(1.0, "km", "m"), (5.0, "m", "km"), (36.0, "km/h", "m/s"), (1.0, "kg", "m"), (None, "g", "kg"), (1.0, None, "m"), (1.0, "m", "m")], "v double, u string, t string")
    got = typed.with_converted(rows, "v", "u", "t").collect()
    assert Counter(r.error for r in got) == {None: 4, "No conversion from kg to m": 1, "No conversion from null to m": 1, "No conversion from m to m": 1}
    assert {(r.u, r.t): r.converted for r in got if r.error is None and r.v} == {("km", "m"): 1000.0, ("m", "km"): 0.005, ("km/h", "m/s"): 36.0 * (1 / 3.6)}


def test_command_lines_and_batch_options(spark, tmp_path):
    from loomgraph.__main__ import main

    (tmp_path / "in").mkdir()
    for name, text in (("a.txt", b"Force is a push on a thing. Force depends on mass and speed, as force uses mass."), ("b.txt", b"\xff\xfe"), ("c.txt", b"Mass is matter of a body. A port uses ships of all nations.")):
        (tmp_path / "in" / name).write_bytes(text)
    state, folder = f"file://{tmp_path}/s", str(tmp_path / "in")
    run = lambda *args: main([args[0], "--state", state, "--buckets", "8", *args[1:]], spark)
    rows = [(Path(r.path).name, r.success, r.error, r.version) for r in run("batch", "--save-per-file", folder).collect()]
    assert rows == [("a.txt", True, None, 1), ("b.txt", False, "not UTF-8", None), ("c.txt", True, None, 2)]
    rows = [(Path(r.path).name, r.success, r.version) for r in run("batch", "--stop-on-error", folder).collect()]
    assert rows == [("a.txt", True, 3), ("b.txt", False, None)]
    assert run("batch", "--max-files", "1", folder).count() == 1
    got = {r.question: (r.operator, r.answer) for r in run("ask", "what is force", "what is xyzzy", "frobnicate the quux").collect()}
    assert got == {"what is force": ("discourse.GET_DEFINITION", "Force is a push on a thing."), "what is xyzzy": ("discourse.GET_DEFINITION", None), "frobnicate the quux": ("generic", None)}
    (tmp_path / "books").mkdir()
    (tmp_path / "books" / "one.txt").write_text(BOOKS[0][1])
    assert [(r.chapters, r.empty) for r in run("books", str(tmp_path / "books")).collect()] == [(3, 1)]
    with pytest.raises(SystemExit):
        main(["batch", "--state", state, "--mode", "none", folder], spark)
    from loomgraph.operators.ingest import Ingestion

    for wrong in ({"mode": "none"}, {"max_files": 0}):
        with pytest.raises(ValueError):
            Ingestion(**wrong)


def test_questions_reach_the_rules(spark):
    from loomgraph.operators import routing

    asks = [(" ".join(r[2]) + " Peru 7 in list of things",) for r in routing.RULES]
    reached = {r.rule for r in routing.route(spark.createDataFrame(asks, "text string")).collect()}
    assert len(reached) > 60


def test_scores_of_dictionary_definitions(spark):
    row = spark.range(1).select(*(F.round(validation.quality_score(F.lit(c), F.lit("document"), F.lit(1), F.lit(m), mode), 6).alias(n) for n, c, m, mode in (("a", 0.8, "definition_extractor", "dictionary"), ("b", 0.8, "definition_extractor", "document"), ("c", 0.8, "claims", "dictionary"), ("d", 7.0, "pattern_v1", "dictionary")))).first()
    assert tuple(row) == (round(0.85 * 0.8 + 0.12 + 0.1 / 3, 6), round(0.7 * 0.8 + 0.12 + 0.1 / 3, 6), round(0.7 * 0.8 + 0.12 + 0.1 / 3, 6), 1.0)


def test_glossaries_are_told_alike_by_row_and_by_lines(spark):
    line = "Force is a push."
    texts = ["", "\n\n", line, "\n".join([line] * 3), "\n".join([line] * 3 + ["plain words here"] * 3), "\n".join([line] * 3 + ["plain words here"] * 4), "\n".join([line, line, "Mass has weight."]), "\n".join([line, "Mass has weight.", "Mass has weight."]), "\n".join([line + "x" * 104] * 3), "\n".join([line + "x" * 105] * 3), "  \n".join([f"  {line}"] * 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by_lines = {r.doc_id for r in chunking.glossary_documents(docs).filter("is_glossary").collect()}
    by_row = {r.doc_id for r in docs.filter(chunking.is_glossary(docs.text)).collect()}
    assert by_row == by_lines == {3, 4, 6, 8, 10}
    assert not spark.createDataFrame([(None,)], "text string").select(chunking.is_glossary(F.col("text")).alias("g")).first().g


def test_scratch_tables_go(spark):
    from loomgraph import session

    with pytest.raises(ZeroDivisionError), session.scratch(spark) as write:
        table = write(spark.range(3).toDF("x"), "t")
        at = table.inputFiles()[0].removeprefix("file://")
        assert table.count() == 3 and os.path.exists(at)
        1 / 0
    assert not os.path.exists(os.path.dirname(at))


def test_batches_of_salience_are_not_one_task(spark, monkeypatch):
    from pyspark.sql import DataFrame

    def refused(self, n):
        raise AssertionError("all rows in one task")

    monkeypatch.setattr(DataFrame, "coalesce", refused)
    monkeypatch.setattr(type(spark.range(1)), "coalesce", refused)
    assert stored.salience_state(spark, "/root/testdata/sf0.001").count() > 0
