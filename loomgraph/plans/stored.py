"""Queries over stored graphs, states of streams, compositions and operators in SQL, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql as sql_functions
from ..functions import typed
from ..functions.text import definition_term, trace_id
from ..operators import adaptation, extraction, graph, graph_queries, ingest, routing
from ..session import own_folder, written
from ..sources.graph_store import GraphStore, rebuilt_definitions
from ..streaming import books, salience
from .catalog import _CLAIMS, _DEFINED, _STAR, _WHOLE_STAR, _CLOSURE, _RELATED, _book_chunk_rows, _definitions, _docs, _related, _relationships, _route_sql, _star, _strip, _t, _whole_star
from .registry import query

# A graph in versions


def _store(spark: SparkSession, buckets: int = 32) -> GraphStore:
    return GraphStore(spark, f"{own_folder(spark)}/graphs/{uuid.uuid4().hex}", buckets)


def _ordered(orders: DataFrame, salience: float) -> tuple[DataFrame, DataFrame]:
    """Customer -> order status, stated by each order: edges and their traces."""
    rows = orders.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("s"), "o_orderstatus").alias("dst"), F.lit("has").alias("relation"), F.lit(salience).alias("salience"), F.col("o_orderkey").alias("step"), F.concat(F.lit("t"), (F.col("o_orderkey") % 7).cast("string")).alias("trace_id"))
    return rows.select("src", "dst", "relation", "salience", "step"), rows.select("src", "dst", "relation", "trace_id", "step")


@query(
    """WITH said AS (SELECT 'c' || o_custkey AS src, 's' || o_orderstatus AS dst, 'has' AS relation, 't' || o_orderkey % 7 AS trace_id, o_orderkey AS step, (o_orderkey % 2) AS k FROM orders),
edge AS (SELECT src, dst, relation, CASE min(k) WHEN 0 THEN 0.75 ELSE 0.5 END::DOUBLE AS salience FROM said GROUP BY ALL), trace AS (SELECT src, dst, relation, trace_id, arg_min(step, k * 1000000000000 + step) AS step FROM said GROUP BY ALL)
SELECT src, dst, relation, salience, trace_id, step FROM edge JOIN trace USING (src, dst, relation)"""
)
def graph_upsert(spark, d):
    store, orders = _store(spark), _t(spark, d, "orders")
    first, second = _ordered(orders.filter("o_orderkey % 2 = 0"), 0.75), _ordered(orders.filter("o_orderkey % 2 = 1"), 0.5)
    for edges, traces in (first, second, second):  # the last one changes nothing
        store.upsert(edges=edges, traces=traces)
    return store.read("edges").drop("step").join(store.read("traces"), ["src", "dst", "relation"]).select("src", "dst", "relation", "salience", "trace_id", "step")


@query(
    """WITH said AS (SELECT 'c' || o_custkey AS src, 's' || o_orderstatus AS dst FROM orders), asked AS (SELECT DISTINCT 'c' || s_suppkey * 3 AS src FROM supplier)
SELECT src, dst, count(*) AS n FROM said WHERE src IN (SELECT src FROM asked) GROUP BY ALL"""
)
def graph_lookup(spark, d):
    store, orders = _store(spark), _t(spark, d, "orders")
    edges, _ = _ordered(orders, 0.75)
    store.upsert(edges=edges, traces=edges.select("src", "dst", "relation", F.col("step").cast("string").alias("trace_id"), "step"))
    asked = _t(spark, d, "supplier").select(F.concat(F.lit("c"), (F.col("s_suppkey") * 3).cast("string")).alias("src"))
    own = store.find_all("edges", asked)
    return own.join(store.read("traces"), ["src", "dst", "relation"]).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_DEFINED} SELECT {_strip("regexp_replace(lower(term), '[^\\p{L}\\p{N}_\\s]', '', 'g')")} AS term, value AS definition, 'doc:' || doc_id AS source_id, confidence, doc_id AS step, id AS node_id FROM node
WHERE {_strip("regexp_replace(lower(term), '[^\\p{L}\\p{N}_\\s]', '', 'g')")} <> ''"""
)
def definition_rebuild(spark, d):
    store, source = _store(spark), F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    about = F.to_json(F.struct(F.lit("definition").alias("category"), definition_term(F.col("term")).alias("term"), F.col("value").alias("definition_text"), F.lit("document").alias("mode")))
    nodes = graph.definition_nodes(extraction.definitions(_docs(spark, d))).select("id", "value", F.lit("Entity").alias("sem_type"), F.lit(1.0).alias("salience"), F.col("doc_id").alias("step"), source.alias("source_id"), F.lit("definition_extractor").alias("method"), "confidence", trace_id(source, "definition_extractor", F.col("doc_id")).alias("trace_id"), F.parse_json(about).alias("metadata"))
    named = _t(spark, d, "nation").select(F.concat(F.lit("nation"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("value"), F.lit("Entity").alias("sem_type"), F.lit(0.5).alias("salience"), F.lit(0).cast("long").alias("step"), *(F.lit(None).cast(t).alias(c) for c, t in (("source_id", "string"), ("method", "string"), ("confidence", "double"), ("trace_id", "string"))), F.parse_json(F.lit('{"category": "entity"}')).alias("metadata"))
    store.upsert(nodes=nodes)
    store.upsert(nodes=named)  # nodes that define nothing
    return rebuilt_definitions(store.read("nodes"))


_DAY = "date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) + 1"


def _days(spark, d):
    """events with step: the day, from 1; and the last day."""
    ev = _t(spark, d, "events")
    span = ev.agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b")).first()
    return ev.withColumn("step", (F.datediff(F.to_date("ts"), F.lit(span["a"])) + 1).cast("long")), (span["b"] - span["a"]).days + 1


@query(
    f"""SELECT row_number() OVER (ORDER BY event_id % 2, {_DAY}, event_type, 'u' || user_id, event_id::VARCHAR) AS number, ({_DAY})::BIGINT AS step, event_type, 'u' || user_id AS node, event_id::VARCHAR AS metadata FROM events"""
)
def temporal_events(spark, d):
    store, (ev, _) = _store(spark), _days(spark, d)
    rows = ev.select("event_id", "step", "event_type", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("node"), F.col("event_id").cast("string").alias("metadata"))
    store.upsert(events=rows.filter("event_id % 2 = 0"))
    store.upsert(events=rows.filter("event_id % 2 <> 0"))
    return store.read("events")


def _bundles(ev: DataFrame) -> DataFrame:
    """Each event but errors as an executed result: its type is the root, its user and amount are leaves."""
    one = lambda node, kind, is_root: F.struct(node.alias("node"), F.lit(kind).alias("type"), F.lit(is_root).alias("is_root"))
    parts = F.array(one(F.col("event_type"), "State", True), one(F.concat(F.lit("u"), F.col("user_id").cast("string")), "Entity", False), one(F.concat(F.lit("v"), F.floor("value").cast("string")), "Event", False), one(F.lit("k"), "Constraint", False))
    return ev.filter("event_type <> 'error'").select("step", F.col("event_id").alias("graph"), F.explode(parts).alias("x")).select("step", "graph", "x.node", "x.type", "x.is_root").filter("node is not null")


@query(
    f"""WITH b AS (SELECT {_DAY} AS step, event_id AS graph, 'u' || user_id AS u, 'v' || floor(value)::BIGINT AS v, event_type AS root FROM events WHERE event_type <> 'error'), said AS (SELECT step, graph, u AS src, root AS dst, 'Entity' AS relation FROM b UNION ALL SELECT step, graph, v, root, 'Event' FROM b WHERE v IS NOT NULL)
SELECT src, dst, relation, 1.0::DOUBLE AS salience, min(struct_pack(step := step, graph := graph)).step::BIGINT AS step, min(struct_pack(step := step, graph := graph)).graph AS graph FROM said GROUP BY ALL"""
)
def import_edges(spark, d):
    ev, _ = _days(spark, d)
    return graph.imported_edges(_bundles(ev))


@query(
    f"""WITH b AS (SELECT ({_DAY})::BIGINT AS step, event_id AS graph, event_type, user_id FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY step, graph) AS k FROM b WHERE event_type <> 'error')
SELECT step, graph, CASE k WHEN 1 THEN 'add_node' ELSE 'reinforce_node' END AS event_type, event_type AS node, '' AS metadata FROM r
UNION ALL SELECT step, graph, 'failure', NULL, 'graph ' || graph || ': user ' || user_id FROM b WHERE event_type = 'error' AND user_id % 2 = 0"""
)
def import_events(spark, d):
    ev, _ = _days(spark, d)
    failed = ev.filter("event_type = 'error'").select("step", F.col("event_id").alias("graph"), F.when(F.col("user_id") % 2 == 0, F.array(F.concat(F.lit("user "), F.col("user_id").cast("string")), F.lit("more"))).otherwise(F.array().cast("array<string>")).alias("errors"))
    return graph.imported_events(_bundles(ev), failed)


# States of streams


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id AS node, {_DAY} AS step, 0.5 * count(*) AS amount FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY step) AS i FROM e), last AS (SELECT max(step) AS last FROM e),
f AS (SELECT node, i, step, greatest(0.01, amount * 0.95)::DOUBLE AS s FROM k WHERE i = 1 UNION ALL SELECT k.node, k.i, k.step, greatest(0.01, (greatest(0.01, f.s * pow(0.95, k.step - f.step - 1)) + k.amount) * 0.95)::DOUBLE FROM f JOIN k ON k.node = f.node AND k.i = f.i + 1)
SELECT node, round(greatest(0.01, arg_max(s, i) * pow(0.95, (SELECT last FROM last) - max(step))), 9) AS salience FROM f GROUP BY node"""
)
def salience_state(spark, d):
    """salience_reinforce as the state of a stream that gets the days in four micro-batches."""
    ev, last = _days(spark, d)
    rows = ev.groupBy(F.col("user_id").alias("node"), "step").agg((0.5 * F.count(F.lit(1))).alias("amount"))
    at, state = (f"{own_folder(spark)}/{x}/{uuid.uuid4().hex}" for x in ("amounts", "salience"))
    for k in range(4):  # all new files are one batch; the state goes on
        rows.filter((F.col("step") > last * k // 4) & (F.col("step") <= last * (k + 1) // 4)).write.mode("append").parquet(at)
        out = salience.run_salience(spark, spark.readStream.schema(rows.schema).parquet(at), last, at=state)
    return out


class Stopped(Exception):
    """Ends an ingestion where a machine might fail."""


@query(
    f"""WITH {_book_chunk_rows('documents')}, keyed AS (SELECT chapter_id || '/' || mode || '/' || position || '/' || chunk_id AS doc_id, chapter_id, text FROM book_chunk),
d AS (SELECT doc_id, count(*) AS n FROM ({_definitions('keyed')}) GROUP BY doc_id), r AS (SELECT doc_id, count(*) AS n FROM ({_relationships('keyed')}) GROUP BY doc_id),
per AS (SELECT chapter_id, count(*) AS n_chunks, coalesce(sum(d.n), 0)::BIGINT AS n_definitions, coalesce(sum(r.n), 0)::BIGINT AS n_relationships FROM keyed LEFT JOIN d USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY chapter_id)
SELECT doc_id::VARCHAR AS doc_id, chapter::INT AS chapter, chapter_id, title, CASE WHEN n_chunks IS NULL THEN 'empty' ELSE 'complete' END AS status, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_definitions, 0) AS n_definitions, coalesce(n_relationships, 0) AS n_relationships FROM chapter LEFT JOIN per USING (chapter_id)"""
)
def book_ingest(spark, d):
    """All documents as books, in three parts; the first run stops behind the first part, the second goes on."""
    at, store = f"{own_folder(spark)}/books/{uuid.uuid4().hex}", _store(spark)

    def stop(batch: int, part: int) -> None:
        raise Stopped(f"behind part {part}")

    stream = lambda: books.book_stream(spark, f"{d}/documents.parquet")
    try:
        books.ingest_books(stream(), at, store, 3, stop)
    except Exception as e:
        if "behind part 0" not in str(e):
            raise
    return books.ingest_books(stream(), at, store, 3).drop("chunk_mode")


# Composition


@query(
    f"""WITH RECURSIVE {_WHOLE_STAR}, {_CLOSURE.format(edges="whole")}, g AS (SELECT source, target, min(depth) AS depth, count(*) AS n, count(*) FILTER (depth = 1) AS n1 FROM walk GROUP BY ALL)
SELECT source, target, CASE WHEN depth = 1 THEN 'direct' ELSE 'indirect' END AS kind, depth::INT AS depth, (CASE WHEN depth = 1 THEN n1 ELSE n END)::BIGINT AS n_paths FROM g"""
)
def compose_by_counts(spark, d):
    return graph_queries.composed_by_counts(None, _whole_star(spark, d))


_WITH_CYCLES = "linked AS (SELECT src, dst FROM star UNION SELECT 'r' || r_regionkey, 'n' || r_regionkey FROM region UNION SELECT 'n' || n_nationkey, 'x' || n_nationkey % 3 FROM nation)"


@query(
    f"""WITH RECURSIVE {_STAR}, {_WITH_CYCLES}, {_CLOSURE.format(edges="linked").replace("depth < 3", "depth < 8")}, g AS (SELECT source, target, min(depth) AS depth, count(*) AS n, count(*) FILTER (depth = 1) AS n1 FROM walk GROUP BY ALL)
SELECT source, target, CASE WHEN depth = 1 THEN 'direct' ELSE 'indirect' END AS kind, depth::INT AS depth, (CASE WHEN depth = 1 THEN n1 ELSE n END)::BIGINT AS n_paths FROM g"""
)
def compose_depth8_cycles(spark, d):
    """Eight steps over orders, customers, nations and regions, where five regions lead back to a nation."""
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nation, region = _t(spark, d, "nation"), _t(spark, d, "region")
    linked = _star(spark, d).select("src", "dst").unionByName(region.select(s("r", "r_regionkey").alias("src"), s("n", "r_regionkey").alias("dst"))).unionByName(nation.select(s("n", "n_nationkey").alias("src"), F.concat(F.lit("x"), (F.col("n_nationkey") % 3).cast("string")).alias("dst")))
    return graph_queries.composed_by_counts(None, linked, depth=8)


_PROV = "prov AS (SELECT src, dst, relation, 't' || src || '.' || i AS trace_id, ((length(dst) + i) % 10) / 10.0::DOUBLE AS confidence FROM edges, range(0, 3) AS r(i) WHERE i < n_provenance)"


def _traces(edges: DataFrame) -> DataFrame:
    rows = edges.select("src", "dst", "relation", F.explode(F.sequence(F.lit(0), F.col("n_provenance").cast("int") - 1)).alias("i"))
    return rows.select("src", "dst", "relation", F.concat(F.lit("t"), "src", F.lit("."), F.col("i").cast("string")).alias("trace_id"), ((F.char_length("dst") + F.col("i")) % 10 / 10.0).alias("confidence"))


@query(
    f"""WITH RECURSIVE {_WHOLE_STAR}{_RELATED}, {_PROV}, least AS (SELECT *, min(depth) OVER (PARTITION BY term, relation, target) AS m FROM walk), kept AS (SELECT * FROM least WHERE m > 1 OR depth = 1),
hop AS (SELECT DISTINCT term, relation, target, path[i] AS src, path[i + 1] AS dst FROM (SELECT *, unnest(range(1, len(path))) AS i FROM kept)),
tr AS (SELECT term, relation, target, trace_id, max(confidence) AS confidence FROM hop JOIN prov USING (src, dst, relation) GROUP BY ALL), p AS (SELECT term, relation, target, count(*) AS n, arg_min(trace_id, struct_pack(c := -confidence, t := trace_id)) AS best FROM tr GROUP BY ALL)
SELECT term, relation, target, CASE WHEN min(depth) = 1 THEN 'direct' ELSE 'indirect' END AS kind, min(depth)::INT AS depth, count(*) AS n_paths, arg_min(array_to_string(path, ' → '), struct_pack(d := depth, p := array_to_string(path, ' → '))) AS first_path, coalesce(max(p.n), 0) AS n_provenance, max(best) AS best_trace
FROM kept LEFT JOIN p USING (term, relation, target) GROUP BY term, relation, target"""
)
def compose_by_relation(spark, d):
    asked, edges = _related(spark, d)
    edges = written(graph_queries.reached(asked, edges), "related")
    return graph_queries.composed_by_relation(asked, edges, _traces(edges))


@query(
    f"""WITH RECURSIVE {_WHOLE_STAR}{_RELATED}, {_PROV}, c AS (SELECT src, dst, relation, max(confidence) AS confidence FROM prov GROUP BY ALL), n AS (SELECT 'n' || n_nationkey AS value FROM nation UNION SELECT 'c' || c_custkey FROM customer)
SELECT term, a.relation, dst IS NOT NULL AS hit, dst AS target, CASE WHEN dst IS NOT NULL THEN n.value IS NOT NULL END AS is_node, CASE WHEN dst IS NOT NULL THEN 0.75::DOUBLE END AS salience, c.confidence, CASE WHEN dst IS NOT NULL THEN row_number() OVER (PARTITION BY term, a.relation ORDER BY c.confidence DESC, dst)::INT END AS rank
FROM asked a LEFT JOIN c ON c.src = lower(term) AND c.relation = a.relation LEFT JOIN n ON n.value = dst"""
)
def one_hop(spark, d):
    asked, edges = _related(spark, d)
    best = _traces(edges).groupBy("src", "dst", "relation").agg(F.max("confidence").alias("confidence")).withColumn("salience", F.lit(0.75))
    s = lambda table, p, c: _t(spark, d, table).select(F.concat(F.lit(p), F.col(c).cast("string")).alias("value"))
    return graph_queries.one_hop(asked, best, s("nation", "n", "n_nationkey").unionByName(s("customer", "c", "c_custkey")))


# Operators in SQL, algebra, units


@query(
    """SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_quantity, 0) AS acceleration, l_quantity + l_discount * l_tax AS velocity, 0.5 * l_quantity * l_discount * l_discount AS energy, l_quantity * 9.8 * l_tax AS height, l_extendedprice * l_discount * l_tax AS interest, l_extendedprice * pow(1 + l_discount, 2) AS compound,
  l_extendedprice - l_tax AS withdrawn, CASE WHEN l_discount < l_tax THEN 'lt' WHEN l_discount = l_tax THEN 'eq' ELSE 'gt' END AS compared, 'd/d' || l_linestatus || '(' || l_returnflag || ')' AS derived, 'if(' || l_returnflag || ',' || l_linestatus || ',no)' AS branch, l_returnflag AS higher, l_linestatus AS lower, true AS violation,
  CASE WHEN l_linenumber % 3 = 0 THEN 'green' WHEN l_linenumber % 3 = 1 THEN 'unknown(b)' ELSE 'red' END AS looked_up, 3 AS n FROM lineitem"""
)
def sql_operators(spark, d):
    sql_functions.register(spark)
    return spark.sql(
        """SELECT l_orderkey, l_linenumber, physics_compute_acceleration(l_extendedprice, l_quantity) AS acceleration, physics_update_velocity(l_quantity, l_discount, l_tax) AS velocity, physics_compute_kinetic_energy(l_quantity, l_discount) AS energy,
  physics_compute_potential_energy(l_quantity, NULL, l_tax) AS height, finance_compute_interest(l_extendedprice, l_discount, l_tax) AS interest, finance_compute_compound_interest(l_extendedprice, l_discount, 2) AS compound, finance_withdraw(l_extendedprice, l_tax) AS withdrawn,
  math_compare(l_discount, l_tax) AS compared, math_derive(l_returnflag, l_linestatus) AS derived, programming_conditional_branch(l_returnflag, l_linestatus, 'no') AS branch, legal_establish_precedence(l_returnflag, l_linestatus).higher AS higher, legal_establish_precedence(l_returnflag, l_linestatus).lower AS lower,
  legal_detect_violation(l_returnflag, l_linestatus).violation AS violation, geography_geo_lookup(map('a', 'green', 'c', 'red'), element_at(array('a', 'b', 'c'), CAST(l_linenumber % 3 AS INT) + 1)) AS looked_up, core_count(programming_append(array('a', 'b'), l_returnflag)) AS n FROM {lineitem}""",
        lineitem=_t(spark, d, "lineitem"),
    )


@query(
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 5 = 0 THEN 2 ELSE 1 END::BIGINT AS a, -(l_partkey - l_suppkey) AS b, -l_partkey * l_suppkey + CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END AS c FROM lineitem),
s AS (SELECT *, b * b - 4 * c AS q, floor(sqrt(greatest(b * b - 4 * c, 0)::DOUBLE))::BIGINT AS r FROM x)
SELECT l_orderkey, l_linenumber, CASE WHEN a = 1 AND q >= 0 AND r * r = q THEN '(x - ' || (-b + r) // 2 || ')(x - ' || (-b - r) // 2 || ')' ELSE 'factor(' || a || 'x^2 + ' || b || 'x + ' || c || ')' END AS factored,
  CASE WHEN l_linenumber % 2 = 0 THEN '(' || l_partkey || ')^2 + 2*(' || l_partkey || ')*(' || l_suppkey || ') + (' || l_suppkey || ')^2' ELSE 'expand((' || l_partkey || '+' || l_suppkey || ')^3)' END AS expanded FROM s"""
)
def factor_quadratics(spark, d):
    """Quadratics with the roots part key and minus supplier key; each third is one off, each fifth is not monic."""
    n, p, s = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    a, b, c = F.when(n % 5 == 0, 2).otherwise(1).cast("long"), -(p - s), -p * s + F.when(n % 3 == 0, 1).otherwise(0)
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", typed.factor_quadratic(a, b, c).alias("factored"), typed.expand_binomial(p, s, F.when(n % 2 == 0, 2).otherwise(3)).alias("expanded"))


@query(
    """WITH u AS (SELECT l_orderkey, l_linenumber, l_quantity, (['km', 'm', 'g', 'kJ', 'm/s', 'kg', 'km'])[l_linenumber] AS unit, (['m', 'cm', 'kg', 'J', 'km/h', 'MJ', 'km'])[l_linenumber] AS target FROM lineitem)
SELECT l_orderkey, l_linenumber, unit, target, CASE l_linenumber WHEN 1 THEN l_quantity * 1000.0 WHEN 2 THEN l_quantity / 0.01::DOUBLE WHEN 3 THEN l_quantity * 0.001::DOUBLE WHEN 4 THEN l_quantity * 1000.0 WHEN 5 THEN l_quantity / (1 / 3.6::DOUBLE) END AS converted,
  CASE WHEN l_linenumber > 5 THEN 'No conversion from ' || unit || ' to ' || target END AS error FROM u"""
)
def unit_conversions(spark, d):
    n = F.col("l_linenumber").cast("int")
    pick = lambda *units: F.get(F.array(*map(F.lit, units)), n - 1)
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", pick("km", "m", "g", "kJ", "m/s", "kg", "km").alias("unit"), pick("m", "cm", "kg", "J", "km/h", "MJ", "km").alias("target"))
    return typed.with_converted(rows, "l_quantity", "unit", "target").drop("l_quantity")


# Questions for every rule, knowledge items, compression

_RULE_ASKS = [" ".join(r[2]) for r in routing.ranked_rules()]


@query(
    "WITH asks AS (SELECT n_nationkey, ask::INT AS ask, q || ' ' || n_name || ' 7 in list of things' AS text FROM nation, (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(_RULE_ASKS)) + f") v(ask, q)), {_route_sql('asks', 'n_nationkey, ask', 'text')}"
)
def route_all_rules(spark, d):
    """The keywords of each of the 89 rules as a question about each nation."""
    asks = F.array(*[F.struct(F.lit(i).alias("ask"), F.lit(q).alias("q")) for i, q in enumerate(_RULE_ASKS)])
    rows = _t(spark, d, "nation").select("n_nationkey", "n_name", F.explode(asks).alias("a")).select("n_nationkey", "a.ask", F.concat("a.q", F.lit(" "), "n_name", F.lit(" 7 in list of things")).alias("text"))
    return routing.route(rows).drop("text")


@query(
    f"""WITH keyed AS (SELECT doc_id * 1000000 + i - 1 AS doc_id, p[i] AS text FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {_strip("x")}), lambda x: x <> '') AS p FROM documents)) WHERE length(p[i]) >= 40),
d AS ({_definitions("keyed")}), c AS ({_CLAIMS.replace("FROM documents", "FROM keyed")}), last AS (SELECT doc_id // 1000000 AS doc, term, arg_max(struct_pack(d := definition, c := confidence), struct_pack(a := doc_id, p := pos)) AS l FROM d GROUP BY ALL)
SELECT 'title ' || doc || '::defn::' || term AS key, 'definition' AS kind, l.d AS content, doc AS doc_id, l.c AS confidence FROM last
UNION ALL SELECT 'title ' || doc_id // 1000000 || '::claim::' || row_number() OVER (PARTITION BY doc_id // 1000000 ORDER BY doc_id, pos) - 1, 'claim', claim, doc_id // 1000000, 0.7::DOUBLE FROM c"""
)
def knowledge_items(spark, d):
    return ingest.knowledge_items(_docs(spark, d).withColumn("title", F.concat(F.lit("title "), F.col("doc_id").cast("string"))))


@query("SELECT o_orderkey, (o_orderkey % 2 = 0)::INT + (o_orderkey % 3 = 0)::INT + 1 AS kept, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS priority FROM orders")
def null_strip(spark, d):
    k = F.col("o_orderkey")
    record = F.create_map(F.lit("status"), F.when(k % 2 == 0, F.col("o_orderstatus")), F.lit("priority"), F.when(k % 3 == 0, F.col("o_orderpriority")), F.lit("key"), k.cast("string"))
    less = adaptation.without_nulls(record)
    return _t(spark, d, "orders").select("o_orderkey", F.size(less).alias("kept"), F.try_element_at(less, F.lit("priority")).alias("priority"))
