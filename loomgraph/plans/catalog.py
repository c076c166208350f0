"""The registered queries, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import typed
from ..operators import adaptation, chunking, classify, domains, extraction, graph, graph_queries, ingest, routing, validation
from ..session import written
from ..sources import documents as docs_source
from ..streaming import events as streams
from .registry import QUERIES, SQL, query  # noqa: F401  the tables of all queries

def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", "text")


def _headed(spark: SparkSession, d: str) -> DataFrame:
    """Documents of headings, glossary lines and paragraphs, made from the star schema: one per nation."""
    n = _t(spark, d, "nation").join(F.broadcast(_t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    body = F.concat(
        F.lit("lost preface\n# "), "n_name", F.lit(" definitions\n"), "n_name", F.lit(" is a nation of the region "), "r_name", F.lit(".\n\nTrade of "), "n_name", F.lit(" depends on ships and on the price of grain.\n## Ports:\n"),
        "n_name", F.lit(" uses harbours.\nDr. A. Smith wrote 3.5 pages about "), "n_name", F.lit(". He was right. First read it. Then believe it.\nSHORT NOTE\n1. pack the "), "r_name", F.lit(" grain\n2. load the ship\n"),
        "n_name", F.lit(" consists of coast and hills. Force is mass times acceleration. "), "n_name", F.lit(" is big\n is mass times speed. "), "n_name", F.lit(" is known as a port. "), "n_name", F.lit(" refers to a place on the map.\nAccess:\nA harbour is the rate of change of trade."),
    )
    return n.select(F.col("n_nationkey").cast("long").alias("doc_id"), body.alias("text"))


_HEADED = """SELECT n_nationkey::BIGINT AS doc_id, concat('lost preface
# ', n_name, ' definitions
', n_name, ' is a nation of the region ', r_name, '.

Trade of ', n_name, ' depends on ships and on the price of grain.
## Ports:
', n_name, ' uses harbours.
Dr. A. Smith wrote 3.5 pages about ', n_name, '. He was right. First read it. Then believe it.
SHORT NOTE
1. pack the ', r_name, ' grain
2. load the ship
', n_name, ' consists of coast and hills. Force is mass times acceleration. ', n_name, ' is big
 is mass times speed. ', n_name, ' is known as a port. ', n_name, ' refers to a place on the map.
Access:
A harbour is the rate of change of trade.') AS text FROM nation JOIN region ON n_regionkey = r_regionkey"""

_PUNCT = "[" + T.PUNCTUATION.replace("'", "''") + "]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _query_term(x: str) -> str:
    return _strip(f"regexp_replace(regexp_replace(lower({_strip(x)}), '{_PUNCT}', '', 'g'), '\\s+', ' ', 'g')")


def _extraction_term(x: str) -> str:
    return _strip(f"regexp_replace(regexp_replace(regexp_replace(lower({_strip(x)}), '{_PUNCT}', '', 'g'), '^(a|an|the)\\s+', ''), '\\s+', ' ', 'g')")


_LINES = "SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {source})"
_VERBS = "[" + ", ".join(f"'{v}'" for v in chunking.VERBS) + "]"
_IS_LINE = (
    "(len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')) >= 2 AND regexp_matches({x}, '[\\p{{L}}\\p{{N}}]') AND list_has_any(list_transform(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''), "
    "lambda w: regexp_replace(lower(w), '[.,;:!?]+$', '')), " + _VERBS.replace("{", "{{").replace("}", "}}") + "))"
)


# Chunking


@query(
    f"""SELECT doc_id, (i - 1)::INT AS seq, p[i] AS text FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM
  (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {_strip("x")}), lambda x: x <> '') AS p FROM documents)) WHERE length(p[i]) >= 40"""
)
def chunk_document(spark, d):
    return chunking.document_chunks(_docs(spark, d))


@query(
    f"""SELECT doc_id, line::INT AS line, t AS text, 'chunk_' || substr(sha256('doc:' || doc_id || '::dictionary::' || line || '::' || lower(t)), 1, 8) AS chunk_id, 'line:' || line AS location
FROM (SELECT doc_id, line, {_strip("text")} AS t FROM ({_LINES.format(source="documents")})) WHERE length(t) >= 5 AND {_IS_LINE.format(x="t")}"""
)
def chunk_dictionary(spark, d):
    return chunking.dictionary_chunks(_docs(spark, d))


_HEADINGS = f"""SELECT doc_id, line, text, CASE WHEN t = '' THEN NULL WHEN regexp_matches(t, '^#{{1,6}}\\s+.+$') THEN length(regexp_extract(t, '^(#{{1,6}})\\s+', 1))
  WHEN n <= 10 AND t = upper(t) AND regexp_matches(t, '^[\\p{{L}} ]+$') AND regexp_matches(t, '\\p{{Lu}}') THEN 1 WHEN ends_with(t, ':') AND length(t) <= 50 THEN 2 END::INT AS level,
  CASE WHEN t = '' THEN NULL WHEN regexp_matches(t, '^#{{1,6}}\\s+.+$') THEN {_strip("regexp_extract(t, '^#{1,6}\\s+(.+)$', 1)")}
  WHEN n <= 10 AND t = upper(t) AND regexp_matches(t, '^[\\p{{L}} ]+$') AND regexp_matches(t, '\\p{{Lu}}') THEN array_to_string(list_transform(string_split(lower(t), ' '), lambda w: upper(w[1]) || w[2:]), ' ')
  WHEN ends_with(t, ':') AND length(t) <= 50 THEN {_strip("t[:-2]")} END AS heading
FROM (SELECT *, rtrim(text) AS t, len(list_filter(regexp_split_to_array({_strip("rtrim(text)")}, '\\s+'), lambda w: w <> '')) AS n FROM ({_LINES.format(source="src")}))"""


@query(f"WITH src AS ({_HEADED}) SELECT doc_id, line::INT AS line, level, heading FROM ({_HEADINGS}) WHERE level IS NOT NULL")
def detect_headings(spark, d):
    return chunking.headings(_headed(spark, d)).filter("level is not null").select("doc_id", "line", "level", "heading")


@query(f"WITH src AS (SELECT doc_id, text FROM documents) SELECT doc_id, line::INT AS line, level, heading FROM ({_HEADINGS}) WHERE level IS NOT NULL")
def detect_headings_documents(spark, d):
    return chunking.headings(_docs(spark, d)).filter("level is not null").select("doc_id", "line", "level", "heading")


_SECTIONS = f"""h AS ({_HEADINGS}), s AS (SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY line) AS section FROM h),
g AS (SELECT doc_id, section, max(level) AS level, max(heading) AS heading, min(line) AS start_line, coalesce(string_agg(text, chr(10) ORDER BY line) FILTER (WHERE level IS NULL), '') AS text FROM s WHERE section > 0 GROUP BY ALL),
sec AS (SELECT *, 'sec_' || substr(sha256(level || '::' || coalesce(heading, '') || '::' || start_line), 1, 8) AS section_id,
  (SELECT max(p.section) FROM g p WHERE p.doc_id = g.doc_id AND p.section < g.section AND p.level < g.level) AS parent FROM g)"""


@query(f"WITH src AS ({_HEADED}), {_SECTIONS} SELECT doc_id, section, level, heading, start_line::INT AS start_line, section_id, parent, text FROM sec")
def parse_sections(spark, d):
    return chunking.sections(_headed(spark, d))


#: As _SECTIONS, for texts with and without headings: one without is a section of level 0. The parent comes from the last section of each level.
_ALL_SECTIONS = f"""h AS ({_HEADINGS}), s AS (SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY line) AS k, count(level) OVER (PARTITION BY doc_id) AS every FROM h),
g AS (SELECT doc_id, greatest(k, 1) AS section, coalesce(max(level), 0)::INT AS level, max(heading) AS heading, min(line) AS start_line, coalesce(string_agg(text, chr(10) ORDER BY line) FILTER (WHERE level IS NULL), '') AS text FROM s WHERE k > 0 OR every = 0 GROUP BY doc_id, k),
w AS (SELECT *, {", ".join(f"max(CASE WHEN level = {i} THEN section END) OVER (PARTITION BY doc_id ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l{i}" for i in range(1, 7))} FROM g),
sec AS (SELECT doc_id, section, level, heading, start_line, text, 'sec_' || substr(sha256(level || '::' || coalesce(heading, '') || '::' || start_line), 1, 8) AS section_id, CASE level {" ".join(f"WHEN {n} THEN greatest({', '.join(f'l{i}' for i in range(1, n))})" for n in range(2, 7))} END AS parent FROM w)"""


@query(f"WITH src AS (SELECT doc_id, text FROM documents), {_ALL_SECTIONS} SELECT doc_id, section, level, heading, start_line::INT AS start_line, section_id, parent, text FROM sec")
def parse_sections_documents(spark, d):
    return chunking.sections(_docs(spark, d))


@query(
    f"""WITH src AS ({_HEADED}), {_SECTIONS}, p AS (SELECT doc_id, section, section_id, heading, unnest(range(0, len(x))) AS para, unnest(x) AS text FROM (SELECT *, string_split(text, chr(10) || chr(10)) AS x FROM sec)),
q AS (SELECT doc_id, section, heading, para, {_strip("text")} AS text, 'section:' || section_id || ':para:' || para AS location FROM p)
SELECT doc_id, section, para::INT AS para, text, location, 'chunk_' || substr(sha256('doc:' || doc_id || '::document_structured::' || location || '::' || lower(text)), 1, 8) AS chunk_id,
  CASE WHEN regexp_matches(lower(heading), 'definition|definitions|overview|introduction') THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS boost FROM q WHERE length(text) >= 40"""
)
def structured_chunks(spark, d):
    return chunking.structured_chunks(_headed(spark, d))


@query(
    f"""WITH src AS (SELECT doc_id, text FROM documents), {_ALL_SECTIONS}, p AS (SELECT doc_id, section, section_id, heading, unnest(range(0, len(x))) AS para, unnest(x) AS text FROM (SELECT *, string_split(text, chr(10) || chr(10)) AS x FROM sec)),
q AS (SELECT doc_id, section, heading, para, {_strip("text")} AS text, 'section:' || section_id || ':para:' || para AS location FROM p)
SELECT doc_id, section, para::INT AS para, text, location, 'chunk_' || substr(sha256('doc:' || doc_id || '::document_structured::' || location || '::' || lower(text)), 1, 8) AS chunk_id,
  CASE WHEN regexp_matches(lower(heading), 'definition|definitions|overview|introduction') THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS boost FROM q WHERE length(text) >= 40"""
)
def structured_chunks_documents(spark, d):
    return chunking.structured_chunks(_docs(spark, d))


_ABBREVIATIONS = "|".join(a.replace(".", "\\.") for a in sorted(T.ABBREVIATIONS, key=lambda a: (-len(a), a)))


def _sentences(source: str) -> str:
    return f"""SELECT doc_id, para::INT AS para, (i - 1)::INT AS pos, s[i] AS text FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, para, list_filter(list_transform(string_split(regexp_replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({_ABBREVIATIONS})\\.', '\\1\\2' || chr(2), 'g'), '([0-9])\\.([0-9])', '\\1' || chr(2) || '\\2', 'g'), '(^|[^\\p{{L}}\\p{{N}}_])([A-Z])\\.', '\\1\\2' || chr(2), 'g'), '(^|[^\\p{{L}}\\p{{N}}_])([A-Z])\\.', '\\1\\2' || chr(2), 'g'),
  '([.!?])\\s+([A-Z"''(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: {_strip("replace(x, chr(2), '.')")}), lambda x: x <> '') AS s
  FROM (SELECT doc_id, para, {_strip("p")} AS p FROM (SELECT doc_id, unnest(range(0, len(x))) AS para, unnest(x) AS p FROM (SELECT doc_id, regexp_split_to_array(text, '\\n{{2,}}') AS x FROM {source}))) WHERE p <> ''))"""


@query(_sentences("documents"))
def split_sentences(spark, d):
    return chunking.sentences(_docs(spark, d))


@query(f"WITH src AS ({_HEADED}) {_sentences('src')}")
def split_sentences_guarded(spark, d):
    return chunking.sentences(_headed(spark, d))


@query(
    f"""SELECT doc_id, n_lines, n_valid, mean_length, n_valid >= 3 AND n_valid * 2 >= n_lines AND mean_length <= 120 AND n_says >= 2 AS is_glossary FROM (
SELECT doc_id, count(*) AS n_lines, count(*) FILTER ({_IS_LINE.format(x="t")}) AS n_valid, avg(length(t)) AS mean_length, count(*) FILTER (regexp_matches(t, '(?i)^.{{1,60}} (is|depends on) ')) AS n_says
FROM (SELECT doc_id, {_strip("text")} AS t FROM ({_LINES.format(source="documents")})) WHERE t <> '' GROUP BY doc_id)"""
)
def glossary_detect(spark, d):
    return chunking.glossary_documents(_docs(spark, d))


# Extraction

_PIECES = "SELECT doc_id, unnest(range(0, len(x))) AS pos, unnest(x) AS raw FROM (SELECT doc_id, string_split(text, '.') AS x FROM {source})"


def _definitions(source: str) -> str:
    pick = lambda k: "CASE " + " ".join(f"WHEN regexp_matches(s, '(?i){p}') THEN {_strip(f'regexp_extract(s, {chr(39)}(?i){p}{chr(39)}, {k})')}" for p in extraction.DEFINITIONS) + " END"
    return f"""SELECT doc_id, pos::INT AS pos, {pick(1)} AS term, {pick(2)} AS definition, 0.8::DOUBLE AS confidence
FROM (SELECT doc_id, pos, {_strip("raw")} || '.' AS s FROM ({_PIECES.format(source=source)}) WHERE length({_strip("raw")}) > 15) WHERE {pick(1)} IS NOT NULL"""


@query(_definitions("documents"))
def extract_definitions(spark, d):
    return extraction.definitions(_docs(spark, d))


@query(f"WITH src AS ({_HEADED}) {_definitions('src')}")
def extract_definitions_all_patterns(spark, d):
    return extraction.definitions(_headed(spark, d))


_CLAIMS = f"""SELECT doc_id, pos::INT AS pos, t || '.' AS claim FROM (SELECT doc_id, pos, {_strip("raw")} AS t FROM ({_PIECES.format(source="documents")}))
WHERE length(t) >= 20 AND NOT ends_with(t, '?') AND NOT regexp_matches(lower(t), '^(define|step)')"""


@query(_CLAIMS)
def extract_claims(spark, d):
    return extraction.claims(_docs(spark, d))


def _procedures(source: str) -> str:
    return f"""SELECT doc_id, CASE WHEN len(l) >= 2 THEN 'list_v1' ELSE 'sequence_v1' END AS method, CASE WHEN len(l) >= 2 THEN 0.75::DOUBLE ELSE 0.6::DOUBLE END AS confidence,
  CASE WHEN len(l) >= 2 THEN len(l) ELSE len(t) END::INT AS n_steps, array_to_string(list_transform(CASE WHEN len(l) >= 2 THEN l ELSE t END, lambda s: {_strip("s")}), ' | ') AS steps
FROM (SELECT doc_id, regexp_extract_all(text, '(?m)^\\s*(?:\\d+[.)]\\s+|[-•]\\s+)(.+)', 1) AS l, list_filter(string_split(text, '.'), lambda s: regexp_matches(s, '{extraction.SEQUENCE}')) AS t FROM {source}) WHERE len(l) >= 2 OR len(t) >= 2"""


@query(f"WITH src AS ({_HEADED}) {_procedures('src')}")
def extract_procedures(spark, d):
    return extraction.procedures(_headed(spark, d))


@query(_procedures("documents"))
def extract_procedures_documents(spark, d):
    return extraction.procedures(_docs(spark, d))


def _relationships(source: str) -> str:
    match = "CASE " + " ".join(f"WHEN regexp_matches(s, '(?i){p}') THEN '{n}'" for n, _, p in extraction.RELATIONSHIPS) + " END"
    arms = lambda f: "CASE pattern " + " ".join(f"WHEN '{n}' THEN {f(r, p)}" for n, r, p in extraction.RELATIONSHIPS) + " END"
    source_term, relation = arms(lambda r, p: f"regexp_extract(s, '(?i){p}', 1)"), arms(lambda r, p: f"'{r}'")
    targets = arms(lambda r, p: "[" + ", ".join(f"regexp_extract(s, '(?i){p}', {k})" for k in range(2, p.count("(.+?)") + 1)) + "]")
    return f"""SELECT * FROM (SELECT doc_id, pos::INT AS pos, pattern, {_extraction_term("a")} AS src, relation, {_extraction_term("b")} AS dst
FROM (SELECT doc_id, pos, pattern, {source_term} AS a, {relation} AS relation, unnest({targets}) AS b
FROM (SELECT *, {match} AS pattern FROM (SELECT doc_id, i - 1 AS pos, x[i] AS s FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(
  regexp_replace({_strip("text")}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda y: {_strip("y")}), lambda y: y <> '') AS x FROM {source}))) WHERE pattern IS NOT NULL))) WHERE length(src) >= 2 AND length(dst) >= 2"""


@query(_relationships("documents"))
def extract_relationships(spark, d):
    return extraction.relationships(_docs(spark, d))


@query(f"WITH src AS ({_HEADED}) {_relationships('src')}")
def extract_relationships_all_patterns(spark, d):
    return extraction.relationships(_headed(spark, d))


@query(
    """WITH known AS (SELECT n_nationkey::BIGINT AS doc_id, 'Trade of ' || n_name || ' is not open to all.' AS claim FROM nation),
new AS (SELECT c_custkey AS doc_id, 'Trade of ' || n_name || ' is open to all.' AS claim FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT new.doc_id, new.claim, max(known.doc_id) AS against FROM new JOIN known ON lower(replace(replace(new.claim, ' is ', ' is not '), ' can ', ' cannot ')) = lower(known.claim) GROUP BY ALL"""
)
def contradictions(spark, d):
    nation = _t(spark, d, "nation")
    known = nation.select(F.col("n_nationkey").cast("long").alias("doc_id"), F.concat(F.lit("Trade of "), "n_name", F.lit(" is not open to all.")).alias("claim"))
    new = _t(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("Trade of "), "n_name", F.lit(" is open to all.")).alias("claim"))
    return extraction.contradictions(new, known)


# Classification


def _scores(text: str, boost: int) -> str:
    def score(category: str) -> str:
        total = []
        for own, phrases, structure, priority in classify.RULES:
            if own == category:
                hits = " + ".join([f"regexp_matches({text}, '{classify.phrase_pattern(p)}')::INT" for p in phrases] + ([f"regexp_matches({text}, '(?i){structure}')::INT"] if structure else []))
                total.append(f"CASE WHEN {hits} > 0 THEN {hits} + {priority} ELSE 0 END")
        return "(" + " + ".join(total) + ")"

    return ", ".join(f"{score(c)} AS {c}" for c in classify.CATEGORIES)


_CLASSES = f"""SELECT *, greatest({", ".join(classify.CATEGORIES)}) AS score FROM (SELECT conv_id, turn, {_scores("t", 0)} FROM (SELECT conv_id, turn, lower({_strip("text")}) AS t FROM conversations))"""
_WINNER = "CASE " + "WHEN score = 0 THEN 'unknown' " + " ".join(f"WHEN score = {c} THEN '{c}'" for c in classify.CATEGORIES) + " END"


@query(f"SELECT conv_id, turn, score::INT AS score, {_WINNER} AS category, least(1.0::DOUBLE, score / 10.0::DOUBLE) AS confidence FROM ({_CLASSES})")
def classify_chunks(spark, d):
    return classify.classify(_t(spark, d, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", "score", "category", "confidence")


@query(f"SELECT category, count(*) AS n FROM (SELECT {_WINNER} AS category FROM ({_CLASSES})) GROUP BY category")
def dispatch_counts(spark, d):
    return classify.classify(_t(spark, d, "conversations").select("text")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


# Validation

_CANDIDATES = """cand AS (SELECT o_orderkey AS candidate_id, CASE WHEN o_orderkey % 3 = 0 THEN upper(n_name) WHEN o_orderkey % 3 = 1 THEN lower(n_name) ELSE 'order ' || o_orderkey END AS value,
  'doc:' || (o_orderkey % 40) AS source_id, CASE WHEN o_orderkey % 5 = 0 THEN 'c' || (o_orderkey % 7) END AS chunk_id, 'm' AS method, CASE o_orderstatus WHEN 'F' THEN 'dataset' WHEN 'O' THEN 'document' ELSE 'execution' END AS source_type,
  (o_orderkey % 100) / 100.0::DOUBLE AS confidence, (o_orderkey % 4)::INT AS filled FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
node AS (SELECT 'n' || n_nationkey AS id, n_name AS value, 'doc:' || n_nationkey AS source_id, 'c' || (n_nationkey % 7) AS chunk_id, 'm' AS method FROM nation
  UNION ALL SELECT 'p' || x.n_nationkey, y.n_name, 'doc:' || x.n_nationkey, 'c' || (x.n_nationkey % 7), 'm' FROM nation x JOIN nation y ON y.n_nationkey = (x.n_nationkey + 1) % 25 WHERE x.n_nationkey % 2 = 0
  UNION ALL SELECT 'q' || n_nationkey, n_name, 'doc:' || n_nationkey, 'c' || (n_nationkey % 7), 'm' FROM nation)"""


def _candidates(spark, d):
    k = F.col("o_orderkey")
    rows = _t(spark, d, "orders").join(_t(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(_t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    cand = rows.select(
        k.alias("candidate_id"), F.when(k % 3 == 0, F.upper("n_name")).when(k % 3 == 1, F.lower("n_name")).otherwise(F.concat(F.lit("order "), k.cast("string"))).alias("value"), F.concat(F.lit("doc:"), (k % 40).cast("string")).alias("source_id"),
        F.when(k % 5 == 0, F.concat(F.lit("c"), (k % 7).cast("string"))).alias("chunk_id"), F.lit("m").alias("method"), F.when(F.col("o_orderstatus") == "F", "dataset").when(F.col("o_orderstatus") == "O", "document").otherwise("execution").alias("source_type"),
        ((k % 100) / 100.0).alias("confidence"), (k % 4).cast("int").alias("filled"),
    )
    n, nation = F.col("n_nationkey"), _t(spark, d, "nation")
    at = lambda rows, letter, value: rows.select(F.concat(F.lit(letter), n.cast("string")).alias("id"), F.col(value).alias("value"), F.concat(F.lit("doc:"), n.cast("string")).alias("source_id"), F.concat(F.lit("c"), (n % 7).cast("string")).alias("chunk_id"), F.lit("m").alias("method"))
    after = nation.select(((n + 24) % 25).alias("n_nationkey"), F.col("n_name").alias("next"))
    # A place has one value, stated twice (n, q), and where the key is even another one between them (p).
    node = at(nation, "n", "n_name").unionByName(at(nation.join(after, "n_nationkey").filter(n % 2 == 0), "p", "next")).unionByName(at(nation, "q", "n_name"))
    return cand, node


@query(
    f"""WITH {_CANDIDATES}, j AS (SELECT c.*, (SELECT min(id) FROM node WHERE node.value = c.value) AS exact_id, (SELECT min(id) FROM node WHERE lower(trim(node.value)) = lower(trim(c.value))) AS loose_id,
  (SELECT min(id) FROM node WHERE node.source_id = c.source_id AND node.chunk_id = c.chunk_id AND node.method = c.method AND node.value <> c.value) AS other_id FROM cand c),
s AS (SELECT *, greatest(0, least(1, 0.7 * confidence + 0.2 * CASE source_type WHEN 'dataset' THEN 1.0 WHEN 'execution' THEN 0.8 ELSE 0.6 END + 0.1 * filled / 3))::DOUBLE AS sc FROM j)
SELECT candidate_id, CASE WHEN other_id IS NOT NULL THEN 'conflict' WHEN coalesce(exact_id, loose_id) IS NOT NULL THEN 'merge' WHEN sc < 0.5 THEN 'reject' ELSE 'accept' END AS decision, round(sc, 6) AS score, coalesce(other_id, exact_id, loose_id) AS node_id FROM s"""
)
def validate_candidates(spark, d):
    return validation.decide(*_candidates(spark, d))


# Graph


def _edges(spark, d):
    return graph.edge_table(extraction.relationships(_docs(spark, d)))


_EDGES = f"rel AS ({_relationships('documents')}), edge AS (SELECT src, dst, relation, 0.75::DOUBLE AS salience, count(DISTINCT doc_id) AS n_documents, min(doc_id) AS first_doc FROM rel GROUP BY ALL)"


@query(f"WITH {_EDGES} SELECT * FROM edge")
def edge_dedup(spark, d):
    return _edges(spark, d)


@query(f"""WITH {_EDGES} SELECT DISTINCT 'dn_' || substr(sha256('Entity::''' || value || ''''), 1, 16) AS id, value, 'Entity' AS sem_type, 0.5::DOUBLE AS salience FROM (SELECT src AS value FROM edge UNION SELECT dst FROM edge)""")
def term_nodes(spark, d):
    return graph.term_nodes(_edges(spark, d))


_DEFINED = f"""def AS ({_definitions("documents")}), named AS (SELECT *, term || ' is ' || definition || '.' AS value FROM def),
dnode AS (SELECT 'dn_' || substr(sha256('Entity::' || CASE WHEN contains(value, '''') AND NOT contains(value, '"') THEN '"' || replace(value, '\\', '\\\\') || '"' ELSE '''' || replace(replace(value, '\\', '\\\\'), '''', '\\''') || '''' END), 1, 16) AS id, * FROM named),
node AS (SELECT id, value, term, definition, confidence, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_id, pos) AS k FROM dnode) WHERE k = 1)"""


@query(f"WITH {_DEFINED} SELECT * FROM node")
def definition_nodes(spark, d):
    return graph.definition_nodes(extraction.definitions(_docs(spark, d)))


@query(
    f"""WITH {_EDGES}, p AS (SELECT src, dst, relation, doc_id, min(pos) AS step FROM rel GROUP BY ALL), q AS (SELECT src, dst, relation, 'tr_' || substr(sha256('doc:' || doc_id || ':relationship_extractor:' || step), 1, 12) AS trace_id, min(step) AS step FROM p GROUP BY ALL)
SELECT src, dst, relation, trace_id, row_number() OVER (PARTITION BY src, dst, relation ORDER BY step, trace_id)::INT AS place FROM q"""
)
def provenance_merge(spark, d):
    return graph.merged_provenance(graph.provenance(extraction.relationships(_docs(spark, d))))


@query(
    f"""WITH {_EDGES}, p AS (SELECT src, dst, relation, doc_id, min(pos) AS step FROM rel GROUP BY ALL), q AS (SELECT DISTINCT src, dst, relation, 'tr_' || substr(sha256('doc:' || doc_id || ':relationship_extractor:' || step), 1, 12) AS trace_id FROM p)
SELECT src, dst, relation, trace_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, relation ORDER BY trace_id) AS rank FROM q) WHERE rank <= 3"""
)
def provenance_top3(spark, d):
    return graph.top_provenance(graph.provenance(extraction.relationships(_docs(spark, d)))).select("src", "dst", "relation", "trace_id", "rank")


@query("""SELECT n_nationkey AS key, 0.5 * pow(0.95, n_nationkey) AS raw, greatest(0.01, 0.5 * pow(0.95, n_nationkey * 10)) AS salience FROM nation""")
def salience_decay(spark, d):
    k = F.col("n_nationkey")
    return _t(spark, d, "nation").select(k.alias("key"), (0.5 * F.pow(F.lit(0.95), k)).alias("raw"), graph.decayed(F.lit(0.5), k * 10).alias("salience"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id AS node, date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) + 1 AS step, 0.5 * count(*) AS amount FROM events GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY step) AS i FROM e), last AS (SELECT max(step) AS last FROM e),
f AS (SELECT node, i, step, greatest(0.01, amount * 0.95)::DOUBLE AS s FROM k WHERE i = 1 UNION ALL
  SELECT k.node, k.i, k.step, greatest(0.01, (greatest(0.01, f.s * pow(0.95, k.step - f.step - 1)) + k.amount) * 0.95)::DOUBLE FROM f JOIN k ON k.node = f.node AND k.i = f.i + 1)
SELECT node, round(greatest(0.01, arg_max(s, i) * pow(0.95, (SELECT last FROM last) - max(step))), 9) AS salience FROM f GROUP BY node"""
)
def salience_reinforce(spark, d):
    ev = _t(spark, d, "events")
    span = ev.agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b")).first()
    step = F.datediff(F.to_date("ts"), F.lit(span["a"])) + 1
    return graph.reinforced(ev.select("user_id", step.cast("long").alias("step"), F.lit(0.5).alias("amount")), "user_id", "step", "amount", (span["b"] - span["a"]).days + 1)


# Graph queries


def _star(spark, d):
    """Order -> customer -> nation -> region as part_of and depends_on edges."""
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = lambda df, a, b, r: df.select(a.alias("src"), b.alias("dst"), F.lit(r).alias("relation"), F.lit(0.75).alias("salience"))
    orders, customer, nation = _t(spark, d, "orders"), _t(spark, d, "customer"), _t(spark, d, "nation")
    out = e(orders, s("o", "o_orderkey"), s("c", "o_custkey"), "depends_on").unionByName(e(customer, s("c", "c_custkey"), s("n", "c_nationkey"), "part_of"))
    return out.unionByName(e(nation, s("n", "n_nationkey"), s("r", "n_regionkey"), "part_of"))


_STAR = "star AS (SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst, 'depends_on' AS relation FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'part_of' FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'part_of' FROM nation)"


def _whole_star(spark, d):
    """_star with lineitem -> order, lineitem -> supplier and supplier -> nation: a part of it has several paths to its nation."""
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = lambda df, a, b, r: df.select(a.alias("src"), b.alias("dst"), F.lit(r).alias("relation"), F.lit(0.75).alias("salience"))
    lineitem, supplier = _t(spark, d, "lineitem"), _t(spark, d, "supplier")
    item = F.concat(F.lit("l"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    out = _star(spark, d).unionByName(e(lineitem, item, s("o", "l_orderkey"), "part_of")).unionByName(e(lineitem, item, s("s", "l_suppkey"), "depends_on"))
    return out.unionByName(e(supplier, s("s", "s_suppkey"), s("n", "s_nationkey"), "part_of"))


_WHOLE_STAR = f"""{_STAR}, whole AS (SELECT * FROM star UNION ALL SELECT 'l' || l_orderkey || '.' || l_linenumber, 'o' || l_orderkey, 'part_of' FROM lineitem UNION ALL
  SELECT 'l' || l_orderkey || '.' || l_linenumber, 's' || l_suppkey, 'depends_on' FROM lineitem UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'part_of' FROM supplier)"""
_CLOSURE = "steps AS (SELECT DISTINCT src, dst FROM {edges}), walk AS (SELECT src AS source, dst AS target, 1 AS depth, [src, dst] AS path FROM steps WHERE src <> dst UNION ALL SELECT source, dst, depth + 1, list_append(path, dst) FROM walk JOIN steps ON src = target WHERE depth < 3 AND NOT list_contains(path, dst))"


@query(f"WITH RECURSIVE {_STAR}, {_CLOSURE.format(edges='star')} SELECT source, target, depth::INT AS depth, array_to_string(path, '>') AS path FROM walk")
def closure_depth3(spark, d):
    return graph_queries.closure_of_all(_star(spark, d))


@query(f"WITH RECURSIVE {_EDGES}, {_CLOSURE.format(edges='edge')} SELECT source, target, depth::INT AS depth, array_to_string(path, '>') AS path FROM walk")
def closure_terms(spark, d):
    return graph_queries.closure_of_all(written(_edges(spark, d).select("src", "dst"), "edges"))  # each step reads it


@query(
    f"""WITH RECURSIVE {_STAR}, {_CLOSURE.format(edges="star")}, g AS (SELECT source, target, min(depth) AS depth, count(*) AS n, count(*) FILTER (depth = 1) AS n1 FROM walk GROUP BY ALL)
SELECT source, target, CASE WHEN depth = 1 THEN 'direct' ELSE 'indirect' END AS kind, depth::INT AS depth, CASE WHEN depth = 1 THEN n1 ELSE n END AS n_paths FROM g"""
)
def compose_relationships(spark, d):
    return graph_queries.composed_by_counts(None, _star(spark, d))


@query(f"WITH RECURSIVE {_WHOLE_STAR}, {_CLOSURE.format(edges='whole')} SELECT source, target, depth::INT AS depth, array_to_string(path, '>') AS path FROM walk")
def closure_depth3_lineitem(spark, d):
    return graph_queries.closure_of_all(_whole_star(spark, d))


@query(
    f"""WITH RECURSIVE {_WHOLE_STAR}, {_CLOSURE.format(edges="whole")}, g AS (SELECT source, target, min(depth) AS depth, count(*) AS n, count(*) FILTER (depth = 1) AS n1 FROM walk GROUP BY ALL)
SELECT source, target, CASE WHEN depth = 1 THEN 'direct' ELSE 'indirect' END AS kind, depth::INT AS depth, CASE WHEN depth = 1 THEN n1 ELSE n END AS n_paths FROM g"""
)
def compose_relationships_lineitem(spark, d):
    return graph_queries.composed_by_counts(None, _whole_star(spark, d))


#: Parts that are sold together: an edge from each line of an order to the next line, and from the last to the first.
_SOLD = """sold AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem), pair AS (SELECT DISTINCT 'p' || x.l_partkey AS src, 'p' || y.l_partkey AS dst FROM sold x JOIN (SELECT l_orderkey, max(l_linenumber) AS m FROM sold GROUP BY 1) USING (l_orderkey)
  JOIN sold y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = CASE WHEN x.l_linenumber = m THEN 1 ELSE x.l_linenumber + 1 END WHERE x.l_partkey <> y.l_partkey)"""


def _sold(spark, d):
    sold = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    last = sold.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("m"))
    nth = sold.join(last, "l_orderkey").select("l_orderkey", F.col("l_partkey").alias("a"), F.when(F.col("l_linenumber") == F.col("m"), 1).otherwise(F.col("l_linenumber") + 1).alias("l_linenumber"))
    both = nth.join(sold, ["l_orderkey", "l_linenumber"]).filter(F.col("a") != F.col("l_partkey"))
    return both.select(F.concat(F.lit("p"), F.col("a").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")).distinct()


@query(f"WITH {_SOLD} SELECT x.src, x.dst FROM pair x JOIN pair y ON x.src = y.dst AND x.dst = y.src")
def cycle_edges(spark, d):
    return graph_queries.cycles(written(_sold(spark, d), "sold"))


_RELATED = """, edges AS (SELECT src, dst, relation, 1 + length(src) % 3 AS n_provenance FROM whole), asked AS (SELECT DISTINCT 'O' || o_orderkey AS term, 'depends_on' AS relation FROM orders UNION SELECT 'c' || c_custkey, 'part_of' FROM customer UNION SELECT 's' || s_suppkey, 'part_of' FROM supplier UNION SELECT 'none ' || r_name, 'part_of' FROM region),
walk AS (SELECT term, a.relation, lower(term) AS start, dst AS target, 1 AS depth, [lower(term), dst] AS path, n_provenance::BIGINT AS n FROM asked a JOIN edges e ON e.src = lower(term) AND e.relation = a.relation
  UNION ALL SELECT term, w.relation, start, dst, depth + 1, list_append(path, dst), n + n_provenance FROM walk w JOIN edges e ON e.src = target AND e.relation = w.relation WHERE depth < 3 AND NOT list_contains(path, dst))"""


def _related(spark, d):
    edges = _whole_star(spark, d).select("src", "dst", "relation", (1 + F.char_length("src") % 3).alias("n_provenance"))
    s = lambda table, p, c, r: _t(spark, d, table).select(F.concat(F.lit(p), F.col(c).cast("string")).alias("term"), F.lit(r).alias("relation"))
    asked = s("orders", "O", "o_orderkey", "depends_on").unionByName(s("customer", "c", "c_custkey", "part_of")).unionByName(s("supplier", "s", "s_suppkey", "part_of")).unionByName(s("region", "none ", "r_name", "part_of"))
    return asked, edges


@query(f"WITH RECURSIVE {_WHOLE_STAR}{_RELATED} SELECT term, relation, target, depth::INT AS depth, array_to_string(path, ' → ') AS path, n AS n_provenance FROM walk")
def closure_by_relation(spark, d):
    return graph_queries.related_closure(*_related(spark, d))


@query(f"WITH RECURSIVE {_WHOLE_STAR}{_RELATED} SELECT term, relation, coalesce(n, 0) AS n_paths, false AS cycle, n IS NULL AS fallback FROM asked LEFT JOIN (SELECT term, relation, count(*) AS n FROM walk GROUP BY ALL) USING (term, relation)")
def closure_flags(spark, d):
    return graph_queries.closure_flags(*_related(spark, d))


@query(
    f"""WITH {_SOLD}, one AS (SELECT src AS term, dst AS a FROM pair), two AS (SELECT term, a, dst AS b FROM one JOIN pair ON src = a), n AS (SELECT term, count(*) FILTER (b <> term) AS n2, bool_or(b = term) AS c FROM two GROUP BY term)
SELECT term, 'next' AS relation, (SELECT count(*) FROM one o WHERE o.term = p.term) + coalesce(n2, 0) AS n_paths, coalesce(c, false) AS cycle, false AS fallback FROM (SELECT DISTINCT term FROM one) p LEFT JOIN n USING (term)"""
)
def closure_flags_cycles(spark, d):
    sold = written(_sold(spark, d).withColumn("relation", F.lit("next")), "sold")
    return graph_queries.closure_flags(sold.select(F.col("src").alias("term"), "relation"), sold, depth=2)


@query(
    f"""WITH {_DEFINED}, asked AS (SELECT DISTINCT split_part({_strip("text")}, ' ', 1) AS term FROM documents), norm AS (SELECT *, {_strip("regexp_replace(lower(term), '[^\\p{L}\\p{N}_\\s]', '', 'g')")} AS k FROM node),
best AS (SELECT k, count(*) AS n, arg_min(struct_pack(id := id, definition := definition, confidence := confidence), struct_pack(c := -confidence, id := id)) AS b FROM norm GROUP BY k)
SELECT term, b IS NOT NULL AS found, coalesce(b.definition, 'No definition found for ''' || term || '''.') AS definition, b.confidence AS confidence, b.id AS node_id, coalesce(n, 0) AS n_candidates
FROM asked LEFT JOIN best ON {_strip("regexp_replace(lower(term), '[^\\p{L}\\p{N}_\\s]', '', 'g')")} = k"""
)
def get_definition(spark, d):
    asked = _docs(spark, d).select(F.split_part(T.stripped("text"), F.lit(" "), F.lit(1)).alias("term")).distinct()
    return graph_queries.get_definitions(asked, graph.definition_nodes(extraction.definitions(_docs(spark, d))))


@query(f"WITH {_STAR}, asked AS (SELECT DISTINCT 'O' || o_orderkey AS term FROM orders) SELECT term, dst AS target, 0.75::DOUBLE AS salience, row_number() OVER (PARTITION BY term ORDER BY dst)::INT AS rank FROM asked JOIN star ON {_query_term('term')} = src WHERE relation = 'depends_on'")
def get_relationships(spark, d):
    asked = _t(spark, d, "orders").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("term")).distinct()
    return graph_queries.get_relationships(asked, _star(spark, d), "depends_on")


_ASKED = "asked AS (SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) || ' ' ELSE 'no ' || c_custkey END AS key FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def _asked(spark, d):
    rows = _t(spark, d, "customer").join(F.broadcast(_t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey") % 3
    return rows.select(F.when(k == 0, F.col("n_name")).when(k == 1, F.concat(F.lower("n_name"), F.lit(" "))).otherwise(F.concat(F.lit("no "), F.col("c_custkey").cast("string"))).alias("key")).distinct()


@query(
    f"""WITH {_ASKED}, ds AS (SELECT n_name AS key, r_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT key, coalesce(e, l, '__lookup_miss__:nations:' || key) AS value, CASE WHEN e IS NOT NULL THEN 'exact' WHEN l IS NOT NULL THEN 'normalized' ELSE 'miss' END AS hit
FROM (SELECT key, (SELECT min(value) FROM ds WHERE ds.key = asked.key) AS e, (SELECT min(value) FROM ds WHERE lower(trim(ds.key)) = lower(trim(asked.key))) AS l FROM asked)"""
)
def dataset_lookup(spark, d):
    ds = _t(spark, d, "nation").join(F.broadcast(_t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("key"), F.col("r_name").alias("value"), F.col("n_nationkey").alias("seq"))
    return graph_queries.dataset_lookup(_asked(spark, d), ds, "nations")


_CAPITALS = ", ".join(f"('{k}', '{v}')" for k, v in docs_source.COUNTRY_CAPITALS.items())


@query(f"WITH ds(k, v) AS (VALUES {_CAPITALS}) SELECT n_name AS key, coalesce(v, '__lookup_miss__:country_capitals_v1:' || n_name) AS value, CASE WHEN v IS NULL THEN 'miss' WHEN k = n_name THEN 'exact' ELSE 'normalized' END AS hit FROM nation LEFT JOIN ds ON lower(k) = lower(n_name)")
def capital_of(spark, d):
    ds = docs_source.inline_dataset(spark, "country_capitals_v1", docs_source.COUNTRY_CAPITALS)
    return graph_queries.dataset_lookup(_t(spark, d, "nation").select(F.col("n_name").alias("key")), ds, "country_capitals_v1")


# Routing

#: Questions made from the star schema: (condition on the key, before, after).
_ASKS = ("what is {}", "capital of {}", "what does {} ultimately depend on", "show dependency chain for {}", "what affects {}", "deposit 50 into {}", "simplify {} + 0", "find first port in {}", "xyzzy {}", "indirect dependencies of {}", "Can you explain {}?")


def _questions(spark, d):
    k = F.col("c_custkey") % len(_ASKS)
    text = F.lit(None).cast("string")
    for i, q in enumerate(_ASKS):
        text = F.when(k == i, F.concat(F.lit(q.split("{}")[0]), F.lower("n_name"), F.lit(q.split("{}")[1]))).otherwise(text)
    return _t(spark, d, "customer").join(F.broadcast(_t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", text.alias("text"))


_QUESTIONS = "q AS (SELECT c_custkey, CASE c_custkey % " + str(len(_ASKS)) + " " + " ".join(f"WHEN {i} THEN '{q.split('{}')[0]}' || lower(n_name) || '{q.split('{}')[1]}'" for i, q in enumerate(_ASKS)) + " END AS text FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def _after_sql(word: str) -> str:
    return f"CASE WHEN list_position(low, '{word}') > 0 THEN nullif(array_to_string(words[list_position(low, '{word}') + 1:], ' '), '') END"


def _route_sql(source: str, key: str, text: str) -> str:
    no_term = ", ".join(f"'{w}'" for w in routing.NO_TERM)
    relation = "CASE " + " ".join(f"WHEN list_has_any(l, [{', '.join(repr(w) for w in f)}]) THEN '{n}'" for n, f in routing.RELATION_WORDS) + " END"
    verbs = "['simplify', 'expand', 'factor', 'solve', 'calculate', 'compute', 'differentiate', 'integrate', 'evaluate']"
    AT = f"list_position(list_transform(low, lambda x: list_contains({verbs}, x)), true)"
    tail = "nullif(array_to_string(words[2:], ' '), '')"
    P = "list_position(low, 'force')"
    stop, both = f"list_position(list_transform(low[{P} + 1:], lambda x: x IN ('and', 'mass')), true)", f"list_position(low[{P} + 1:], 'and')"
    FORCE = f"CASE WHEN {P} > 0 THEN coalesce(CASE WHEN {both} > 1 THEN array_to_string(words[{P} + 1:{P} + {both} - 1], ' ') END, nullif(array_to_string(CASE WHEN {stop} > 0 THEN words[{P} + 1:{P} + {stop} - 1] ELSE words[{P} + 1:] END, ' '), '')) END"
    arms = []
    for rule, operator, keywords, required, _, priority in routing.ranked_rules():
        test = " AND ".join([f"list_contains(l, '{w}')" for w in keywords] + [f"{s} IS NOT NULL" for s in required])
        arms.append((test, rule, operator, priority))
    pick = lambda i: "CASE " + " ".join(f"WHEN {a[0]} THEN " + (f"'{a[i]}'" if isinstance(a[i], str) else str(a[i])) for a in arms) + " END"
    return f"""t AS (SELECT {key}, regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_]+(?:''[\\p{{L}}\\p{{N}}_]+)?|[^\\p{{L}}\\p{{N}}_\\s]') AS t FROM {source}),
w AS (SELECT *, list_transform(t, lambda x: lower(x)) AS l, list_filter(t, lambda x: x NOT IN ('?', '.', ',', '!', ';', ':')) AS words FROM t), v AS (SELECT *, list_transform(words, lambda x: lower(x)) AS low FROM w),
s AS (SELECT *, nullif(trim(array_to_string(list_filter(words, lambda x: lower(x) NOT IN ({no_term})), ' ')), '') AS term, {relation} AS relation_type, {_after_sql("of")} AS region,
  CASE WHEN {AT} > 0 THEN nullif(array_to_string(words[{AT} + 1:], ' '), '') ELSE {tail} END AS expression, {FORCE} AS force, coalesce({_after_sql("mass")}, {_after_sql("weight")}) AS mass,
  CASE WHEN list_position(low, 'first') > 0 AND list_position(low, 'in') > list_position(low, 'first') + 1 THEN 'x' END AS predicate, {_after_sql("in")} AS collection, coalesce({_after_sql("of")}, {tail}) AS substance,
  coalesce({_after_sql("into")}, {_after_sql("from")}, {_after_sql("account")}) AS account, list_filter(words, lambda x: regexp_matches(x, '^\\d+(\\.\\d+)?$'))[1] AS amount FROM v)
SELECT {key}, {pick(1)} AS rule, coalesce({pick(2)}, 'generic') AS operator, ({pick(3)})::INT AS priority, term, relation_type, region, expression, amount FROM s"""


@query(f"WITH {_QUESTIONS}, {_route_sql('q', 'c_custkey', 'text')}")
def route_questions(spark, d):
    return routing.route(_questions(spark, d)).drop("text")


@query(f"WITH {_route_sql('conversations', 'conv_id, turn', 'text')}")
def route_conversations(spark, d):
    return routing.route(_t(spark, d, "conversations").select("conv_id", "turn", "text")).drop("text")


@query(f"WITH {_QUESTIONS} SELECT c_custkey, trim(regexp_replace({_query_term('text')}, '{routing.POLITE}', '')) AS normalized FROM q")
def normalize_query(spark, d):
    return _questions(spark, d).select("c_custkey", routing.normalized_query(F.col("text")).alias("normalized"))


@query("SELECT conv_id, turn, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+(?:''[\\p{L}\\p{N}_]+)?|[^\\p{L}\\p{N}_\\s]'))::INT AS n_tokens FROM conversations")
def tokenize(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", F.size(F.regexp_extract_all("text", F.lit(routing.TOKEN), F.lit(0))).alias("n_tokens"))


# Typed operators


@query("SELECT o_orderkey, o_totalprice + 50.0 AS deposited, o_totalprice - 50.0 AS withdrawn, o_totalprice * 0.05 * 2.0 AS interest, o_totalprice * pow(1 + 0.1, 2.0) AS compound, o_totalprice > 100000.0 AS over FROM orders")
def finance_operators(spark, d):
    p, f = F.col("o_totalprice"), typed.compute
    return _t(spark, d, "orders").select(
        "o_orderkey", f("finance.DEPOSIT", p, F.lit(50.0)).alias("deposited"), f("finance.WITHDRAW", p, F.lit(50.0)).alias("withdrawn"), f("finance.COMPUTE_INTEREST", p, F.lit(0.05), F.lit(2.0)).alias("interest"),
        f("finance.COMPUTE_COMPOUND_INTEREST", p, F.lit(0.1), F.lit(2.0)).alias("compound"), f("finance.COMPARE_VALUES", p, F.lit(100000.0)).alias("over"),
    )


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN l_quantity / l_discount END AS acceleration, l_quantity + l_tax * 3.0 AS velocity, l_quantity + l_tax * 3.0 AS position, 0.5 * l_quantity * l_tax * l_tax AS kinetic,
  l_quantity * 9.8 * l_tax AS potential, l_quantity * 1000.0 AS grams FROM lineitem"""
)
def physics_operators(spark, d):
    q, disc, tax, f = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), typed.compute
    return _t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", f("physics.COMPUTE_ACCELERATION", q, disc).alias("acceleration"), f("physics.UPDATE_VELOCITY", q, tax, F.lit(3.0)).alias("velocity"), f("physics.UPDATE_POSITION", q, tax, F.lit(3.0)).alias("position"),
        f("physics.COMPUTE_KINETIC_ENERGY", q, tax).alias("kinetic"), f("physics.COMPUTE_POTENTIAL_ENERGY", q, F.lit(None).cast("double"), tax).alias("potential"), typed.converted(q, "kg", "g").alias("grams"),
    )


@query("SELECT p_partkey, p_size + p_partkey AS a, p_partkey - p_size AS s, p_size * p_partkey AS m, p_partkey::DOUBLE / nullif(p_size - 1, 0) AS q, pow(p_size, 2) AS w, p_size = p_partkey AS e, CASE WHEN p_size < 25 THEN 'lt' WHEN p_size = 25 THEN 'eq' ELSE 'gt' END AS c, replace(p_name, 'a', 'x') AS u FROM part")
def math_operators(spark, d):
    s, k, f = F.col("p_size"), F.col("p_partkey"), typed.compute
    return _t(spark, d, "part").select(
        "p_partkey", f("math.ADD", s, k).alias("a"), f("math.SUBTRACT", k, s).alias("s"), f("math.MULTIPLY", s, k).alias("m"), f("math.DIVIDE", k, s - 1).alias("q"), f("math.POWER", s, F.lit(2)).alias("w"),
        f("math.IS_EQUAL", s, k).alias("e"), f("math.COMPARE", s, F.lit(25)).alias("c"), f("math.SUBSTITUTE", F.col("p_name"), F.lit("a"), F.lit("x")).alias("u"),
    )


_NAMED = {
    "geography.LOCATED_IN": "%s located_in %s", "geography.STATE_OF": "state_of(%s)", "geography.COUNTRY_OF": "country_of(%s)", "geography.BORDER_WITH": "%s borders %s", "geography.POPULATION_OF": "population_of(%s)",
    "math.FACTOR": "factor(%s)", "math.SOLVE": "solve(%s, %s)", "math.EVALUATE_FUNCTION": "eval_fn(%s,%s)", "math.DERIVE": "d/d%s(%s)", "math.INTEGRATE": "∫(%s)d%s", "biology.CONVERT_SUBSTANCE": "convert(%s → %s)",
}
_SYMBOLIC = {name: "_" + name.lower().replace(".", "_") for name in _NAMED}


@query("SELECT n_nationkey, " + ", ".join("concat(" + ", ".join(x for i, part in enumerate(_NAMED[n].split("%s")) for x in ([f"'{part}'"] if part else []) + (["n_name"] if i < _NAMED[n].count("%s") else [])) + f") AS {c}" for n, c in _SYMBOLIC.items()) + " FROM nation")
def symbolic_operators(spark, d):
    return _t(spark, d, "nation").select("n_nationkey", *[typed.symbolic(n, *[F.col("n_name")] * _NAMED[n].count("%s")).alias(c) for n, c in _SYMBOLIC.items()])


@query(
    """WITH b AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linestatus)) AS s, list_sort(list(DISTINCT l_returnflag)) AS f, count(*) AS n, sum(l_quantity) AS total, max(l_quantity) AS top FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_concat(s, f))), ',') AS both, list_contains(f, 'R') AS has_r, n, total, top FROM b"""
)
def collection_operators(spark, d):
    b = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linestatus").alias("s"), F.collect_set("l_returnflag").alias("f"), F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total"), F.max("l_quantity").alias("top"))
    return b.select("l_orderkey", F.array_join(F.sort_array(typed.compute("math.UNION", F.col("s"), F.col("f"))), ",").alias("both"), typed.compute("math.CONTAINS", F.lit("R"), F.col("f")).alias("has_r"), "n", "total", "top")


# Reports and streams


@query(
    f"""WITH rel AS ({_relationships("documents")}), def AS ({_definitions("documents")}) SELECT source, count(*) AS n_documents, sum(coalesce(r, 0))::BIGINT AS n_triples, sum(coalesce(f, 0))::BIGINT AS n_definitions FROM documents
LEFT JOIN (SELECT doc_id, count(*) AS r FROM rel GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS f FROM def GROUP BY 1) USING (doc_id) GROUP BY source"""
)
def batch_report(spark, d):
    docs = _t(spark, d, "documents")
    triples = extraction.relationships(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("r"))
    defs = extraction.definitions(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("f"))
    joined = docs.select("doc_id", "source").join(triples, "doc_id", "left").join(defs, "doc_id", "left")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.coalesce("r", F.lit(0))).alias("n_triples"), F.sum(F.coalesce("f", F.lit(0))).alias("n_definitions"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_event_windows(spark, d):
    return streams.run_available(spark, streams.windowed(streams.event_stream(spark, f"{d}/events.parquet")))


# More typed operators; their SQL is written out by hand


def _columns(df: DataFrame, key: str, **made) -> DataFrame:
    return df.select(key, *[v.alias(k) for k, v in made.items()])


@query(
    """SELECT n_nationkey, 'filter(' || n_name || ', ' || k || ')' AS filter_, 'map(' || k || ', ' || n_name || ')' AS map_, 'reduce(' || k || ', ' || n_name || ', init=0)' AS reduce_, 'group(' || n_name || ', by=' || k || ')' AS group_, 'match(' || n_name || ', ' || k || ')' AS match_,
  'transform(' || n_name || ', ' || k || ')' AS transform_, 'split(' || n_name || ', ' || k || ')' AS split_, 'execute(' || n_name || ', ' || k || ')' AS execute_, 'query(' || n_name || ', ' || k || ')' AS query_, 'call(' || n_name || ', ' || k || ')' AS call_, 'eval(' || n_name || ')' AS eval_,
  'if(' || n_name || ',' || k || ',0)' AS if_, 'iterate(' || n_name || ',' || k || ')' AS iterate_, 'handle(' || n_name || ',' || k || ')' AS handle_, 'energy_conserved(' || n_name || ')' AS energy_, 'integrate(' || n_name || ',' || k || ')' AS integrate_,
  'trajectory(' || n_name || ',' || k || ',0)' AS trajectory_, 'collision(' || n_name || ',' || k || ')' AS collision_, 'resolve_collision(' || n_name || ',' || k || ')' AS resolve_, 'field_effect(' || n_name || ',' || k || ')' AS field_, 'break_down(' || n_name || ')' AS break_, 'build_up(' || n_name || ')' AS build_,
  'transport(' || n_name || ': ' || k || '→0)' AS transport_, 'signal(0: ' || n_name || '→' || k || ')' AS signal_, 'received(' || k || ' at ' || n_name || ')' AS received_, 'level(' || n_name || ')' AS level_, 'return(' || n_name || ',' || k || ')' AS return_, 'risk(' || n_name || ')' AS risk_,
  'portfolio+' || k AS add_asset, 'portfolio-' || k AS remove_asset, 'value(' || n_name || ')' AS value_, 'check(' || n_name || ' in ' || k || ')' AS check_, 'interpret(' || n_name || ' in ' || k || ')' AS interpret_ FROM (SELECT n_nationkey, n_name, n_regionkey::VARCHAR AS k FROM nation)"""
)
def named_operators(spark, d):
    x, k, o, f = F.col("n_name"), F.col("n_regionkey").cast("string"), F.lit("0"), typed.symbolic
    return _columns(
        _t(spark, d, "nation"), "n_nationkey", filter_=f("core.FILTER", x, k), map_=f("core.MAP", x, k), reduce_=f("core.REDUCE", x, k, o), group_=f("core.GROUP", x, k), match_=f("core.MATCH", x, k), transform_=f("core.TRANSFORM", x, k), split_=f("core.SPLIT", x, k),
        execute_=f("core.EXECUTE", x, k), query_=f("core.QUERY", x, k), call_=f("programming.CALL_FUNCTION", x, k), eval_=f("programming.EVALUATE_EXPRESSION", x), if_=f("programming.CONDITIONAL_BRANCH", x, k, o), iterate_=f("programming.ITERATE", x, k),
        handle_=f("programming.HANDLE_ERROR", x, k), energy_=f("physics.CONSERVE_ENERGY", x), integrate_=f("physics.INTEGRATE_MOTION", x, k), trajectory_=f("physics.COMPUTE_TRAJECTORY", x, k, o), collision_=f("physics.DETECT_COLLISION", x, k),
        resolve_=f("physics.RESOLVE_COLLISION", x, k), field_=f("physics.APPLY_FIELD_EFFECT", x, k), break_=f("biology.BREAK_DOWN", x), build_=f("biology.BUILD_UP", x), transport_=f("biology.TRANSPORT", x, k, o), signal_=f("biology.SEND_SIGNAL", x, k, o),
        received_=f("biology.RECEIVE_SIGNAL", x, k), level_=f("biology.MEASURE_LEVEL", x), return_=f("finance.CALCULATE_RETURN", x, k), risk_=f("finance.EVALUATE_RISK", x), add_asset=f("finance.ADD_ASSET", x, k), remove_asset=f("finance.REMOVE_ASSET", x, k),
        value_=f("finance.COMPUTE_PORTFOLIO_VALUE", x), check_=f("legal.CHECK_CONDITION", x, k), interpret_=f("legal.INTERPRET_CLAUSE", x, k),
    )


@query(
    """SELECT c_custkey, to_json({'type': s, 'value': k})::VARCHAR AS create_, to_json({'deleted': s})::VARCHAR AS delete_, to_json({'entity': s, 'class': k})::VARCHAR AS classify_, CASE WHEN c_custkey % 2 = 0 THEN to_json({'valid': true, 'entity': s})::VARCHAR ELSE to_json({'valid': false, 'entity': s, 'constraint': false})::VARCHAR END AS validate_,
  to_json({'connected': [s, n]})::VARCHAR AS connect_, to_json({'disconnected': [s, n]})::VARCHAR AS disconnect_, to_json({'value': s, 'as': n})::VARCHAR AS convert_, to_json({'observed': s})::VARCHAR AS observe_, to_json({'name': s, 'value': k})::VARCHAR AS variable_,
  to_json({'assigned': s, 'value': k})::VARCHAR AS assign_, to_json({'fn': s, 'params': n, 'body': k})::VARCHAR AS function_, to_json({'return': s})::VARCHAR AS return_, to_json({'error': s, 'message': n})::VARCHAR AS raise_, to_json({'fn': s, 'params': n, 'expr': k})::VARCHAR AS math_function_,
  to_json({'system': s, 'force': n})::VARCHAR AS force_, to_json({'process': 'cell_division', 'parent': s})::VARCHAR AS divide_, to_json({'activated': s})::VARCHAR AS activate_, to_json({'inhibited': s})::VARCHAR AS inhibit_,
  to_json({'process': 'photosynthesis', 'inputs': s, 'outputs': {'glucose': 1, 'oxygen': 6}})::VARCHAR AS photosynthesis_, to_json({'process': 'cell_respiration', 'inputs': s, 'outputs': {'ATP': 'energy', 'CO2': 6, 'H2O': 6}})::VARCHAR AS respiration_,
  to_json({'process': 'protein_synthesis', 'from': s, 'steps': ['DNA→RNA', 'RNA→Protein']})::VARCHAR AS protein_, to_json({'from': s, 'to': n, 'amount': k})::VARCHAR AS transfer_, to_json({'account': s, 'after_txn': n})::VARCHAR AS update_, to_json({'invested': k, 'in': s})::VARCHAR AS invest_,
  to_json({'state': s, 'time_advanced': k})::VARCHAR AS advance_, to_json({'rule': s, 'case': n, 'applied': true})::VARCHAR AS rule_, to_json({'actor': s, 'obligation': n})::VARCHAR AS obligation_, to_json({'actor': s, 'permitted': n, 'status': 'check_required'})::VARCHAR AS permission_,
  to_json({'actor': s, 'prohibited': n})::VARCHAR AS prohibition_, to_json({'violation': true, 'rule': s, 'case': n})::VARCHAR AS violation_, to_json({'conflict_between': [s, n], 'resolution': 'pending'})::VARCHAR AS conflict_, to_json({'base_rule': s, 'exception': n})::VARCHAR AS exception_,
  to_json({'higher': s, 'lower': n})::VARCHAR AS precedence_, to_json({'case': s, 'classification': 'requires_analysis'})::VARCHAR AS case_, to_json({'compliant': 'requires_evaluation', 'case': s, 'against': n})::VARCHAR AS compliance_
FROM (SELECT c_custkey, c_mktsegment AS s, 'n' || c_nationkey AS n, c_nationkey::INT AS k FROM customer)"""
)
def record_operators(spark, d):
    s, n, k = F.col("c_mktsegment"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.col("c_nationkey").cast("int")
    f = lambda name, *o: F.to_json(typed.apply(name, *o))
    return _columns(
        _t(spark, d, "customer"), "c_custkey", create_=f("core.CREATE", s, k), delete_=f("core.DELETE", s), classify_=f("core.CLASSIFY", s, k), validate_=f("core.VALIDATE", s, F.col("c_custkey") % 2 == 0), connect_=f("core.CONNECT", s, n), disconnect_=f("core.DISCONNECT", s, n),
        convert_=f("core.CONVERT", s, n), observe_=f("core.OBSERVE", s), variable_=f("programming.DEFINE_VARIABLE", s, k), assign_=f("programming.ASSIGN", s, k), function_=f("programming.DEFINE_FUNCTION", s, n, k), return_=f("programming.RETURN_VALUE", s), raise_=f("programming.RAISE_ERROR", s, n),
        math_function_=f("math.DEFINE_FUNCTION", s, n, k), force_=f("physics.APPLY_FORCE", s, n), divide_=f("biology.DIVIDE_CELL", s), activate_=f("biology.ACTIVATE", s), inhibit_=f("biology.INHIBIT", s), photosynthesis_=f("biology.PHOTOSYNTHESIS", s), respiration_=f("biology.CELL_RESPIRATION", s),
        protein_=f("biology.PROTEIN_SYNTHESIS", s), transfer_=f("finance.TRANSFER", s, n, k), update_=f("finance.UPDATE_BALANCE", s, n), invest_=f("finance.INVEST", s, k), advance_=f("finance.ADVANCE_TIME", s, k), rule_=f("legal.APPLY_RULE", s, n), obligation_=f("legal.EVALUATE_OBLIGATION", s, n),
        permission_=f("legal.CHECK_PERMISSION", s, n), prohibition_=f("legal.CHECK_PROHIBITION", s, n), violation_=f("legal.DETECT_VIOLATION", s, n), conflict_=f("legal.RESOLVE_CONFLICT", s, n), exception_=f("legal.APPLY_EXCEPTION", s, n), precedence_=f("legal.ESTABLISH_PRECEDENCE", s, n),
        case_=f("legal.CLASSIFY_CASE", s), compliance_=f("legal.VALIDATE_COMPLIANCE", s, n),
    )


@query(
    """SELECT o_orderkey, list_contains(xs, 5) AS contain_, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS lookup_, CASE WHEN k = 0 THEN 'yes' ELSE 'no' END AS select_, array_to_string(list_sort(xs), ',') AS sort_, 3 AS count_, k = 5 AS compare_, o_orderpriority AS define_,
  'F=' || CASE WHEN k = 1 THEN 'new' ELSE 'done' END || ',O=open' AS merge_, xs[k % 3 + 1] AS index_, xs[3] AS last_, array_to_string(list_append(xs, 9), ',') AS append_, array_to_string(list_filter(xs, lambda x: x <> 5), ',') AS remove_, CASE WHEN o_orderstatus = 'P' THEN 'part' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS set_key_,
  o_totalprice AS measure_, 'USD' AS unit_, array_to_string(list_sort(list_distinct(list_filter([k, 5], lambda x: list_contains(xs, x)))), ',') AS intersection_, o_totalprice * pow(1 + 0.1, 2.0) AS compound_
FROM (SELECT *, (o_orderkey % 7)::INT AS k, [(o_orderkey % 7)::INT, 5, (o_custkey % 4)::INT] AS xs FROM orders)"""
)
def collection_typed_operators(spark, d):
    f, k = typed.apply, (F.col("o_orderkey") % 7).cast("int")
    xs, states = F.array(k, F.lit(5), (F.col("o_custkey") % 4).cast("int")), F.create_map(F.lit("F"), F.lit("done"), F.lit("O"), F.lit("open"))
    told = lambda m: F.array_join(F.transform(F.sort_array(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    set_key = f("programming.SET_KEY", states, F.lit("P"), F.lit("part"))
    quantity = F.struct(F.col("o_totalprice").alias("value"), F.lit("EUR").alias("unit"))
    return _columns(
        _t(spark, d, "orders"), "o_orderkey", contain_=f("core.CONTAIN", xs, F.lit(5)), lookup_=f("core.LOOKUP", F.col("o_orderstatus"), states), select_=f("core.SELECT", k == 0, F.lit("yes"), F.lit("no")), sort_=text(f("core.SORT", xs)), count_=f("core.COUNT", xs), compare_=f("core.COMPARE", k, F.lit(5)),
        define_=f("core.DEFINE", F.col("o_orderpriority")), merge_=told(f("core.MERGE", states, F.when(k == 1, F.create_map(F.lit("F"), F.lit("new"))).otherwise(F.create_map(F.lit("F"), F.lit("done"))))), index_=f("programming.INDEX", xs, k % 3), last_=f("programming.INDEX", xs, F.lit(-1)),
        append_=text(f("programming.APPEND", xs, F.lit(9))), remove_=text(f("programming.REMOVE", xs, F.lit(5))), set_key_=f("programming.LOOKUP_KEY", set_key, F.col("o_orderstatus")), measure_=f("physics.MEASURE", quantity), unit_=f("physics.CONVERT_UNITS", quantity, F.lit("USD"))["unit"],
        intersection_=text(F.sort_array(f("math.INTERSECTION", F.array(k, F.lit(5)), xs))), compound_=f("finance.COMPUTE_COMPOUND_INTEREST", F.col("o_totalprice"), F.lit(0.1), F.lit(2.0), F.lit(12)),
    )


@query(
    """SELECT c_custkey AS account, round(c_acctbal + coalesce(sum(CASE o_orderstatus WHEN 'F' THEN o_totalprice WHEN 'O' THEN -o_totalprice ELSE 0 END), 0), 2) AS balance, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal"""
)
def ledger_balances(spark, d):
    kind = F.when(F.col("o_orderstatus") == "F", "deposit").when(F.col("o_orderstatus") == "O", "fee_debit").otherwise("transfer")
    moved = _t(spark, d, "orders").select(F.col("o_custkey").alias("account"), kind.alias("type"), F.col("o_totalprice").alias("amount"))
    out = domains.balances(_t(spark, d, "customer").select(F.col("c_custkey").alias("account"), F.col("c_acctbal").alias("balance")), moved)
    return out.withColumn("balance", F.round("balance", 2))


@query(
    """WITH r AS (SELECT 'r' || p_partkey AS name, (p_partkey % 7)::INT AS rank, 1 + (p_partkey % 3) AS n, 'a' || p_partkey % 400 AS yes, 'a' || (p_partkey * 7 + 3) % 400 AS no FROM part),
p AS (SELECT DISTINCT least(x.name, y.name) AS a, greatest(x.name, y.name) AS b FROM r x JOIN r y ON x.no = y.yes AND x.name <> y.name),
q AS (SELECT a, b, CASE WHEN x.rank >= 5 THEN 999 ELSE x.rank END AS ra, CASE WHEN y.rank >= 5 THEN 999 ELSE y.rank END AS rb, x.n AS na, y.n AS nb FROM p JOIN r x ON a = x.name JOIN r y ON b = y.name)
SELECT a, b, CASE WHEN ra <> rb THEN 'precedence' WHEN na <> nb THEN 'specificity' ELSE 'unresolved' END AS method, CASE WHEN ra < rb THEN a WHEN rb < ra THEN b WHEN na > nb THEN a WHEN nb > na THEN b END AS winner FROM q"""
)
def rule_contradictions(spark, d):
    k = F.col("p_partkey")
    levels = F.array(*map(F.lit, [*typed.RULE_LEVELS, "custom", "none"]))
    act = lambda c: F.concat(F.lit("a"), c.cast("string"))
    rules = _t(spark, d, "part").select(act(k).alias("_"), F.concat(F.lit("r"), k.cast("string")).alias("name"), F.element_at(levels, (k % 7 + 1).cast("int")).alias("level"), F.array_repeat(F.lit("if"), (k % 3).cast("int")).alias("conditions"), F.array(act(k % 400)).alias("obligations"), F.array(act((k * 7 + 3) % 400)).alias("prohibitions"))
    rules = rules.drop("_").withColumn("conditions", F.when(F.size("conditions") > 0, F.slice("conditions", 1, F.size("conditions"))).otherwise(F.col("conditions")))
    return domains.contradictions(rules)


@query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'very_high' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'very_low' END AS risk, round(p_retailprice / 1000 - CASE p_partkey % 5 WHEN 0 THEN 0.2 WHEN 1 THEN 0.01 WHEN 2 THEN 0.05 WHEN 3 THEN 0.1 ELSE 0.0 END, 9) AS adjusted,
  round(p_retailprice * pow(1 + 0.12 / 4, 4 * 2.0), 6) AS compounded, round(p_retailprice * pow(1.05, 3), 6) AS advanced, round(p_retailprice * 0.05 * 2.0, 6) AS simple, true AS same FROM part"""
)
def asset_risk(spark, d):
    k, p = F.col("p_partkey") % 5, F.col("p_retailprice")
    asset = F.when(k == 0, "Crypto").when(k == 1, "index_fund").when(k == 2, "a painting").when(k == 3, "growth_stock").otherwise("treasury_bill")
    risk = typed.asset_risk(asset)
    return _t(spark, d, "part").select(
        "p_partkey", risk.alias("risk"), F.round(typed.risk_adjusted(p / 1000, risk), 9).alias("adjusted"), F.round(typed.compound_interest(p, F.lit(0.12), F.lit(2.0), F.lit(4)), 6).alias("compounded"),
        F.round(typed.advanced(p, F.lit(0.05), F.lit(3)), 6).alias("advanced"), F.round(typed.simple_interest(p, F.lit(0.05), F.lit(2.0)), 6).alias("simple"), typed.conserved(p, p + 1e-10).alias("same"),
    )


# Semantic chunks and books

_STARTS = "^(?:therefore|however|because|since|thus|hence|moreover|furthermore|in addition|for example|for instance|as a result|consequently|nevertheless|specifically|that is|in other words|so |but |and |or |also |additionally|likewise|nonetheless|instead|otherwise|indeed|in fact|of course|naturally|meaning )"


def _semantic(source: str) -> str:
    return f"""WITH sent AS ({_sentences(source)}), w AS (SELECT *, lower(regexp_split_to_array(text, '\\s+')[1]) AS w1 FROM sent),
m AS (SELECT *, CASE WHEN regexp_matches(lower(text), '^.+?\\s+(is|means|refers to|is defined as|is known as)\\s+') THEN regexp_replace(w1, '^[.,;:!?()]+|[.,;:!?()]+$', '', 'g') END AS subject,
  NOT (regexp_replace(w1, '[.,;:!?()]+$', '') IN ('it', 'its', 'this', 'that', 'these', 'those', 'they', 'their', 'them', 'he', 'his', 'she', 'her', 'we', 'our', 'us', 'such', 'both', 'each', 'which') OR regexp_matches(lower(text), '{_STARTS}') OR ends_with(text, '?')) AS free FROM w),
n AS (SELECT *, coalesce(last_value(CASE WHEN free THEN subject END IGNORE NULLS) OVER p, first_value(subject IGNORE NULLS) OVER p) AS now FROM m WINDOW p AS (PARTITION BY doc_id, para ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, (sum(CASE WHEN pos = 0 OR coalesce(free AND subject <> now, false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY para, pos) - 1)::BIGINT AS grp FROM n),
c AS (SELECT doc_id, para, grp, string_agg(text, ' ' ORDER BY pos) AS text FROM g GROUP BY ALL)
SELECT doc_id, para, grp AS "group", text, 'semantic:para:' || para || ':group:' || grp AS location, 'chunk_' || substr(sha256('doc:' || doc_id || '::semantic::' || grp || '::' || lower({_strip("text")})), 1, 8) AS chunk_id FROM c WHERE length(text) >= 10"""


@query(_semantic("documents"))
def semantic_chunks(spark, d):
    return chunking.semantic_chunks(_docs(spark, d))


@query(f"WITH src AS ({_HEADED}) " + _semantic("src").replace("WITH sent AS", ", sent AS", 1))
def semantic_chunks_star(spark, d):
    return chunking.semantic_chunks(_headed(spark, d))


#: Books of three chapters made from the nations: a glossary, paragraphs under headings, and a short chapter.
_BOOK = """SELECT n_nationkey::BIGINT AS doc_id, concat('front matter
Chapter 1: Terms of ', n_name, '
', n_name, ' is a nation of the atlas.
A port depends on ships and trade.

A harbour is a place for ships.
# Chapter Two
lost line
## Ports
The ports of ', n_name, ' lie on a long coast and need repair.

short
## Trade
Trade in ', n_name, ' goes by sea, by road and over the hills.
SHORT END
one last line of ', n_name, ' that is long enough to be kept.') AS text FROM nation"""


def _book(spark, d):
    x = F.col("n_name")
    body = F.concat(
        F.lit("front matter\nChapter 1: Terms of "), x, F.lit("\n"), x, F.lit(" is a nation of the atlas.\nA port depends on ships and trade.\n\nA harbour is a place for ships.\n# Chapter Two\nlost line\n## Ports\nThe ports of "), x,
        F.lit(" lie on a long coast and need repair.\n\nshort\n## Trade\nTrade in "), x, F.lit(" goes by sea, by road and over the hills.\nSHORT END\none last line of "), x, F.lit(" that is long enough to be kept."),
    )
    return _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), body.alias("text"))


def _chapters(source: str) -> str:
    caps = "len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')) BETWEEN 1 AND 5 AND t = upper(t) AND regexp_matches(t, '^[\\p{L} ]+$')"
    return f"""l AS (SELECT doc_id, line - 1 AS line, text, rtrim(text) AS t FROM ({_LINES.format(source=source)})),
h AS (SELECT *, CASE WHEN regexp_matches(t, '^(Chapter|CHAPTER)\\s+\\S+(\\s*[:.\\-]\\s*.*)?$') THEN t WHEN regexp_matches(t, '(?i)^#{{1,3}}\\s+chapter\\s+') THEN {_strip("regexp_replace(t, '^#{1,3}\\s+', '')")}
  WHEN {caps} THEN array_to_string(list_transform(string_split(lower(t), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS title FROM l),
k AS (SELECT *, count(title) OVER (PARTITION BY doc_id ORDER BY line) AS k, count(title) OVER (PARTITION BY doc_id) AS every FROM h),
g AS (SELECT doc_id, greatest(k - 1, 0) AS chapter, max(title) AS title, min(line)::INT AS start_line, max(line)::INT AS end_line, {_strip("coalesce(string_agg(text, chr(10) ORDER BY line) FILTER (WHERE title IS NULL), '')")} AS text FROM k WHERE k > 0 OR every = 0 GROUP BY doc_id, k),
chapter AS (SELECT g.doc_id, chapter, 'chap_' || substr(sha256(substr(sha256('doc:' || g.doc_id || '::' || octet_length(encode(b.text)) || '::' || b.text[:1000]), 1, 16) || '::chapter::' || chapter || '::' || coalesce(title, '')), 1, 12) AS chapter_id, title, start_line, end_line, g.text FROM g JOIN {source} b ON b.doc_id = g.doc_id)"""


@query(f"WITH {_chapters('documents')} SELECT * FROM chapter")
def book_chapters(spark, d):
    return chunking.chapters(_docs(spark, d))


@query(f"WITH src AS ({_BOOK}), {_chapters('src')} SELECT * FROM chapter")
def book_chapters_star(spark, d):
    return chunking.chapters(_book(spark, d))


def _book_chunk_rows(books: str) -> str:
    """CTEs from the chapters of a table of books to book_chunk."""
    return f"""{_chapters(books)}, cl AS (SELECT doc_id, chapter_id, unnest(range(0, len(x))) AS position, unnest(x) AS raw FROM (SELECT *, string_split(text, chr(10)) AS x FROM chapter)), ct AS (SELECT *, {_strip("raw")} AS t FROM cl),
gl AS (SELECT chapter_id FROM ct WHERE t <> '' GROUP BY chapter_id HAVING count(*) FILTER ({_IS_LINE.format(x="t")}) >= 3 AND count(*) FILTER ({_IS_LINE.format(x="t")}) * 2 >= count(*) AND avg(length(t)) <= 120 AND count(*) FILTER (regexp_matches(t, '(?i)^.{{1,60}} (is|depends on) ')) >= 2),
src AS (SELECT chapter_id AS doc_id, text FROM chapter WHERE chapter_id NOT IN (SELECT chapter_id FROM gl)), {_ALL_SECTIONS.replace("h AS (", "sh AS (").replace("FROM h)", "FROM sh)").replace("s AS (SELECT *, count", "ss AS (SELECT *, count").replace("FROM s WHERE k", "FROM ss WHERE k").replace(" g AS (", " sg AS (").replace("\ng AS (", "\nsg AS (").replace("FROM g)", "FROM sg)")},
pp AS (SELECT doc_id AS chapter_id, section_id, unnest(range(0, len(x))) AS para, unnest(x) AS raw FROM (SELECT *, string_split(text, chr(10) || chr(10)) AS x FROM sec)), pq AS (SELECT chapter_id, para, {_strip("raw")} AS text, 'section:' || section_id || ':para:' || para AS location FROM pp),
book_chunk AS (SELECT doc_id, chapter_id, 'glossary' AS mode, position::INT AS position, t AS text, 'chapter:' || chapter_id || ':line:' || position AS location, 'chunk_' || substr(sha256('doc:' || doc_id || '::book_glossary::' || position || '::' || lower(t)), 1, 8) AS chunk_id
FROM ct WHERE chapter_id IN (SELECT chapter_id FROM gl) AND {_IS_LINE.format(x="t")}
UNION ALL SELECT c.doc_id, chapter_id, 'paragraph', para::INT, pq.text, location, 'chunk_' || substr(sha256('doc:' || c.doc_id || '::document_structured::' || location || '::' || lower(pq.text)), 1, 8) FROM pq JOIN chapter c USING (chapter_id) WHERE length(pq.text) >= 40)"""


@query(f"WITH books AS ({_BOOK}), {_book_chunk_rows('books')} SELECT * FROM book_chunk")
def book_chunks(spark, d):
    return chunking.book_chunks(_book(spark, d))


@query(f"WITH {_book_chunk_rows('documents')} SELECT * FROM book_chunk")
def book_chunks_documents(spark, d):
    return chunking.book_chunks(_docs(spark, d))


# Graph maintenance, definitions and datasets


@query(
    """WITH old AS (SELECT 'c' || o_custkey AS src, 's' || o_orderstatus AS dst, 'has' AS relation, 0.75::DOUBLE AS salience, min(o_orderkey) AS step, 't' || o_custkey % 3 AS id FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL),
new AS (SELECT 'c' || o_custkey AS src, 's' || o_orderstatus AS dst, 'has' AS relation, 0.5::DOUBLE AS salience, min(o_orderkey) AS step, 't' || o_custkey % 3 AS id FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL
  UNION ALL SELECT 'c' || o_custkey, 's' || o_orderstatus, 'has', 0.5, min(o_orderkey), 'u' || o_custkey % 5 FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 2 = 1 GROUP BY ALL),
one AS (SELECT src, dst, relation, id, arg_min(step, k * 1000000000000 + step) AS step, min(k) AS k, arg_min(salience, k) AS salience FROM (SELECT *, 0 AS k FROM old UNION ALL SELECT *, 1 FROM new) GROUP BY ALL)
SELECT src, dst, relation, arg_min(salience, k) AS salience, min(k) = 1 AS is_new, count(*) AS n_traces, arg_min(id, struct_pack(step := step, id := id)) AS first_trace FROM one GROUP BY src, dst, relation"""
)
def graph_insert(spark, d):
    k = F.col("o_orderkey")
    own = lambda rows, salience, *ids: rows.groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderkey").alias("step"), F.min(F.when(k % 3 == 1, k)).alias("more")).select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("s"), "o_orderstatus").alias("dst"), F.lit("has").alias("relation"), F.lit(salience).alias("salience"),
        F.map_from_entries(F.filter(F.array(F.struct(F.concat(F.lit("t"), (F.col("o_custkey") % 3).cast("string")).alias("id"), "step"), *ids), lambda e: e["step"].isNotNull())).alias("trace_ids"),
    )
    orders = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    second = F.struct(F.concat(F.lit("u"), (F.col("o_custkey") % 5).cast("string")).alias("id"), F.col("more").alias("step"))
    return graph.insert_edges(own(orders.filter(k % 2 == 0), 0.75), own(orders.filter(k % 2 == 1), 0.5, second))


@query(
    """WITH said AS (SELECT n_name AS term, 'region ' || r_name AS definition, 'atlas' AS source_id, 0.8::DOUBLE AS confidence, n_nationkey AS step FROM nation JOIN region ON n_regionkey = r_regionkey),
node AS (SELECT 'd' || c_custkey AS id, n_name AS term, 'home of ' || c_custkey AS definition, (c_custkey % 10) / 10.0::DOUBLE AS confidence, 1.0::DOUBLE AS salience, c_custkey AS step, c_custkey % 3 AS p FROM customer JOIN nation ON c_nationkey = n_nationkey),
cand AS (SELECT lower(term) AS k, definition, confidence, 1.0 AS salience, step, NULL AS id, 0 AS p FROM said UNION ALL SELECT lower(term), definition, confidence, salience, step, id, p FROM node),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY confidence DESC, salience DESC, step DESC, coalesce(id, '')) AS rn, count(*) OVER (PARTITION BY k) AS n, sum(p) OVER (PARTITION BY k) AS total FROM cand), asked AS (SELECT n_name || '!' AS term FROM nation UNION SELECT 'no ' || r_name FROM region)
SELECT term, k IS NOT NULL AS hit, definition, id AS node_id, coalesce(confidence, 0.0) AS confidence, coalesce(n, 0) AS n_candidates, coalesce(total, 0)::BIGINT AS n_provenance FROM asked LEFT JOIN (SELECT * FROM r WHERE rn = 1) ON k = lower(replace(term, '!', ''))"""
)
def definition_ranking(spark, d):
    nation, region = _t(spark, d, "nation"), _t(spark, d, "region")
    once = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("term"), F.concat(F.lit("region "), "r_name").alias("definition"), F.lit("atlas").alias("source_id"), F.lit(0.8).alias("confidence"), F.col("n_nationkey").cast("long").alias("step"), F.col("n_nationkey").cast("long").alias("seq"))
    again = once.select(F.upper("term").alias("term"), F.lit("later").alias("definition"), "source_id", F.lit(0.9).alias("confidence"), "step", (F.col("seq") + 100).alias("seq"))
    registered = graph_queries.registered_definitions(once.unionByName(again)).withColumn("node_id", F.lit(None).cast("string"))
    k = F.col("c_custkey")
    nodes = _t(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    nodes = nodes.select(F.concat(F.lit("d"), k.cast("string")).alias("id"), F.col("n_name").alias("term"), F.concat(F.lit("home of "), k.cast("string")).alias("definition"), ((k % 10) / 10.0).alias("confidence"), F.lit(1.0).alias("salience"), k.cast("long").alias("step"), (k % 3).cast("long").alias("n_provenance"))
    asked = nation.select(F.concat("n_name", F.lit("!")).alias("term")).unionByName(region.select(F.concat(F.lit("no "), "r_name").alias("term")))
    return graph_queries.ranked_definitions(asked, registered, nodes)


@query(
    """SELECT o_orderkey, '[source: ' || CASE WHEN o_orderkey % 3 = 0 THEN 'o' || o_orderkey || '.txt' ELSE 'order:' || o_orderkey END || CASE WHEN o_orderkey % 2 = 0 THEN ' | chunk: c' || o_orderkey ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN ' | loc: line:' || o_orderkey ELSE '' END || ' | conf: ' || printf('%.2f', (o_orderkey % 100) / 100.0::DOUBLE) || ']' AS line,
  array_to_string(list_filter([CASE WHEN o_orderkey % 4 = 0 THEN 'source_id' END, CASE WHEN o_orderkey % 5 = 1 THEN 'source_type' END, CASE WHEN o_orderkey % 10 = 7 THEN 'confidence' END], lambda x: x IS NOT NULL), ',') AS faults,
  CASE WHEN o_orderkey % 3 = 1 THEN 'conflict' WHEN o_orderkey % 2 = 0 THEN 'known' ELSE 'merged' END AS outcome FROM orders"""
)
def provenance_checks(spark, d):
    k = F.col("o_orderkey")
    s = lambda prefix, suffix="": F.concat(F.lit(prefix), k.cast("string"), F.lit(suffix))
    conf = (k % 100) / 100.0
    line = graph_queries.provenance_line(F.when(k % 3 == 0, s("/a/b/o", ".txt")), s("order:"), F.when(k % 2 == 0, s("c")), F.when(k % 5 == 0, s("line:")), conf)
    faults = graph.provenance_faults(F.when(k % 4 != 0, s("order:")), F.when(k % 5 == 1, "rumour").otherwise("document"), F.lit("m"), F.when(k % 10 == 7, F.lit(1.5)).otherwise(conf), s("t"), k)
    outcome = graph.merge_outcome(F.lit("x"), F.array(F.lit("t0")), F.when(k % 3 == 1, "y").otherwise("x"), F.when(k % 2 == 0, "t0").otherwise("t1"))
    return _t(spark, d, "orders").select("o_orderkey", line.alias("line"), F.array_join(faults, ",").alias("faults"), outcome.alias("outcome"))


@query(
    """WITH v AS (SELECT 'set' || c_nationkey AS name, 'v' || c_custkey % 3 AS version, CASE WHEN c_nationkey % 4 = 0 THEN c_mktsegment ELSE 'same' END AS content, c_custkey AS seq FROM customer), p AS (SELECT name, version, arg_min(content, seq) AS content, min(seq) AS first, count(DISTINCT content) > 1 AS conflict FROM v GROUP BY ALL)
SELECT name, version, content, first = max(first) OVER (PARTITION BY name) AS is_latest, conflict FROM p"""
)
def dataset_registry(spark, d):
    c = _t(spark, d, "customer")
    return graph_queries.registry(c.select(F.concat(F.lit("set"), F.col("c_nationkey").cast("string")).alias("name"), F.concat(F.lit("v"), (F.col("c_custkey") % 3).cast("string")).alias("version"), F.when(F.col("c_nationkey") % 4 == 0, F.col("c_mktsegment")).otherwise("same").alias("content"), F.col("c_custkey").alias("seq")))


@query(
    f"""WITH {_ASKED} SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'version must be non-empty' END, CASE WHEN c_custkey % 3 = 0 THEN 'records must be a dict' END, CASE WHEN c_custkey % 5 = 0 THEN 'value_type is not a valid SemanticType' END], lambda x: x IS NOT NULL), '; ') AS faults,
  (SELECT count(*) FROM asked WHERE lower(trim(key)) IN (SELECT lower(trim(n_name)) FROM nation)) AS n_known FROM customer"""
)
def dataset_checks(spark, d):
    k = F.col("c_custkey")
    faults = graph_queries.dataset_faults(F.col("c_mktsegment"), F.when(k % 2 == 0, "").otherwise("1"), F.lit("atlas"), F.when(k % 3 == 0, "[1]").otherwise('{"a": 1}'), F.lit("Entity"), F.when(k % 5 == 0, "Thing").otherwise("Entity"))
    known = graph_queries.contains(_asked(spark, d), _t(spark, d, "nation").select(F.col("n_name").alias("key"))).agg(F.count(F.lit(1)).alias("n_known"))
    return _t(spark, d, "customer").select("c_custkey", F.array_join(faults, "; ").alias("faults")).crossJoin(F.broadcast(known))  # one row


@query(
    """WITH RECURSIVE b AS (SELECT date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) + 1 AS step, event_id AS graph, 'u' || user_id AS leaf, event_type AS root FROM events),
said AS (SELECT step, graph, root AS node, true AS is_root FROM b UNION ALL SELECT step, graph, leaf, false FROM b), nth AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY step, graph, is_root DESC) AS i FROM said),
e AS (SELECT node, step, sum(CASE WHEN i = 1 THEN CASE WHEN is_root THEN 1.0 ELSE 0.8 END WHEN is_root THEN 0.5 ELSE 0.25 END)::DOUBLE AS amount, count(*) AS c FROM nth GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY step) AS i FROM e), last AS (SELECT max(step) AS last FROM e),
f AS (SELECT node, i, step, greatest(0.01, amount * 0.95)::DOUBLE AS s FROM k WHERE i = 1 UNION ALL SELECT k.node, k.i, k.step, greatest(0.01, (greatest(0.01, f.s * pow(0.95, k.step - f.step - 1)) + k.amount) * 0.95)::DOUBLE FROM f JOIN k ON k.node = f.node AND k.i = f.i + 1)
SELECT node, round(greatest(0.01, arg_max(s, i) * pow(0.95, (SELECT last FROM last) - max(step))), 9) AS salience, (SELECT sum(c) FROM e WHERE e.node = f.node)::BIGINT AS n FROM f GROUP BY node"""
)
def execution_import(spark, d):
    ev = _t(spark, d, "events")
    span = ev.agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b")).first()
    step = (F.datediff(F.to_date("ts"), F.lit(span["a"])) + 1).cast("long")
    rows = ev.select(step.alias("step"), F.col("event_id").alias("graph"), F.explode(F.array(F.struct(F.col("event_type").alias("node"), F.lit("State").alias("type"), F.lit(True).alias("is_root")), F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("node"), F.lit("Entity").alias("type"), F.lit(False).alias("is_root")), F.struct(F.lit("k").alias("node"), F.lit("Constraint").alias("type"), F.lit(False).alias("is_root")))).alias("x"))
    return graph.imported(rows.select("step", "graph", "x.node", "x.type", "x.is_root"), (span["b"] - span["a"]).days + 1)


# Adaptation


@query("SELECT signature, count(*) AS frequency, 1 - 1 / count(*)::DOUBLE AS ratio FROM (SELECT l_returnflag || l_linestatus || l_quantity::INT AS signature FROM lineitem) GROUP BY signature HAVING count(*) >= 3")
def encoding_discovery(spark, d):
    return adaptation.frequent_encodings(_t(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").cast("string")).alias("signature")))


@query("SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'deterministic' END, CASE WHEN o_orderkey % 3 = 0 THEN 'lossless_unless_declared' END, CASE WHEN o_orderkey % 5 = 0 THEN 'improves_cost' END, CASE WHEN o_orderkey % 7 = 0 THEN 'versioned' END, CASE WHEN o_orderkey % 11 = 0 THEN 'passes_benchmarks' END], lambda x: x IS NOT NULL), ',') AS faults FROM orders")
def candidate_checks(spark, d):
    k = F.col("o_orderkey")
    return _t(spark, d, "orders").select("o_orderkey", F.array_join(adaptation.candidate_faults(k % 2 != 0, k % 3 != 0, k % 5 != 0, F.when(k % 7 != 0, "1.0"), k % 11 != 0), ",").alias("faults"))


@query(
    """WITH m AS (SELECT *, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS new FROM events)
SELECT user_id AS trace, string_agg(event_type, ' → ' ORDER BY event_id) FILTER (new) AS stages, (SELECT string_agg(event_type || '=' || v, ',' ORDER BY event_type) FROM (SELECT event_type, arg_max(event_id, event_id) AS v FROM events e WHERE e.user_id = m.user_id GROUP BY event_type)) AS last_of FROM m GROUP BY user_id"""
)
def replay_traces(spark, d):
    ev = _t(spark, d, "events").select(F.col("user_id").alias("trace"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), F.col("event_id").cast("string").alias("payload"))
    return adaptation.replayed(ev).withColumn("last_of", F.array_join(F.transform(F.map_entries("last_of"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","))


# Routing of all rules, slots, tags and typed values

#: A question for each slot and most rules, with its expected rule; {} is a nation. Written out by hand.
_MORE_ASKS = (
    ("Calculate acceleration from force {} and mass 2 kg", "physics.compute_acceleration"), ("velocity after 5 s for {}", "physics.update_velocity"), ("withdraw 20 from {}", "fin.withdraw"), ("compound interest on 1000 at 5 rate 7 {}", "fin.compound_interest"), ("Is {} allowed under law 7", "legal.check_permission.allowed"),
    ("May {} act if it is illegal and must stop", "legal.check_prohibition.illegal"), ("differentiate {} with respect to x", "math.derive"), ("level of {}", "bio.measure_level"), ("find first odd in {}", "prog.find_first"), ("define {}", "discourse.def.define"), ("what influences {}", "para.rel.what_influences"),
    ("full dependencies of {}", "para.mh.full_dependencies"), ("population of {}", "geo.population_of"), ("compliant compliance of case {}", "legal.validate_compliance"), ("collision of {} and Peru", "physics.detect_collision"), ("apply rule {}", "legal.apply_rule"), ("xyzzy {}", None),
)


def _more_questions(spark, d):
    n = _t(spark, d, "nation").select("n_nationkey", F.initcap(F.lower("n_name")).alias("x"))
    rows = F.array(*[F.struct(F.lit(i).alias("ask"), F.concat(F.lit(q.split("{}")[0]), F.col("x"), F.lit(q.split("{}")[1])).alias("text")) for i, (q, _) in enumerate(_MORE_ASKS)])
    return n.select("n_nationkey", F.explode(rows).alias("q")).select("n_nationkey", "q.ask", "q.text")


_MORE_QUESTIONS = "asks AS (SELECT n_nationkey, ask::INT AS ask, replace(q, '{}', array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ')) AS text, rule FROM nation, (VALUES " + ", ".join(f"({i}, '{q}', {'NULL' if r is None else repr(r)})" for i, (q, r) in enumerate(_MORE_ASKS)) + ") v(ask, q, rule))"
_X = "array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


@query(
    f"""WITH {_MORE_QUESTIONS}, x AS (SELECT n_nationkey, {_X} AS x FROM nation)
SELECT n_nationkey, ask, rule, CASE WHEN rule IS NULL THEN 0.0 ELSE round(1.3 + CASE ask WHEN 0 THEN 0.110 WHEN 1 THEN 0.085 WHEN 2 THEN 0.1 WHEN 3 THEN 0.11 WHEN 4 THEN 0.1 WHEN 5 THEN 0.105 WHEN 6 THEN 0.095 WHEN 7 THEN 0.085 WHEN 8 THEN 0.105 WHEN 9 THEN 0.2 WHEN 10 THEN 0.19 WHEN 11 THEN 0.195 WHEN 12 THEN 0.09 WHEN 13 THEN 0.1 WHEN 14 THEN 0.09 WHEN 15 THEN 0.09 END, 6) END::DOUBLE AS confidence,
  CASE WHEN ask = 0 THEN x END AS force, CASE WHEN ask = 0 THEN '2 kg' END AS mass, CASE ask WHEN 1 THEN '5 s for ' || x END AS time, CASE WHEN ask = 8 THEN 'odd' END AS predicate, CASE WHEN ask = 8 THEN x END AS collection,
  CASE ask WHEN 2 THEN x WHEN 0 THEN 'force ' || x || ' and mass 2 kg' END AS account, CASE ask WHEN 2 THEN '20' WHEN 0 THEN '2' WHEN 1 THEN '5' WHEN 3 THEN '1000' WHEN 4 THEN '7' END AS amount, CASE WHEN ask = 3 THEN '7' END AS rate,
  CASE WHEN ask = 4 THEN '7' WHEN ask = 15 THEN x END AS rule_slot, CASE WHEN ask = 5 THEN x || ' act if it is illegal and must stop' END AS action, '3' AS max_depth FROM asks JOIN x USING (n_nationkey)"""
)
def route_slots(spark, d):
    out = routing.route(_more_questions(spark, d), more=True)
    slot = lambda name: F.col(f"slot_{name}")
    return out.select("n_nationkey", "ask", "rule", F.round("confidence", 6).alias("confidence"), slot("force").alias("force"), slot("mass").alias("mass"), slot("time").alias("time"), slot("predicate").alias("predicate"), slot("collection").alias("collection"), slot("account").alias("account"), "amount", slot("rate").alias("rate"), slot("rule").alias("rule_slot"), slot("action").alias("action"), slot("max_depth").alias("max_depth"))


@query(
    """WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '[\\p{L}\\p{N}_]+(?:''[\\p{L}\\p{N}_]+)?|[^\\p{L}\\p{N}_\\s]') AS t FROM conversations),
k AS (SELECT conv_id, turn, list_transform(t, lambda x: CASE WHEN regexp_matches(x, '^([0-9][0-9_]*)$') OR lower(x) IN ('inf', 'infinity', 'nan') THEN 'N' WHEN regexp_matches(replace(x, chr(39), ''), '^\\p{L}+$') THEN 'W' WHEN x IN ('.', ',', ':', ';', '!', '?', '(', ')', '[', ']', '{', '}', '"', chr(39), '-') THEN 'P' ELSE 'S' END) AS k FROM t)
SELECT conv_id, turn, len(list_filter(k, lambda x: x = 'W'))::INT AS words, len(list_filter(k, lambda x: x = 'P'))::INT AS punct, len(k)::INT AS n FROM k"""
)
def lexer_tags(spark, d):
    tags = routing.tagged(F.regexp_extract_all("text", F.lit(routing.TOKEN), F.lit(0)))
    n = lambda kind: F.size(F.filter("k", lambda x: x == kind))
    return _t(spark, d, "conversations").withColumn("k", tags).select("conv_id", "turn", n("WORD").alias("words"), n("PUNCT").alias("punct"), F.size("k").alias("n"))


@query(
    """SELECT p_partkey, 'quantity' AS force_kind, p_size::DOUBLE AS force_number, 'm/s²' AS force_unit, 'constraint' AS rate_kind, p_size / 100.0::DOUBLE AS rate_number, 'number' AS amount_kind, 1000.0 * p_size AS amount_number, 'list' AS list_kind, p_size || '|x' AS items, 'text' AS text_kind, 'unknown' AS bare_unit FROM part"""
)
def hydrate_slots(spark, d):
    n = F.col("p_size").cast("string")
    h = lambda domain, slot, v: routing.hydrated(F.lit(domain), F.lit(slot), v)
    force, rate, amount = h("physics", "force", F.concat(n, F.lit(" m/s²"))), h("finance", "rate", F.concat(n, F.lit("%"))), h("finance", "amount", F.concat(n, F.lit(",000")))
    items, text, bare = h("programming", "collection", F.concat(F.lit("["), n, F.lit(", 'x']"))), h("math", "expression", F.concat(n, F.lit(" + x"))), h("physics", "mass", n)
    return _t(spark, d, "part").select(
        "p_partkey", force["kind"].alias("force_kind"), force["number"].alias("force_number"), force["unit"].alias("force_unit"), rate["kind"].alias("rate_kind"), rate["number"].alias("rate_number"), amount["kind"].alias("amount_kind"), amount["number"].alias("amount_number"),
        items["kind"].alias("list_kind"), F.array_join(items["items"], "|").alias("items"), text["kind"].alias("text_kind"), bare["unit"].alias("bare_unit"),
    )


@query(
    f"""WITH chunk AS (SELECT doc_id, t AS text FROM (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {_strip("x")}), lambda x: x <> '')) AS t FROM documents) WHERE length(t) >= 40), rel AS ({_relationships("chunk")})
SELECT (SELECT count(*) FROM chunk) AS chunks, (SELECT count(*) FROM ({_definitions("chunk")})) AS definitions, (SELECT count(*) FROM ({_CLAIMS.replace("FROM documents", "FROM chunk")})) AS claims, (SELECT count(*) FROM rel) AS triples, (SELECT count(*) FROM (SELECT DISTINCT src, dst, relation FROM rel)) AS edges"""
)
def ingest_totals(spark, d):
    parts = ingest.ingested(_docs(spark, d))
    totals = None
    for name in ("chunks", "definitions", "claims", "triples", "edges"):
        n = parts[name].agg(F.count(F.lit(1)).alias(name))
        totals = n if totals is None else totals.crossJoin(F.broadcast(n))  # one row each
    return totals
