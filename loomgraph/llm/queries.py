"""One registered query for each operator of this package, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import best_fit, conversation_repair, embedding_dedup, html_text, license_scan, mixing, ngram_join, packing, quality_rules, secret_scan, token_alignment, url_filter, warc
from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_plan(table(spark, sf_dir, "documents"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_documents(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_documents(table(spark, sf_dir, "documents"))


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.best_fit_documents(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damage(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_secret_scan, op2_source_mixing, op3_main_text, op4_embedding_dedup, op5_ngram_join, op6_packing, op7_quality_rules, op8_warc, op9_url_filter, op10_license_scan, op11_token_alignment, op12_best_fit, op13_conversation_repair)
    return {f.__name__: f for f in own}


_COMPONENTS = """, sides AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT id AS a, id AS b FROM ids UNION SELECT r.a, s.b FROM reach r JOIN sides s ON r.b = s.a)"""

def _crc_nibble(n: int) -> int:
    for _ in range(4):
        n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
    return n


#: CRC-32 of the ASCII text k, four bits at a time.
_CRC32 = f"""xor(list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(k) + 1), lambda i: [ascii(substr(k, i, 1)) & 15, ascii(substr(k, i, 1)) >> 4]))),
  lambda c, n: xor({[_crc_nibble(n) for n in range(16)]}[((xor(c, n) & 15) + 1)::INT], c >> 4)), 4294967295)"""

#: Operators that SQL can express; the others are held against brute force in tests/llm.
ORACLE_SQL = {
    "op2_source_mixing": """
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM per),
before AS (SELECT *, coalesce(sum(3 * source_size) OVER p, 0) AS cap_before, coalesce(sum(w) OVER p, 0) AS w_before, sum(source_size) OVER () AS all_size, sum(w) OVER () AS all_w
  FROM weighed WINDOW p AS (ORDER BY 3 * source_size / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, 3 * source_size * (all_w - w_before) <= w * (all_size - cap_before) AS is_full FROM before),
target AS (SELECT source, source_size, CASE WHEN is_full THEN (3 * source_size)::DOUBLE
  ELSE (w * (all_size - coalesce(sum(3 * source_size) FILTER (WHERE is_full) OVER (), 0)))::DOUBLE / (all_w - coalesce(sum(w) FILTER (WHERE is_full) OVER (), 0))::DOUBLE END AS target FROM capped),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS r,
  ('0x' || substr(sha256('mix-1:' || coalesce(source, chr(0) || 'null')), 1, 5))::BIGINT::DOUBLE / 1048576.0 AS u FROM sized)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM (
  SELECT doc_id, size, source_size, target, (floor(u + rate * r) - floor(u + rate * (r - 1)))::BIGINT AS copies
  FROM (SELECT k.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
    FROM ranked k JOIN target t ON k.source IS NOT DISTINCT FROM t.source))""",
    "op4_embedding_dedup": """
WITH RECURSIVE valid AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
ids AS (SELECT id FROM valid),
link AS (SELECT a.id AS a, b.id AS b FROM valid a JOIN valid b ON a.id < b.id AND list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.95)"""
    + _COMPONENTS
    + """, n AS (SELECT a, count(*) AS n_links FROM sides GROUP BY a), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id""",
    "op5_ngram_join": """
WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w),
one AS (SELECT id, len(s) AS n, unnest(s) AS x FROM s),
link AS (SELECT a.id AS a, b.id AS b FROM one a JOIN one b ON a.x = b.x AND a.id < b.id AND a.n * 100 >= 90 * b.n AND b.n * 100 >= 90 * a.n
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
ids AS (SELECT id FROM w)"""
    + _COMPONENTS
    + " SELECT id AS doc_id, len(s)::BIGINT AS n_shingles, min(b) AS component_id FROM s JOIN reach ON a = id GROUP BY id, len(s)",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, octet_length(encode(body))::BIGINT AS n, sha1(body) AS x FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM h)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, (i // 4) * 5 + 1, 5))::BIGINT >> ((3 - i % 4) * 5)) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
    "op9_url_filter": """
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS host FROM r),
u AS (SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(host) + 1), '^([^?#]*)', 1) AS path FROM h),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
won AS (SELECT page_id, arg_max(verdict, length(rhost || rpath)) AS verdict, arg_max(rhost || rpath, length(rhost || rpath)) AS rule
  FROM u JOIN rules ON ends_with('.' || host, '.' || rhost) AND starts_with(path, rpath) GROUP BY page_id),
junk AS (SELECT *, '.' || host || chr(0) || path AS c FROM u)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host LIKE '%spam-%' OR '.' || host LIKE '%.cheap-%' OR host LIKE '%pills%' OR host LIKE '%casino%' OR '.' || host LIKE '%.viagra%'
  OR '.' || host LIKE '%.porn%' OR '.' || host LIKE '%.xxx' OR '.' || host LIKE '%.ads.%' OR '.' || host LIKE '%.adserver.%' OR '.' || host LIKE '%.doubleclick.%'
  OR starts_with(path, '/wp-login.php') OR ends_with(path, '.exe') OR ends_with(path, '.apk') THEN 'block' ELSE 'allow' END) AS verdict
FROM junk LEFT JOIN won USING (page_id)""",
    "op13_conversation_repair": f"""
WITH RECURSIVE named AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hit AS (SELECT c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, ({_CRC32}) % 20 AS d FROM named),
damaged AS (SELECT c, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit JOIN (VALUES (1), (2)) AS copies(n) ON n = 1 OR d = 3 WHERE d <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text)) AS k FROM damaged),
judged AS (SELECT c, k, turn, role, text, CASE WHEN regexp_full_match(text, '[\\x20\\x09-\\x0D]*') THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY k) > 1 THEN 'duplicate'
  WHEN right(regexp_replace(text, '[\\x20\\x09-\\x0D]+$', ''), 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY k) || left(role, 1) AS two FROM placed),
ins(a, b, i, line) AS (VALUES (0, 0, '', ''), (0, 2, 'I', 'user:' || chr(10)), (0, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 1, '', ''), (1, 2, 'I', 'user:' || chr(10)),
  (1, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (2, 2, '', ''), (2, 3, 'I', 'assistant:' || chr(10)), (3, 3, '', ''), (3, 2, 'I', 'user:' || chr(10))),
edits(b, z, e, price, initial, as_role) AS (VALUES (0, 1, 'K', 0, 's', NULL), (0, 2, 'K', 0, 'u', NULL), (1, 2, 'K', 0, 'u', NULL), (2, 3, 'K', 0, 'a', NULL), (3, 2, 'K', 0, 'u', NULL),
  (0, 2, 'R', 2, NULL, 'user'), (1, 2, 'R', 2, NULL, 'user'), (2, 3, 'R', 2, NULL, 'assistant'), (3, 2, 'R', 2, NULL, 'user'), (0, 0, 'D', 3, NULL, NULL), (1, 1, 'D', 3, NULL, NULL), (2, 2, 'D', 3, NULL, NULL), (3, 3, 'D', 3, NULL, NULL)),
ways AS (SELECT DISTINCT c, 0::BIGINT AS k, 0 AS z, {{'cost': 0::BIGINT, 'audit': '', 'said': ''}} AS w FROM named
  UNION ALL SELECT c, k, z, min(w) FROM (
    SELECT v.c, j.k, e.z, {{'cost': v.w.cost + 2 * length(i.i) + e.price + CASE WHEN j.fault = 'truncated' AND e.e <> 'D' THEN 1 ELSE 0 END, 'audit': v.w.audit || i.i || e.e,
      'said': v.w.said || i.line || CASE e.e WHEN 'D' THEN '' ELSE coalesce(e.as_role, j.role) || ':' || j.text || chr(10) END}} AS w
    FROM ways v JOIN judged j ON j.c = v.c AND j.k = v.k + 1 JOIN ins i ON i.a = v.z JOIN edits e ON e.b = i.b
    WHERE e.e = 'D' OR (coalesce(j.fault, 'truncated') = 'truncated' AND (e.e = 'R' OR e.initial = left(j.role, 1)))) GROUP BY c, k, z),
stats AS (SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE two NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY c),
ends AS (SELECT v.c, min({{'cost': v.w.cost + 2 * length(i.i), 'audit': v.w.audit || i.i, 'said': v.w.said || i.line}}) AS w
  FROM ways v LEFT JOIN stats s ON s.c = v.c JOIN ins i ON i.a = v.z AND i.b IN (0, 3) WHERE v.k = coalesce(s.n, 0) GROUP BY v.c)
SELECT DISTINCT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  w.cost::BIGINT AS cost, w.audit AS audit, sha256(CASE w.said WHEN '' THEN '' ELSE left(w.said, length(w.said) - 1) END) AS repaired_sha256
FROM named JOIN ends USING (c) LEFT JOIN stats USING (c)""",
}
