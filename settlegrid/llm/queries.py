"""Registered queries of the corpus operators over the given tables, and their SQL where SQL can express them."""
from . import (decontaminate, exact_dedup, hard_negatives, license_scan, line_dedup, near_dedup, packing, quality, sharding,
               token_counts, toxicity, url_filter, whitening)

Q, SQL = {}, {}


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name, text=None):
    def add(fn):
        Q[name] = fn
        if text:
            SQL[name] = text
        return fn
    return add


@_query("op1_quality")
def op1(spark, sf_dir):
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op2_line_dedup", r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i, lines[i] AS line, translate(trim(lines[i], E' \t\n\x0B\x0C\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz') AS key FROM d, LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)),
k AS (SELECT key, max(doc_id) AS top FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (top IS NOT NULL AND top <> doc_id) AS BIGINT) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (top IS NULL OR top = doc_id), '')) AS kept_sha256
FROM l LEFT JOIN k USING (key) GROUP BY doc_id""")
def op2(spark, sf_dir):
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"))


@_query("op3_packing")
def op3(spark, sf_dir):
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


@_query("op4_near_dedup")
def op4(spark, sf_dir):
    return near_dedup.near_components(_table(spark, sf_dir, "documents"))


@_query("op5_license_scan")
def op5(spark, sf_dir):
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


@_query("op6_sharding")
def op6(spark, sf_dir):
    return sharding.shard(_table(spark, sf_dir, "documents"))


_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@_query("op7_decontamination", rf"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array({_FOLD}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(regexp_split_to_array({_FOLD}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark
 WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k
 FROM bw, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
runs AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM dw, sizes,
 LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) WHERE len(w) >= n),
hit AS (SELECT doc_id, i, n, item_id FROM runs JOIN win USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, LATERAL (SELECT unnest(range(i, i + n)) AS p) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
 FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
 CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op7(spark, sf_dir):
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op8_toxicity")
def op8(spark, sf_dir):
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op9_exact_dedup", r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)""")
def op9(spark, sf_dir):
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


_AT = r"'(?s)^.*?://([^/?#]*)'"
_CANON = r"""'(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>|<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'"""
_TARGET = r"""'https?://[^\s"''<>]+'"""
_PLACE = r"""CASE WHEN contains(u, '://') THEN translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) || regexp_extract(u, '(?s)^[^#?]*(\?[^#]*)', 1) END"""


def _rule(kind):
    fits = "((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    cases = []
    for verdict, rule in sorted(url_filter.RULES, key=lambda r: (-len(r[1]), r[0] != "allow")):
        at = rule.index("/")
        cases.append(f"WHEN {fits.format(h=rule[:at], p=rule[at:])} THEN '{rule if kind == 'rule' else verdict}'")
    return "CASE " + " ".join(cases) + " END"


@_query("op10_url_filter", rf"""
WITH RECURSIVE p AS (SELECT page_id, coalesce(translate(regexp_extract(url, {_AT}, 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
 coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, {_PLACE.replace('u,', 'url,')} AS place, html FROM pages),
ed AS (SELECT place AS a, {_PLACE} AS b FROM (SELECT place, replace(regexp_extract(t, {_TARGET}), '&amp;', '&') AS u
 FROM (SELECT place, unnest(regexp_extract_all(html, {_CANON})) AS t FROM p WHERE place IS NOT NULL))),
e AS (SELECT a, b FROM ed WHERE b IS NOT NULL AND a <> b UNION SELECT b, a FROM ed WHERE b IS NOT NULL AND a <> b),
r(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
j AS (SELECT a, b, regexp_extract(b, '^([^/?#]*)', 1) AS host, regexp_extract(b, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM r),
f AS (SELECT a, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' END AS fate
 FROM (SELECT a, {_rule('verdict')} AS v FROM j) GROUP BY a)
SELECT page_id, host, path, {_rule('rule')} AS rule, coalesce({_rule('verdict')}, fate, 'allow') AS verdict FROM p LEFT JOIN f ON p.place = f.a""")
def op10(spark, sf_dir):
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"))


@_query("op11_whitening")
def op11(spark, sf_dir):
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


@_query("op12_token_counts")
def op12(spark, sf_dir):
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


_MINED = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT a.vec_id AS a, a.label AS al, b.vec_id AS b, b.label AS bl, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS s
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
pos AS (SELECT * FROM p WHERE al = bl QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT pos.a AS anchor_id, pos.b AS positive_id,
 CAST(row_number() OVER (PARTITION BY pos.a, pos.b ORDER BY n.s DESC, n.b) AS INTEGER) AS rank,
 n.b AS negative_id, pos.s AS positive_score, n.s AS negative_score
FROM pos JOIN p n ON n.a = pos.a AND n.al <> n.bl AND 30 * pos.s <= 100 * n.s AND 100 * n.s <= 90 * pos.s
QUALIFY row_number() OVER (PARTITION BY pos.a, pos.b ORDER BY n.s DESC, n.b) <= 10"""


@_query("op13_hard_negatives", _MINED)
def op13(spark, sf_dir):
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"))


def registry():
    return Q, SQL
