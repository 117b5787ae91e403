"""The package's queries by name, and SQL for those that SQL can express.

Where a verdict is learned, or a column has no SQL form, a second query (``llm_...``) shows the columns that have one.
"""

from __future__ import annotations

from tessera.llm import decontaminate, ngram_join, packing, pii, quality_knn, quality_rules, token_scan, toxic_crf, url_filter, warc


def queries():
    return {
        "op1_ngram_jaccard_join": ngram_join.query,
        "op2_quality_rules": quality_rules.query,
        "op3_decontamination": decontaminate.query,
        "op4_warc": warc.query,
        "op5_pii": pii.query,
        "op6_token_counts": token_scan.query,
        "op7_best_fit_packing": packing.query,
        "op8_quality_classifier": quality_knn.query,
        "op9_url_filter": url_filter.query,
        "op10_toxicity": toxic_crf.query,
        "llm_quality_counts": lambda spark, sf_dir: quality_rules.query(spark, sf_dir).drop("kept", "distance"),
        "llm_pii_counts": lambda spark, sf_dir: pii.query(spark, sf_dir).drop("base_sha256", "spans"),
        "llm_url_rules": lambda spark, sf_dir: url_filter.query(spark, sf_dir).selectExpr("page_id", "host", "path", "rule", "if(rule is null, null, verdict) AS ruled"),
    }


def oracle_sql():
    """SQL by query; packing, token scans and learned scores have none: the tests hold them against brute force, the
    tokenizer itself and held-out labels."""
    return {"op1_ngram_jaccard_join": _LINKS, "op3_decontamination": _HITS, "op4_warc": _RECORDS, "llm_quality_counts": _COUNTS, "llm_pii_counts": _FOUND, "llm_url_rules": _RULES}


_LINKS = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct([ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] for i in range(1, len(ws) - 2)]) END AS sh FROM w),
c AS (SELECT md5(array_to_string(list_sort(sh), '|')) AS cls, any_value(sh) AS sh, min(doc_id) AS rep, any_value(len(sh)) AS n FROM s WHERE len(sh) > 0 GROUP BY 1),
e AS (SELECT cls, n, unnest(sh) AS g FROM c),
p AS (SELECT a.cls AS a, b.cls AS b FROM e a JOIN e b ON a.g = b.g AND a.cls <> b.cls AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85
  GROUP BY a.cls, b.cls, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
d AS (SELECT a, count(*) AS n_links FROM p GROUP BY a),
reach AS (WITH RECURSIVE q(a, b) AS (SELECT cls, cls FROM c UNION SELECT q.a, p.b FROM q JOIN p ON q.b = p.a) SELECT q.a, min(c.rep) AS comp FROM q JOIN c ON c.cls = q.b GROUP BY q.a)
SELECT s.doc_id, len(s.sh) AS n_shingles, CASE WHEN len(s.sh) = 0 THEN s.doc_id ELSE reach.comp END AS component_id, coalesce(d.n_links, 0) AS n_links
FROM s LEFT JOIN c ON len(s.sh) > 0 AND c.cls = md5(array_to_string(list_sort(s.sh), '|')) LEFT JOIN reach ON reach.a = c.cls LEFT JOIN d ON d.a = c.cls"""

_HITS = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id::VARCHAR AS item, least(13, len(ws)) AS k, array_to_string(ws[j : j + least(13, len(ws)) - 1], ' ') AS t FROM (SELECT *, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS j FROM i WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM win),
g AS (SELECT r, k, j, array_to_string(ws[j : j + k - 1], ' ') AS t FROM (SELECT d.*, k, unnest(range(1, len(ws) - k + 2)) AS j FROM d, ks WHERE len(ws) >= k)),
h AS (SELECT g.r, g.k, g.j, win.item FROM g JOIN win ON win.k = g.k AND win.t = g.t),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(j, j + k)) AS p FROM (SELECT DISTINCT r, k, j FROM h)) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)"""

_RECORDS = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS hx FROM pages),
f AS (SELECT t, min(page_id) AS first FROM p GROUP BY t)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * bits[5 * k + 1]::INT + 8 * bits[5 * k + 2]::INT + 4 * bits[5 * k + 3]::INT + 2 * bits[5 * k + 4]::INT + bits[5 * k + 5]::INT, 1) for k in range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM (SELECT *, array_to_string([CASE c WHEN '0' THEN '0000' WHEN '1' THEN '0001' WHEN '2' THEN '0010' WHEN '3' THEN '0011' WHEN '4' THEN '0100' WHEN '5' THEN '0101' WHEN '6' THEN '0110' WHEN '7' THEN '0111'
  WHEN '8' THEN '1000' WHEN '9' THEN '1001' WHEN 'a' THEN '1010' WHEN 'b' THEN '1011' WHEN 'c' THEN '1100' WHEN 'd' THEN '1101' WHEN 'e' THEN '1110' ELSE '1111' END for c in string_split(hx, '')], '') AS bits FROM p) JOIN f USING (t)"""

_COUNTS = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT r, i, row(ws[i], ws[i+1], ws[i+2]) AS t FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
h AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS many FROM g) WHERE many > 1) GROUP BY r),
l AS (SELECT r, [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM w)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in ws]), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(h.n, 0) AS n_repeat_words, len(ws) < 50 OR 100 * coalesce(h.n, 0) > 50 * len(ws) AS base_failed
FROM w JOIN l USING (r) LEFT JOIN h USING (r)"""

_FOUND = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS emails, regexp_extract_all(t, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') AS ips,
  [regexp_replace(x, '[^0-9]', '', 'g') for x in regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+')] AS cards, [regexp_replace(x, '[^0-9]', '', 'g') for x in regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]')] AS phones FROM d)
SELECT doc_id, len(emails)::BIGINT AS n_email, len([x for x in ips if len([y for y in string_split(x, '.') if try_cast(y AS INT) <= 255]) = 4])::BIGINT AS n_ip,
  len([x for x in cards if length(x) BETWEEN 13 AND 19 AND list_sum([CASE WHEN (length(x) - i) % 2 = 0 THEN x[i]::INT WHEN x[i]::INT > 4 THEN 2 * x[i]::INT - 9 ELSE 2 * x[i]::INT END for i in range(1, length(x) + 1)]) % 10 = 0])::BIGINT AS n_card,
  len([x for x in phones if length(x) BETWEEN 9 AND 15])::BIGINT AS n_phone FROM f"""

_RULES = r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(h, f, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit AS (SELECT page_id, arg_max(h || f, length(h || f)) AS rule, arg_max(v, length(h || f)) AS ruled FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f) GROUP BY page_id)
SELECT page_id, host, path, rule, ruled FROM p LEFT JOIN fit USING (page_id)"""
