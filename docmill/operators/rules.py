"""Rules over addresses, labels, lines and hits, as SQL in both dialects."""

from __future__ import annotations

from docmill.operators.relational import STATEMENTS, statement_query

#: Query parameters that only track.
TRACKING = "^(utm_|fbclid|gclid|mc_|ref)"

RULES: dict[str, tuple[str, str | None]] = {
    # scheme and host in lower case, doubled slashes collapsed, tracking parameters and fragment gone, the others sorted
    "url_normalize": (f"""
WITH p AS (SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS base, regexp_extract(url, '[?]([^#]*)', 1) AS q FROM pages),
s AS (SELECT page_id, lower(regexp_extract(base, '^([A-Za-z]+://[^/]*)', 1)) AS host, regexp_replace(regexp_replace(base, '^[A-Za-z]+://[^/]*', ''), '/+', '/') AS path,
  array_join(array_sort(filter(split(q, '&'), x -> x <> '' AND NOT lower(x) RLIKE '{TRACKING}')), '&') AS rest FROM p)
SELECT page_id, concat(host, path, CASE WHEN rest = '' THEN '' ELSE concat('?', rest) END) AS canonical_url FROM s""", f"""
WITH p AS (SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS base, regexp_extract(url, '[?]([^#]*)', 1) AS q FROM pages),
s AS (SELECT page_id, lower(regexp_extract(base, '^([A-Za-z]+://[^/]*)', 1)) AS host, regexp_replace(regexp_replace(base, '^[A-Za-z]+://[^/]*', ''), '/+', '/', 'g') AS path,
  array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '{TRACKING}'))), '&') AS rest FROM p)
SELECT page_id, concat(host, path, CASE WHEN rest = '' THEN '' ELSE concat('?', rest) END) AS canonical_url FROM s"""),
    # where a page is stored: unsafe characters replaced, the query as a hash, .bin for a name without suffix
    "storage_path": ("""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z]+://([^?#]*)', 1), '[<>:"|*]', '_'), '[.][.]', '_') AS path, regexp_extract(url, '[?]([^#]*)', 1) AS q FROM pages),
s AS (SELECT page_id, path, q, regexp_extract(path, '([^/]*)$', 1) AS leaf FROM p)
SELECT page_id, concat(path, CASE WHEN q = '' THEN '' ELSE concat('__q', substr(sha2(q, 256), 1, 10)) END, CASE WHEN contains(leaf, '.') THEN '' ELSE '.bin' END) AS path FROM s""", """
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z]+://([^?#]*)', 1), '[<>:"|*]', '_', 'g'), '[.][.]', '_', 'g') AS path, regexp_extract(url, '[?]([^#]*)', 1) AS q FROM pages),
s AS (SELECT page_id, path, q, regexp_extract(path, '([^/]*)$', 1) AS leaf FROM p)
SELECT page_id, concat(path, CASE WHEN q = '' THEN '' ELSE concat('__q', substr(sha256(q), 1, 10)) END, CASE WHEN contains(leaf, '.') THEN '' ELSE '.bin' END) AS path FROM s"""),
    # phrases of two words by (count, length, phrase), the top 80 of each language
    "top_phrases": ("""
WITH w AS (SELECT lang, regexp_extract_all(lower(text), '([\\\\p{L}]+)', 1) AS w FROM documents), p AS (SELECT lang, explode(transform(sequence(1, size(w) - 1), i -> concat(w[i - 1], ' ', w[i]))) AS phrase FROM w WHERE size(w) > 1),
c AS (SELECT lang, phrase, count(*) AS n FROM p GROUP BY lang, phrase), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, length(phrase) DESC, phrase) AS k FROM c) SELECT lang, phrase, n, CAST(k AS BIGINT) AS k FROM r WHERE k <= 80""", """
WITH w AS (SELECT lang, regexp_extract_all(lower(text), '([\\p{L}]+)', 1) AS w FROM documents), p AS (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) AS phrase FROM w WHERE len(w) > 1),
c AS (SELECT lang, phrase, count(*) AS n FROM p GROUP BY lang, phrase), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, length(phrase) DESC, phrase) AS k FROM c) SELECT lang, phrase, n, k FROM r WHERE k <= 80"""),
    # one item of each order first, then the rest: documents are covered before hits repeat
    "cover_then_rest": ("""
WITH b AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS own FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE WHEN own = 1 THEN 0 ELSE 1 END, l_extendedprice DESC, l_orderkey, l_linenumber) AS place FROM b) SELECT l_suppkey, l_orderkey, l_linenumber, CAST(place AS BIGINT) AS place FROM r WHERE place <= 20""", None),
    # may a question be answered: what is asked for against what is there
    "evidence_gate": ("""
WITH s AS (SELECT user_id, count(*) AS n, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS protocol, max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS attachment, max(value) AS best FROM events GROUP BY user_id)
SELECT user_id, n, CASE WHEN n < 3 THEN 'INSUFFICIENT' WHEN protocol = 0 AND attachment = 0 THEN 'MISSING_BOTH' WHEN protocol = 0 THEN 'MISSING_PROTOCOL' WHEN attachment = 0 THEN 'MISSING_ATTACHMENT' WHEN best < 0.2 THEN 'LOW_RELEVANCE' ELSE 'ANSWER' END AS outcome FROM s""", None),
    "run_compliance": ("""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) SELECT event_type, count(*) AS runs, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS one_call, round(avg(CASE WHEN n = 1 THEN 1.0D ELSE 0.0D END), 6) AS compliance, sum(n - 1) AS duplicates FROM c GROUP BY event_type""", """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) SELECT event_type, count(*) AS runs, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END)::BIGINT AS one_call, round(avg(CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS compliance, sum(n - 1)::BIGINT AS duplicates FROM c GROUP BY event_type"""),
    # the hash embedding's terms: place, sign and weight of each word from its digest
    "hash_embedding_terms": ("""
WITH t AS (SELECT DISTINCT explode(regexp_extract_all(lower(text), '([\\\\p{L}\\\\p{N}]+)', 1)) AS term FROM documents), h AS (SELECT term, sha2(term, 256) AS h FROM t)
SELECT term, CAST(conv(substr(h, 1, 8), 16, 10) AS BIGINT) % 512 AS place, CASE WHEN CAST(conv(substr(h, 9, 2), 16, 10) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS sign, round(1 + CAST(conv(substr(h, 11, 2), 16, 10) AS BIGINT) % 5 / 10D, 6) AS weight FROM h""", """
WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)', 1)) AS term FROM documents), h AS (SELECT term, sha256(term) AS h FROM t)
SELECT term, ('0x' || substr(h, 1, 8))::BIGINT % 512 AS place, CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS sign, round(1 + ('0x' || substr(h, 11, 2))::BIGINT % 5 / 10::DOUBLE, 6) AS weight FROM h"""),
    # payloads that don't hold to the contract: no object, or a key that isn't there
    "json_contract": ("""
SELECT event_id, CASE WHEN props IS NULL OR NOT trim(props) RLIKE '^[{].*[}]$' THEN 'NOT_AN_OBJECT' WHEN get_json_object(props, '$.page') IS NULL AND get_json_object(props, '$.k') IS NULL THEN 'MISSING_KEY' ELSE 'OK' END AS issue FROM events""", """
SELECT event_id, CASE WHEN props IS NULL OR NOT regexp_matches(trim(props), '^[{].*[}]$') THEN 'NOT_AN_OBJECT' WHEN json_extract_string(props, '$.page') IS NULL AND json_extract_string(props, '$.k') IS NULL THEN 'MISSING_KEY' ELSE 'OK' END AS issue FROM events"""),
    # the turn of a window of ten before and two after that says most of the asked turn's words
    "context_subject": ("""
WITH w AS (SELECT conv_id, turn, array_distinct(regexp_extract_all(lower(text), '([\\\\p{L}\\\\p{N}]+)', 1)) AS w FROM conversations),
n AS (SELECT *, collect_list(struct(turn AS t, w AS v)) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 10 PRECEDING AND 2 FOLLOWING) AS near FROM w),
s AS (SELECT conv_id, turn, array_min(transform(filter(near, b -> b.t <> turn), b -> struct(-round(10 * size(array_intersect(w, b.v)) / greatest(size(w), 1) - 0.15D * abs(turn - b.t), 6) AS less, b.t AS source_turn))) AS best FROM n)
SELECT conv_id, turn, best.source_turn, 0 - best.less AS score FROM s WHERE best IS NOT NULL""", """
WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)', 1)) AS w FROM conversations),
s AS (SELECT a.conv_id, a.turn, b.turn AS source_turn, round(10 * len(list_intersect(a.w, b.w)) / greatest(len(a.w), 1) - 0.15::DOUBLE * abs(a.turn - b.turn), 6) AS score FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 10 AND a.turn + 2 AND b.turn <> a.turn),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, source_turn) AS k FROM s) SELECT conv_id, turn, source_turn, score FROM r WHERE k = 1"""),
    "hash_ids": ("SELECT doc_id, substr(sha1(concat_ws('|', 'v1', source, lang, CAST(doc_id AS STRING))), 1, 20) AS node_key, substr(sha2(text, 256), 1, 24) AS text_hash FROM documents", "SELECT doc_id, substr(sha1(concat_ws('|', 'v1', source, lang, doc_id)), 1, 20) AS node_key, substr(sha256(text), 1, 24) AS text_hash FROM documents"),
}
STATEMENTS |= RULES
QUERIES = {name: statement_query(name) for name in RULES}
ORACLE_SQL = {name: duck or spark for name, (spark, duck) in RULES.items()}
