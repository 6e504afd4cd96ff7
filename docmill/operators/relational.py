"""Joins, windows, sets and roll-ups over the star schema, as Spark SQL; the oracle is the same statement in DuckDB's dialect."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from docmill.sources.tables import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: name: (statement for Spark, statement for DuckDB or None where it is the same)
STATEMENTS: dict[str, tuple[str, str | None]] = {
    # a hit with its document and source, and an optional label
    "join_inner_outer": ("""
SELECT d.doc_id, d.source, c.n_docs, coalesce(l.quality, -1) AS quality FROM documents d JOIN (SELECT source, count(*) AS n_docs FROM documents GROUP BY source) c ON d.source = c.source
LEFT JOIN labels l ON d.doc_id = l.doc_id""", None),
    # counts are aggregated before the join, not asked row by row
    "join_hydrate": ("""
SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name, coalesce(i.n_items, 0) AS n_items, coalesce(i.n_returned, 0) AS n_returned
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n_items, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS n_returned FROM lineitem GROUP BY l_orderkey) i ON o.o_orderkey = i.l_orderkey""", None),
    # spans of turns against windows of 200 characters of the same conversation, half-open
    "join_interval": ("""
WITH s AS (SELECT conv_id, turn, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM conversations),
m AS (SELECT conv_id, max(a + n) AS n FROM s GROUP BY conv_id), w AS (SELECT conv_id, explode(sequence(0, n - 1, 200)) AS b FROM m WHERE n > 0)
SELECT s.conv_id, s.turn, CAST(w.b AS BIGINT) AS window_start, CAST(least(s.a + s.n, w.b + 200) - greatest(s.a, w.b) AS BIGINT) AS shared FROM s JOIN w ON s.conv_id = w.conv_id AND s.a < w.b + 200 AND w.b < s.a + s.n""", """
WITH s AS (SELECT conv_id, turn, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM conversations),
w AS (SELECT conv_id, unnest(range(0, max(a + n), 200)) AS b FROM s GROUP BY conv_id HAVING max(a + n) > 0)
SELECT s.conv_id, s.turn, w.b AS window_start, least(s.a + s.n, w.b + 200) - greatest(s.a, w.b) AS shared FROM s JOIN w ON s.conv_id = w.conv_id AND s.a < w.b + 200 AND w.b < s.a + s.n"""),
    # the ordered neighbours -8 ... +2 of a turn
    "join_neighbours": ("""
SELECT conv_id, turn, count(turn) OVER near AS n_near, sum(length(text)) OVER near AS near_chars FROM conversations WINDOW near AS (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 8 PRECEDING AND 2 FOLLOWING)""", """
SELECT a.conv_id, a.turn, count(b.turn) AS n_near, sum(length(b.text))::BIGINT AS near_chars FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 8 AND a.turn + 2 GROUP BY a.conv_id, a.turn"""),
    "join_missing_work": ("SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) OR NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)", None),
    "join_semi_subset": ("SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)", None),
    # enrichment gate: the first reason that holds
    "filter_gate": ("""
SELECT doc_id, CASE WHEN source = 'src0' THEN 'SKIP_SOURCE_KIND' WHEN length(trim(text)) = 0 THEN 'NO_CHUNKS' WHEN length(text) < 200 THEN 'TEXT_TOO_SHORT' WHEN lang <> 'en' THEN 'LOW_QUALITY_SCORE' ELSE 'RUN' END AS reason FROM documents""", None),
    "filter_contains": ("SELECT doc_id FROM documents WHERE contains(lower(source), 'src1') OR startswith(lang, 'd')", "SELECT doc_id FROM documents WHERE contains(lower(source), 'src1') OR starts_with(lang, 'd')"),
    "agg_coverage": ("""
SELECT d.lang, count(*) AS n_docs, count(DISTINCT d.source) AS n_sources, count(DISTINCT l.doc_id) AS n_labelled, count(*) - count(DISTINCT l.doc_id) AS missing, round(count(DISTINCT l.doc_id) / count(*), 6) AS coverage_rate
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang""", None),
    "agg_rollup": ("""
SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS n_suppliers, max(l_shipdate) AS last_seen, grouping(l_linestatus) AS level FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus))""", """
SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS n_suppliers, max(l_shipdate) AS last_seen, grouping(l_linestatus)::TINYINT AS level FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus))"""),
    # recency weight max(0.2, 1 - min(age / 120, 0.8)) as of the newest event's day, top 50 of each type
    "agg_recency": ("""
WITH w AS (SELECT event_type, user_id, round(sum(greatest(0.2D, 1 - least(datediff((SELECT max(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) / 120D, 0.8D))), 6) AS weight FROM events GROUP BY event_type, user_id),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY weight DESC, user_id) AS nth FROM w) SELECT event_type, user_id, weight, CAST(nth AS BIGINT) AS nth FROM r WHERE nth <= 50""", """
WITH w AS (SELECT event_type, user_id, round(sum(greatest(0.2::DOUBLE, 1 - least(datediff('day', CAST(ts AS DATE), (SELECT max(CAST(ts AS DATE)) FROM events)) / 120::DOUBLE, 0.8::DOUBLE))), 6) AS weight FROM events GROUP BY event_type, user_id),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY weight DESC, user_id) AS nth FROM w) SELECT event_type, user_id, weight, nth FROM r WHERE nth <= 50"""),
    "agg_latency": ("""
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, max(value) AS highest FROM events GROUP BY event_type""", """
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.95) AS p95, max(value) AS highest FROM events GROUP BY event_type"""),
    # a rule's verdict against labels, with 1.0 for an empty denominator
    "agg_precision_recall": ("""
WITH p AS (SELECT d.lang, l.quality, CASE WHEN d.n_chars >= 300 THEN 1 ELSE 0 END AS said FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT lang, count(*) AS n, CASE WHEN sum(said) = 0 THEN 1.0D ELSE round(sum(said * quality) / sum(said), 6) END AS precision, CASE WHEN sum(quality) = 0 THEN 1.0D ELSE round(sum(said * quality) / sum(quality), 6) END AS recall FROM p GROUP BY lang""", """
WITH p AS (SELECT d.lang, l.quality, CASE WHEN d.n_chars >= 300 THEN 1 ELSE 0 END AS said FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT lang, count(*) AS n, CASE WHEN sum(said) = 0 THEN 1.0::DOUBLE ELSE round(sum(said * quality) / sum(said), 6) END AS precision, CASE WHEN sum(quality) = 0 THEN 1.0::DOUBLE ELSE round(sum(said * quality) / sum(quality), 6) END AS recall FROM p GROUP BY lang"""),
    # first and last time seen and the highest value, as a node is observed again
    "agg_merge_state": ("SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen, max(value) AS confidence, max_by(event_id, struct(value, event_id)) AS best FROM events GROUP BY user_id, event_type", "SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen, max(value) AS confidence, arg_max(event_id, struct_pack(v := value, e := event_id)) AS best FROM events GROUP BY user_id, event_type"),
    # topics: the longest label wins, with its support
    "agg_topic_seeds": ("""
SELECT lower(p_brand) AS topic, max_by(p_name, struct(length(p_name), p_name)) AS label, count(DISTINCT p_type) AS n_types, round(avg(p_retailprice), 4) AS mean_price, greatest(count(*), 1) AS support FROM part GROUP BY lower(p_brand)""", """
SELECT lower(p_brand) AS topic, arg_max(p_name, struct_pack(n := length(p_name), x := p_name)) AS label, count(DISTINCT p_type) AS n_types, round(avg(p_retailprice), 4) AS mean_price, greatest(count(*), 1) AS support FROM part GROUP BY lower(p_brand)"""),
    "agg_child_counts": ("SELECT n.n_nationkey, n.n_name, coalesce(c.n, 0) AS n_children FROM nation n LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) c ON n.n_nationkey = c.c_nationkey", None),
    # the best row of each key, ties to the smaller id
    "window_best": ("SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS k FROM lineitem) WHERE k = 1", None),
    "window_keep_first": ("SELECT doc_id, sha FROM (SELECT doc_id, sha2(text, 256) AS sha, row_number() OVER (PARTITION BY source, sha2(text, 256) ORDER BY doc_id) AS k FROM documents) WHERE k = 1", "SELECT doc_id, sha FROM (SELECT doc_id, sha256(text) AS sha, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS k FROM documents) WHERE k = 1"),
    # runs of a user's events with gaps of up to an hour
    "window_islands": ("""
WITH g AS (SELECT user_id, ts, event_id, CASE WHEN timestampdiff(SECOND, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) <= 3600 THEN 0 ELSE 1 END AS opens FROM events),
i AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM g)
SELECT user_id, island, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM i GROUP BY user_id, island""", """
WITH g AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 3601000000 THEN 0 ELSE 1 END AS opens FROM events),
i AS (SELECT user_id, ts, (sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS island FROM g)
SELECT user_id, island, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM i GROUP BY user_id, island"""),
    # how two rankings of one list differ
    "window_rank_change": ("""
WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS by_price, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS by_size FROM part)
SELECT p_brand, p_partkey, CAST(by_price AS BIGINT) AS by_price, CAST(by_size AS BIGINT) AS by_size, CAST(by_price - by_size AS BIGINT) AS moved FROM r WHERE by_price <= 10 OR by_size <= 10""", None),
    "window_context": ("SELECT conv_id, turn, array_join(collect_list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND 2 FOLLOWING), ' ') AS roles FROM conversations", "SELECT conv_id, turn, string_agg(role, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND 2 FOLLOWING) AS roles FROM conversations"),
    "set_union_best": ("""
SELECT user_id, max(score) AS score FROM (SELECT user_id, round(value * 0.37D + 0.58D, 6) AS score FROM events WHERE event_type = 'purchase' UNION ALL SELECT user_id, round(value, 6) FROM events WHERE event_type = 'click') GROUP BY user_id""", """
SELECT user_id, max(score) AS score FROM (SELECT user_id, round(value * 0.37::DOUBLE + 0.58::DOUBLE, 6) AS score FROM events WHERE event_type = 'purchase' UNION ALL SELECT user_id, round(value, 6) FROM events WHERE event_type = 'click') GROUP BY user_id"""),
    "set_missing": ("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'", None),
    # tree: region > nation > supplier with path and depth; ends when no node is left, and a cycle fails at Spark's level limit
    "tree_paths": ("""
WITH RECURSIVE n AS (SELECT concat('r', r_regionkey) AS id, CAST(NULL AS STRING) AS parent, r_name AS title FROM region UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), n_name FROM nation UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey), s_name FROM supplier),
t AS (SELECT id, title AS path, 0 AS depth FROM n WHERE parent IS NULL UNION ALL SELECT n.id, concat(t.path, ' > ', n.title), t.depth + 1 FROM t JOIN n ON n.parent = t.id) SELECT id, path, depth FROM t""", """
WITH RECURSIVE n AS (SELECT concat('r', r_regionkey) AS id, NULL::VARCHAR AS parent, r_name AS title FROM region UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), n_name FROM nation UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey), s_name FROM supplier),
t AS (SELECT id, title AS path, 0 AS depth FROM n WHERE parent IS NULL UNION ALL SELECT n.id, concat(t.path, ' > ', n.title), t.depth + 1 FROM t JOIN n ON n.parent = t.id) SELECT id, path, depth FROM t"""),
    # links, their kind by suffix, and the page's stable external id
    "url_links": ("""
SELECT page_id, link, CASE WHEN link RLIKE '(?i)[.]pdf($|[?])' THEN 'protocol' WHEN link RLIKE '(?i)[.](mp3|wav)($|[?])' THEN 'audio' WHEN link RLIKE '(?i)[.](mp4|avi)($|[?])' THEN 'video' ELSE 'page' END AS kind
FROM (SELECT page_id, explode(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages)""", """
SELECT page_id, link, CASE WHEN regexp_matches(link, '(?i)[.]pdf($|[?])') THEN 'protocol' WHEN regexp_matches(link, '(?i)[.](mp3|wav)($|[?])') THEN 'audio' WHEN regexp_matches(link, '(?i)[.](mp4|avi)($|[?])') THEN 'video' ELSE 'page' END AS kind
FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages)"""),
    "url_external_id": ("SELECT page_id, concat('urlhash:', substr(sha2(regexp_replace(url, '#.*$', ''), 256), 1, 24)) AS external_id FROM pages", "SELECT page_id, concat('urlhash:', substr(sha256(regexp_replace(url, '#.*$', '')), 1, 24)) AS external_id FROM pages"),
    # slash and count votes and dates of a text, by ordered rules
    "extract_numbers": ("""
SELECT doc_id, CASE WHEN text RLIKE '[0-9]+ ?/ ?[0-9]+' THEN 'slash' WHEN text RLIKE '[0-9]+' THEN 'count' ELSE 'none' END AS rule, regexp_extract(text, '([0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4})', 1) AS day, size(regexp_extract_all(text, '([0-9]+)', 1)) AS n_numbers FROM documents""", """
SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]+ ?/ ?[0-9]+') THEN 'slash' WHEN regexp_matches(text, '[0-9]+') THEN 'count' ELSE 'none' END AS rule, regexp_extract(text, '([0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4})', 1) AS day, len(regexp_extract_all(text, '([0-9]+)', 1))::INTEGER AS n_numbers FROM documents"""),
    # a turn's words against those of the turn before: support of a claim by a line
    "claim_overlap": ("""
WITH w AS (SELECT conv_id, turn, array_distinct(regexp_extract_all(lower(text), '([\\\\p{L}\\\\p{N}]+)', 1)) AS w FROM conversations), p AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM w)
SELECT conv_id, turn, round(coalesce(size(array_intersect(w, b)) / nullif(size(w), 0), 0), 6) AS claim_overlap, round(coalesce(size(array_intersect(w, b)) / nullif(size(array_union(w, b)), 0), 1), 6) AS jaccard FROM p WHERE b IS NOT NULL""", """
WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)', 1)) AS w FROM conversations), p AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM w)
SELECT conv_id, turn, round(coalesce(len(list_intersect(w, b)) / nullif(len(w), 0), 0), 6) AS claim_overlap, round(coalesce(len(list_intersect(w, b)) / nullif(len(list_distinct(list_concat(w, b))), 0), 1), 6) AS jaccard FROM p WHERE b IS NOT NULL"""),
}


_TABLE = re.compile(rf"\b(FROM|JOIN)\s+({'|'.join(TABLES)})\b(\s+(?:AS\s+)?[a-z]\w*)?")


def run_statement(spark: SparkSession, d: str, statement: str) -> DataFrame:
    """A statement over a folder's tables. The statement is analysed over views of names that nobody else has, which then go: a view
    of the caller's under a table's name stays as it is."""
    mark = f"docmill_{uuid.uuid4().hex}_"
    names = {m[1] for m in _TABLE.findall(statement)}
    for t in names:
        table(spark, d, t).createOrReplaceTempView(mark + t)
    try:
        return spark.sql(_TABLE.sub(lambda m: f"{m[1]} {mark}{m[2]}{m[3] or ' AS ' + m[2]}", statement))
    finally:
        for t in names:
            spark.catalog.dropTempView(mark + t)


def statement_query(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return run_statement(spark, d, STATEMENTS[name][0])

    run.__name__ = name
    return run


QUERIES = {name: statement_query(name) for name in STATEMENTS}
ORACLE_SQL = {name: duck or statement for name, (statement, duck) in STATEMENTS.items()}
