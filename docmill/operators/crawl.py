"""Addresses, pages and folders of a crawl, stored paths, versions and their index rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.relational import STATEMENTS, run_statement, statement_query
from docmill.plans.dialects import both
from docmill.sources.tables import lasting, table

_HOST = "regexp_extract(url, R'^[A-Za-z]+://([^/?#]*)', 1)"
_PATH = "regexp_extract(url, R'^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
_TITLE = "coalesce(nullif(trim(regexp_extract(html, R'(?s)<h1[^>]*>([^<]*)', 1)), ''), nullif(trim(regexp_extract(html, R'(?s)<h2[^>]*>([^<]*)', 1)), ''), nullif(trim(regexp_extract(html, R'(?s)<title[^>]*>([^<]*)', 1)), ''), 'untitled')"

CRAWL = {
    # where a blob is stored: by site, kind and content
    "blob_paths": "SELECT doc_id, concat(source, '/', lang, '/', SHA(text), '.bin') AS path FROM documents",
    # where a page's HTML is stored: its leaf's suffix is .html, a folder's page is index.html
    "html_paths": f"""
WITH p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages)
SELECT page_id, CASE WHEN path = '' OR ENDS(path, '/') THEN concat(host, '/', regexp_replace(path, R'^/+', ''), 'index.html') ELSE concat(host, regexp_replace(path, R'[.][A-Za-z0-9]+$', ''), '.html') END AS path FROM p""",
    # links resolved against their page: absolute, from the host's root, or from the page's folder; fragments and other schemes go
    "url_resolve": f"""
WITH l AS (SELECT page_id, regexp_extract(url, R'^([A-Za-z]+://[^/?#]*)', 1) AS root, regexp_extract({_PATH}, R'^(.*/)[^/]*$', 1) AS folder, EXPLODE(regexp_extract_all(html, R'href="([^"]*)"', 1)) AS link FROM pages),
r AS (SELECT page_id, link, CASE WHEN HAS(link, R'^https?://') THEN link WHEN HAS(link, R'^[a-z]+:') OR STARTS(link, '#') OR link = '' THEN NULL WHEN STARTS(link, '/') THEN concat(root, link) ELSE concat(root, coalesce(nullif(folder, ''), '/'), link) END AS target FROM l)
SELECT page_id, regexp_replace(target, R'#.*$', '') AS target, count(*) AS n FROM r WHERE target IS NOT NULL GROUP BY page_id, regexp_replace(target, R'#.*$', '')""",
    # a page's title, the number before it, what kind of folder it is, and whether it is in scope
    "page_kinds": f"""
WITH t AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path, {_TITLE} AS title FROM pages)
SELECT page_id, title, nullif(regexp_extract(path, R'([0-9]+)', 1), '') AS count_hint, HAS(host, R'example[.](com|org)$') AND NOT STARTS(host, 'm.') AS in_scope,
  CASE WHEN HAS(title, R'^(19|20)[0-9][0-9]$') THEN 'year_folder' WHEN HAS(lower(title), R'appendix|annexe|anhang|anexo') THEN 'generic' WHEN HAS(title, R'[0-9]{{1,2}}[./][0-9]{{1,2}}[./][0-9]{{2,4}}') OR HAS(lower(title), R'regular|special') THEN 'meeting_folder'
       WHEN LEN(W(title)) >= 3 THEN 'topic_folder' ELSE 'generic_subfolder' END AS node_type FROM t""",
    # the nearest folder of a page's own address that holds two pages or more, else the page itself
    "folder_ascend": f"""
WITH p AS (SELECT page_id, concat({_HOST}, regexp_replace({_PATH}, R'/[^/]*$', '')) AS folder FROM pages),
s AS (SELECT page_id, SPLIT(folder, '/') AS s FROM p), f AS (SELECT page_id, EXPLODE(MAPL(SEQ(1, LEN(s)), i => AJOIN(HEAD(s, 1, i), '/'))) AS folder FROM s),
c AS (SELECT folder, count(*) AS n FROM f GROUP BY folder), r AS (SELECT f.page_id, f.folder, row_number() OVER (PARTITION BY f.page_id ORDER BY length(f.folder) DESC) AS k FROM f JOIN c ON f.folder = c.folder WHERE c.n >= 2)
SELECT p.page_id, coalesce(r.folder, concat('page:', CAST(p.page_id AS STRING))) AS folder, CASE WHEN r.folder IS NULL THEN 'self' WHEN r.folder = p.folder THEN 'direct' ELSE 'ancestor' END AS how FROM p LEFT JOIN r ON p.page_id = r.page_id AND r.k = 1""",
    # rows that come in, against those that are there, on the natural key
    "upsert_merge": """
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(l.quality, -1) AS quality, CASE WHEN d.doc_id IS NULL THEN 'insert' WHEN l.doc_id IS NULL THEN 'keep' ELSE 'update' END AS action FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""",
    # index rows of a host's pages: those of its newest page replace all older ones
    "index_replace": f"""
WITH v AS (SELECT page_id, {_HOST} AS host, regexp_replace(html, R'<[^>]*>', ' ', ALL) AS body FROM pages), n AS (SELECT host, max(page_id) AS page_id FROM v GROUP BY host),
c AS (SELECT v.host, v.page_id, EXPLODE(SEQ(0, length(v.body) / 900)) AS chunk, v.body FROM v JOIN n ON v.host = n.host AND v.page_id = n.page_id)
SELECT host, page_id, CAST(chunk AS BIGINT) AS chunk_index, md5(substr(body, CAST(chunk * 900 + 1 AS INT), 900)) AS chunk_hash FROM c""".replace("length(v.body) / 900", "CAST(floor((length(v.body) - 1) / 900) AS INT)"),
    # nodes of the tree to a depth, of one kind, with their children counted
    "tree_filter": """
WITH n AS (SELECT concat('r', CAST(r_regionkey AS STRING)) AS id, CAST(NULL AS STRING) AS parent, 'region' AS kind, 0 AS depth, r_name AS label FROM region UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), concat('r', CAST(n_regionkey AS STRING)), 'nation', 1, n_name FROM nation UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), concat('n', CAST(s_nationkey AS STRING)), 'supplier', 2, s_name FROM supplier),
c AS (SELECT parent, count(*) AS n FROM n GROUP BY parent) SELECT n.id, n.kind, n.label, coalesce(c.n, 0) AS children FROM n LEFT JOIN c ON n.id = c.parent WHERE n.depth <= 1""",
}


def crawl_frontier(edges: DataFrame, roots: DataFrame, max_depth: int = 8) -> DataFrame:
    """(url, depth, parent): breadth-first from roots (url) over edges (parent, url), to max_depth.

    Each round joins the last one's pages with the edges and leaves out what has been visited, so that cycles end. A page found
    from several parents keeps the smallest one. Every round is cut from its lineage; null addresses lead nowhere.
    """
    edges = edges.where("parent IS NOT NULL AND url IS NOT NULL").distinct()
    visited = frontier = lasting(roots.select("url").where("url IS NOT NULL").distinct().select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")))
    for depth in range(1, max_depth + 1):
        found = frontier.select(F.col("url").alias("parent")).join(edges, "parent").groupBy("url").agg(F.min("parent").alias("parent"))
        frontier = lasting(found.join(visited, "url", "left_anti").select("url", F.lit(depth).alias("depth"), "parent"))
        if frontier.isEmpty():
            break
        visited = visited.union(frontier)
    return visited


_EDGES = f"""
WITH p AS (SELECT url, {_HOST} AS host, html FROM pages), e AS (SELECT regexp_extract(host, R'([^.]+[.][^.]+)$', 1) AS parent, host AS url FROM p UNION ALL SELECT host, url FROM p
UNION ALL SELECT url, concat('http://', host, link) FROM (SELECT url, host, EXPLODE(regexp_extract_all(html, R'href="(/[^"]*)"', 1)) AS link FROM p)) SELECT DISTINCT parent, url FROM e WHERE parent <> url"""
SPARK_EDGES, DUCK_EDGES = both(_EDGES)


def crawl_bfs(spark: SparkSession, d: str) -> DataFrame:
    """The pages' hosts, pages and links, reached from their domains."""
    edges = lasting(run_statement(spark, d, SPARK_EDGES))
    return crawl_frontier(edges, edges.join(edges.select(F.col("url").alias("parent")), "parent", "left_anti").select(F.col("parent").alias("url")))


CRAWL_BFS_SQL = f"""
WITH RECURSIVE e AS ({DUCK_EDGES}), t AS (SELECT DISTINCT parent AS url, 0 AS depth, NULL::VARCHAR AS parent FROM e WHERE parent NOT IN (SELECT url FROM e)
UNION SELECT e.url, t.depth + 1, e.parent FROM t JOIN e ON t.url = e.parent WHERE t.depth < 8), r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY depth, parent) AS k FROM t) SELECT url, depth, parent FROM r WHERE k = 1"""

PAIRS = {name: both(s) for name, s in CRAWL.items()}
STATEMENTS |= PAIRS
QUERIES = {name: statement_query(name) for name in PAIRS} | {"crawl_bfs": crawl_bfs}
ORACLE_SQL = {name: duck for name, (_, duck) in PAIRS.items()} | {"crawl_bfs": CRAWL_BFS_SQL}
