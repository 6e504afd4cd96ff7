"""Decisions in texts, their places, contexts and labels, and roll-ups over them, as SQL in both dialects."""

from __future__ import annotations

from docmill.operators.relational import STATEMENTS, statement_query
from docmill.plans.dialects import both

#: A document's lines with the character where each begins.
_LINES = """r AS (SELECT doc_id, POSEX(SPLIT(text, NEWLINE); pos, line) FROM documents),
l AS (SELECT doc_id, pos, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM r)"""
#: Fixed values of four languages: words that open or mark a decision.
_VERB = "R'(?i)(^| )(decided|approved|shall|the|les|die|los) '"
_NUMBERED = "R'^[0-9]+[.)-]|^[-*#] '"

DECISIONS = {
    # what a meeting's heading says: day, month, year (two digits: of this century), in range; the confidence grows with what is found
    "meeting_metadata": """
WITH h AS (SELECT o_orderkey, concat(o_orderpriority, ' meeting ', CAST(day(o_orderdate) AS STRING), '.', CAST(month(o_orderdate) AS STRING), '.', CASE WHEN o_orderstatus = 'F' THEN substr(CAST(year(o_orderdate) AS STRING), 3, 2) ELSE CAST(year(o_orderdate) AS STRING) END) AS heading FROM orders),
d AS (SELECT o_orderkey, CAST(regexp_extract(heading, R'([0-9]{1,2})[./][0-9]{1,2}[./][0-9]{2,4}', 1) AS INT) AS d, CAST(regexp_extract(heading, R'[0-9]{1,2}[./]([0-9]{1,2})[./][0-9]{2,4}', 1) AS INT) AS m, CAST(regexp_extract(heading, R'[0-9]{1,2}[./][0-9]{1,2}[./]([0-9]{2,4})', 1) AS INT) AS y,
  CASE WHEN HAS(heading, R'(?i)urgent') THEN 'special' WHEN HAS(heading, R'(?i)high|medium') THEN 'regular' END AS kind FROM h),
v AS (SELECT o_orderkey, d, m, CASE WHEN y < 100 THEN y + 2000 ELSE y END AS y, kind, d BETWEEN 1 AND 31 AND m BETWEEN 1 AND 12 AS valid FROM d)
SELECT o_orderkey, CASE WHEN valid THEN CAST(y * 10000 + m * 100 + d AS BIGINT) END AS day, kind, round(least(#1, #0.4 + #0.15 * (CASE WHEN valid THEN 1 ELSE 0 END + CASE WHEN kind IS NOT NULL THEN 1 ELSE 0 END) + CASE WHEN valid AND kind IS NOT NULL THEN #0.1 ELSE #0 END), 6) AS confidence FROM v""",
    # items of a text: a numbered or marked line opens one, up to four lines belong to it, a blank ends it; twelve characters at least
    "decision_items": f"""
WITH {_LINES}, f AS (SELECT *, trim(line) = '' AS blank, HAS(trim(line), {_NUMBERED}) OR HAS(line, {_VERB}) AS opens FROM l), g AS (SELECT *, sum(CASE WHEN opens OR blank THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS item FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item ORDER BY pos) AS nth, max(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, item) AS opened FROM g),
i AS (SELECT doc_id, CAST(min(pos) AS BIGINT) AS first_line, count(*) AS n_lines, CAST(sum(length(trim(line))) AS BIGINT) AS chars, max(CASE WHEN HAS(trim(line), {_NUMBERED}) THEN 1 ELSE 0 END) AS numbered, max(CASE WHEN HAS(line, {_VERB}) THEN 1 ELSE 0 END) AS verb, max(CASE WHEN contains(line, '|') THEN 1 ELSE 0 END) AS pipe FROM k WHERE opened = 1 AND nth <= 4 GROUP BY doc_id, item)
SELECT doc_id, first_line, n_lines, chars, round(#0.45 + #0.15 * numbered + #0.15 * verb + #0.1 * pipe, 6) AS confidence FROM i WHERE chars >= 12""",
    # a row of a table: the agenda is its first cell, the text the longest of the others
    "pipe_rows": """
WITH r AS (SELECT p_partkey, SPLIT(concat(p_type, ' ~ ', p_name, ' ~ ', p_brand), ' ~ ') AS c FROM part), l AS (SELECT p_partkey, substr(AT(c, 1), 1, 120) AS agenda, POSEX(c; pos, cell) FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY length(cell) DESC, pos) AS k FROM l WHERE pos > 0) SELECT p_partkey, agenda, cell AS text FROM k WHERE k = 1""",
    # two decisions in one line: cut at a connector behind the 24th character, both parts sixteen at least
    "approval_split": f"""
WITH {_LINES}, c AS (SELECT doc_id, pos, line, instr(line, ' and ') AS place FROM l), s AS (SELECT doc_id, pos, line, CASE WHEN place > 25 AND place - 1 >= 16 AND length(line) - place - 4 >= 16 THEN place ELSE 0 END AS place FROM c)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, 0 AS part, CASE WHEN place > 0 THEN substr(line, 1, CAST(place - 1 AS INT)) ELSE line END AS span FROM s WHERE line <> '' UNION ALL SELECT doc_id, CAST(pos AS BIGINT), 1, substr(line, CAST(place + 5 AS INT)) FROM s WHERE place > 0""",
    # parse quality of a document's items: .45 of coverage, .35 of the sure ones, .20 of those with a place; below .55 another pass is due
    "parse_quality": f"""
WITH {_LINES}, c AS (SELECT doc_id, count(*) AS n, CAST(sum(CASE WHEN HAS(trim(line), {_NUMBERED}) OR HAS(line, {_VERB}) THEN 1 ELSE 0 END) AS DOUBLE) AS items, CAST(sum(CASE WHEN HAS(line, {_VERB}) AND length(line) >= 40 THEN 1 ELSE 0 END) AS DOUBLE) AS sure, CAST(sum(CASE WHEN trim(line) <> '' THEN 1 ELSE 0 END) AS DOUBLE) AS placed FROM l GROUP BY doc_id),
q AS (SELECT doc_id, round(#0.45 * items / n + #0.35 * sure / greatest(items, #1) + #0.20 * placed / n, 6) AS quality FROM c) SELECT doc_id, quality, CASE WHEN quality >= #0.55 THEN 'local' ELSE 'rescue' END AS strategy FROM q""",
    # items with their pages of 2000 characters; one without a page is not public
    "decision_pages": f"""
WITH {_LINES} SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(floor(start / 2000) + 1 AS BIGINT) AS first_page, CAST(floor((start + length(line)) / 2000) + 1 AS BIGINT) AS last_page, trim(line) <> '' AS is_public FROM l WHERE HAS(trim(line), {_NUMBERED}) OR HAS(line, {_VERB})""",
    # the line that holds an offset, its end included, else the nearest; the first of equals
    "nearest_line": f"""
WITH {_LINES}, o AS (SELECT l.*, d.n_chars * 2 / 3 AS place FROM l JOIN documents d ON l.doc_id = d.doc_id), x AS (SELECT doc_id, pos, CASE WHEN place >= start AND place <= start + length(line) THEN #0 ELSE least(abs(place - start), abs(place - start - length(line))) END AS d FROM o),
k AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY d, pos) AS k FROM x) SELECT doc_id, CAST(pos AS BIGINT) AS pos FROM k WHERE k = 1""",
    # addresses and numbers in a turn, its subject by the first rule that holds, and what is sure of it
    "turn_subjects": """
WITH c AS (SELECT conv_id, turn, role, text, nullif(regexp_extract(text, R'([A-Z][a-z]+ [0-9]+)', 1), '') AS address, nullif(regexp_extract(text, R'([0-9]{3,})', 1), '') AS parcel, W(text) AS w FROM conversations),
s AS (SELECT *, CASE WHEN address IS NOT NULL THEN address WHEN LEN(w) >= 5 THEN AJOIN(HEAD(w, 1, 5), ' ') WHEN LEN(w) > 0 THEN AJOIN(w, ' ') ELSE role END AS subject FROM c)
SELECT conv_id, turn, address, parcel, subject, round(#0.4 + CASE WHEN address IS NOT NULL THEN #0.25 ELSE #0 END + CASE WHEN parcel IS NOT NULL THEN #0.2 ELSE #0 END + CASE WHEN LEN(w) >= 5 THEN #0.05 ELSE #0 END + CASE WHEN role = 'user' THEN #0.1 ELSE #0 END, 6) AS confidence FROM s""",
    # the turn before or after that fits a turn best: two for naming its words, one for an overlap, else by how near it is; the first of equals
    "best_context": """
WITH w AS (SELECT conv_id, turn, ADIS(W(text)) AS w, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM conversations),
n AS (SELECT *, lag(turn) OVER c AS t1, lag(w) OVER c AS w1, lag(place) OVER c AS a1, lead(turn) OVER c AS t2, lead(w) OVER c AS w2, lead(place) OVER c AS a2 FROM w WINDOW c AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT conv_id, turn, t1 AS other, CASE WHEN LEN(AINT(w, w1)) >= 5 THEN 2 ELSE 0 END + CASE WHEN LEN(AINT(w, w1)) >= 1 THEN 1 ELSE 0 END + CASE WHEN abs(place - a1) <= 2200 THEN greatest(#0, #0.5 - abs(place - a1) / #5000) ELSE #0 END AS score FROM n WHERE t1 IS NOT NULL
UNION ALL SELECT conv_id, turn, t2, CASE WHEN LEN(AINT(w, w2)) >= 5 THEN 2 ELSE 0 END + CASE WHEN LEN(AINT(w, w2)) >= 1 THEN 1 ELSE 0 END + CASE WHEN abs(place - a2) <= 2200 THEN greatest(#0, #0.5 - abs(place - a2) / #5000) ELSE #0 END FROM n WHERE t2 IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, other) AS k FROM s) SELECT conv_id, turn, other, round(score, 6) AS score FROM k WHERE k = 1""",
    # the chunk of a mention: the one that it overlaps, else the first
    "anchor_chunk": """
WITH m AS (SELECT doc_id, text, instr(text, regexp_extract(text, R'([0-9]{2,})', 1)) AS place, regexp_extract(text, R'([0-9]{2,})', 1) AS mention FROM documents)
SELECT doc_id, mention, CASE WHEN mention = '' THEN CAST(0 AS BIGINT) ELSE CAST(floor((place - 1) / 750) AS BIGINT) END AS chunk, CASE WHEN mention = '' THEN 'nearest' ELSE 'overlap' END AS how FROM m""",
    # mentions against chunks of 900 characters that begin at every 750th: the surest of each chunk and label
    "mention_chunks": f"""
WITH {_LINES}, m AS (SELECT doc_id, start AS a, start + length(line) AS b, lower(regexp_extract(line, R'([A-Za-z]+)', 1)) AS label, round(least(#1, length(line) / #200), 6) AS confidence FROM l WHERE HAS(line, R'[A-Za-z]')),
c AS (SELECT *, EXPLODE(SEQ(CAST(greatest(0, floor((a - 900) / 750) + 1) AS INT), CAST(greatest(0, floor((a - 900) / 750) + 1, floor((b - 1) / 750)) AS INT))) AS chunk FROM m) SELECT doc_id, CAST(chunk AS BIGINT) AS chunk, label, max(confidence) AS confidence FROM c GROUP BY doc_id, chunk, label""",
    # does a span say what it is said to say: in range, literally, or in its normal form
    "span_checks": """
WITH s AS (SELECT doc_id, text, length(text) AS n, CAST(floor(length(text) / 3) AS INT) AS a, lower(trim(substr(text, CAST(floor(length(text) / 3) AS INT) + 1, 30))) AS mention FROM documents)
SELECT doc_id, CASE WHEN mention = '' THEN 'EMPTY' WHEN a + 30 > n THEN 'OUT_OF_RANGE' WHEN substr(text, a + 1, 30) = mention THEN 'STRICT' WHEN contains(lower(substr(text, a + 1, 30)), mention) THEN 'NORMALISED' ELSE 'MISMATCH' END AS verdict, CAST(floor(a / 2000) + 1 AS BIGINT) AS page FROM s""",
    # why a label makes no topic; else how specific it is: .45 of its own words, .25 of its support, .15 of its density, .15 of what the parent lacks
    "label_rules": """
WITH n AS (SELECT lower(trim(p_name)) AS label, lower(trim(p_type)) AS parent, count(*) AS support, avg(p_size / #50) AS density FROM part GROUP BY lower(trim(p_name)), lower(trim(p_type))),
w AS (SELECT *, W(label) AS w, FILT(W(label), x => x NOT IN ('the', 'of', 'and', 'to', 'in', 'a', 'part', 'item', 'general', 'other')) AS info, ADIS(W(parent)) AS pw FROM n)
SELECT label, parent, CASE WHEN label = '' OR LEN(w) = 0 THEN 'EMPTY_LABEL' WHEN HAS(label, R'^[0-9# ]+$') THEN 'NUMERIC_ONLY_LABEL' WHEN LEN(info) = 0 THEN 'STOPWORDS_ONLY' WHEN LEN(info) < 2 OR (LEN(w) - LEN(info)) / LEN(w) > #0.7 OR LEN(FILT(w, x => NOT AHAS(pw, x))) = 0 THEN 'TOO_GENERIC' ELSE 'OK' END AS reason,
  round(#0.45 * LEN(ADIS(info)) / greatest(1, LEN(w)) + #0.25 * least(#1, support / #3) + #0.15 * least(#1, density) + #0.15 * CASE WHEN LEN(info) = 0 THEN #0 ELSE LEN(FILT(info, x => NOT AHAS(pw, x))) / LEN(info) END, 6) AS specificity FROM w""",
    # keys chained from parent to child, and what becomes of each label
    "label_chain": """
WITH r AS (SELECT r_regionkey, sha1(concat('topic|', lower(r_name))) AS k FROM region), n AS (SELECT n_nationkey, r.k AS parent, sha1(concat(r.k, '|', lower(n_name))) AS k FROM nation JOIN r ON n_regionkey = r_regionkey),
s AS (SELECT s_suppkey, n.k AS parent, sha1(concat(n.k, '|', lower(s_name))) AS k, s_acctbal FROM supplier JOIN n ON s_nationkey = n_nationkey) SELECT s_suppkey, parent, k AS node_key, CASE WHEN s_acctbal >= 0 THEN 'active' ELSE 'candidate' END AS status FROM s""",
    # vectors against the centre of each label: .78 matches alone; the best eight of a label
    "topic_match": """
WITH v AS (SELECT label, POSEX(embedding; pos, x) FROM embeddings), m AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM v GROUP BY label, pos), c AS (SELECT label, CENTRE AS centre FROM m GROUP BY label),
s AS (SELECT e.vec_id, e.label, COS(e.embedding; c.centre) AS cosine FROM embeddings e JOIN c ON e.label = c.label),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(cosine, 6) DESC, vec_id) AS k FROM s) SELECT vec_id, label, round(cosine, 5) AS cosine, cosine >= #0.78 AS matched FROM k WHERE k <= 8""",
    # nodes and links of two runs, the surest of each kept
    "graph_merge": """
WITH e AS (SELECT p_brand AS node, p_type AS target, round(least(#1, p_size / #50), 6) AS confidence FROM part UNION ALL SELECT p_brand, p_type, round(least(#1, p_retailprice / #3000), 6) FROM part) SELECT node, target, max(confidence) AS confidence, count(*) AS n FROM e GROUP BY node, target""",
    # lines that hint at a topic, lifted by .03 for each hint and .12 at most; the first line of each page
    "evidence_lines": f"""
WITH {_LINES}, h AS (SELECT doc_id, pos, floor(start / 2000) AS page, LEN(regexp_extract_all(lower(line), R'(the|les|die|los|ing|tion|ment)', 1)) AS hits FROM l WHERE trim(line) <> ''), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) AS k FROM h)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(page + 1 AS BIGINT) AS page, round(least(#0.12, #0.03 * hits), 6) AS boost, k = 1 AS first_of_page FROM k""",
    # the newest row of each key stays
    "newest_rows": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    # the four sentences of a document with most of its first sentence's words
    "top_sentences": """
WITH s AS (SELECT doc_id, regexp_extract_all(text, R'([^.!?]+)', 1) AS s FROM documents), e AS (SELECT doc_id, ADIS(W(first)) AS q, POSEX(s; pos, sentence) FROM (SELECT doc_id, s, AT(s, 1) AS first FROM s WHERE LEN(s) > 1)),
k AS (SELECT doc_id, pos, LEN(AINT(q, ADIS(W(sentence)))) AS shared FROM e WHERE pos > 0), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY shared DESC, pos) AS k FROM k) SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(shared AS BIGINT) AS shared FROM r WHERE k <= 4""",
    # topics of each owner by the sum of their confidence, the best six
    "owner_topics": """
WITH t AS (SELECT l.l_suppkey, p.p_brand, round(sum(least(#1, greatest(#0, l.l_discount * 12))), 6) AS weight FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY l.l_suppkey, p.p_brand), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY weight DESC, p_brand) AS k FROM t) SELECT l_suppkey, p_brand, weight, CAST(k AS BIGINT) AS k FROM k WHERE k <= 6""",
    # headlines of a document: what stands before a colon or a short first line, each weighted by how early it stands; five of each
    "headline_anchors": f"""
WITH {_LINES}, h AS (SELECT doc_id, pos, trim(CASE WHEN instr(line, ':') BETWEEN 2 AND 81 THEN substr(line, 1, CAST(instr(line, ':') - 1 AS INT)) ELSE substr(line, 1, 80) END) AS head FROM l WHERE trim(line) <> ''), s AS (SELECT doc_id, lower(head) AS head, round(sum(#1 / (pos + 1)), 6) AS weight FROM h WHERE head <> '' GROUP BY doc_id, lower(head)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, head) AS k FROM s) SELECT doc_id, head, weight FROM k WHERE k <= 5""",
    # paths of topics: stop tokens go, root > child
    "topic_paths": """
WITH w AS (SELECT p_type, FILT(W(p_type), x => x NOT IN ('the', 'of', 'and')) AS w FROM part) SELECT p_type, count(*) AS n, max(CASE WHEN LEN(w) = 0 THEN '' WHEN LEN(w) = 1 THEN AT(w, 1) ELSE concat(AT(w, 1), ' > ', AT(w, LEN(w))) END) AS path, max(CASE WHEN LEN(w) <= 1 THEN 'coarse' WHEN LEN(w) = 2 THEN 'medium' ELSE 'fine' END) AS granularity FROM w GROUP BY p_type""",
    # roots of one word that are rare join the root of two words that fits best: its count and .6 of the overlap
    "sparse_roots": """
WITH t AS (SELECT p_brand, W(p_type) AS w FROM part), r AS (SELECT p_brand, AT(w, 1) AS word, AJOIN(HEAD(w, 1, 2), ' ') AS root FROM t), c AS (SELECT p_brand, root, word, count(*) AS n FROM r GROUP BY p_brand, root, word),
k AS (SELECT a.p_brand, a.root, a.n, b.root AS target, b.n + CASE WHEN a.word = b.word THEN #0.6 ELSE #0 END AS score, row_number() OVER (PARTITION BY a.p_brand, a.root ORDER BY b.n + CASE WHEN a.word = b.word THEN #0.6 ELSE #0 END DESC, b.root) AS k FROM c a LEFT JOIN c b ON a.p_brand = b.p_brand AND a.word = b.word AND a.root <> b.root AND a.n <= 2 AND b.n > 2)
SELECT p_brand, coalesce(target, root) AS root, CAST(sum(n) AS BIGINT) AS n FROM k WHERE k = 1 GROUP BY p_brand, coalesce(target, root)""",
    # why labels were refused, counted by run, and each reason's share
    "reject_histogram": """
WITH r AS (SELECT p_brand, CASE WHEN LEN(W(p_name)) = 0 THEN 'EMPTY' WHEN LEN(W(p_name)) < 2 THEN 'TOO_GENERIC' WHEN HAS(lower(p_name), R'^[0-9# ]+$') THEN 'NUMERIC_ONLY' ELSE 'OK' END AS reason FROM part) SELECT p_brand, reason, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY p_brand), 6) AS share FROM r GROUP BY p_brand, reason""",
    # what speaks for a node: the best score of decisions and of all else
    "node_support": """
SELECT l_suppkey, max(CASE WHEN l_returnflag = 'R' THEN l_discount END) AS decision_support, max(CASE WHEN l_returnflag <> 'R' THEN l_discount END) AS other_support, count(*) AS n FROM lineitem GROUP BY l_suppkey""",
    "similarity_stats": "SELECT event_type, min(value) AS low, max(value) AS high, round(avg(value), 5) AS mean, count(*) AS n FROM events WHERE value > 0 GROUP BY event_type",
    # a decision with its document and site, and an optional context
    "decision_context": """
SELECT l.l_orderkey, l.l_linenumber, o.o_orderstatus, c.c_mktsegment, s.s_name FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey AND s.s_nationkey = c.c_nationkey""",
    # attachments of a meeting fanned out to its decisions, each pair once
    "link_fanout": "SELECT DISTINCT o.o_custkey, l.l_orderkey, l.l_partkey FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_quantity >= 40",
    # the decision item of the same order that fits a returned line best
    "hint_match": """
WITH a AS (SELECT * FROM lineitem WHERE l_linenumber = 1), s AS (SELECT a.l_orderkey, b.l_linenumber, CASE WHEN a.l_suppkey = b.l_suppkey THEN #1 ELSE #0 END + CASE WHEN a.l_linestatus = b.l_linestatus THEN #0.5 ELSE #0 END AS score FROM a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber > 1),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber) AS k FROM s) SELECT l_orderkey, l_linenumber, score FROM k WHERE k = 1""",
    # the form in which decisions are compared
    "signatures": "SELECT doc_id, substr(trim(regexp_replace(lower(text), R'[^\\p{L}\\p{N}_]+', ' ', ALL)), 1, 255) AS signature FROM documents",
}

PAIRS = {name: both(s) for name, s in DECISIONS.items()}
#: Lines taken in order while they fit into 12 000 characters, each of 180 at most; one that doesn't fit is skipped, later ones may.
PAIRS["greedy_budget"] = (
    "SELECT doc_id, aggregate(transform(split(text, '\\n'), x -> least(length(x), 180)), 0, (used, n) -> CASE WHEN used + n <= 12000 THEN used + n ELSE used END) AS chars FROM documents",
    "SELECT doc_id, list_reduce(list_transform(string_split(text, chr(10)), lambda x: least(length(x), 180)), lambda used, n: CASE WHEN used + n <= 12000 THEN used + n ELSE used END) AS chars FROM documents",
)
STATEMENTS |= PAIRS
QUERIES = {name: statement_query(name) for name in PAIRS}
ORACLE_SQL = {name: duck for name, (_, duck) in PAIRS.items()}
