"""Filters, matches and gates of retrieval, and the choice and checking of answers, as SQL in both dialects."""

from __future__ import annotations

from docmill.operators.relational import STATEMENTS, statement_query
from docmill.plans.dialects import both

#: A user's turn with the turn that answers it, their words, and the conversation's first turn as its topic.
_TURNS = """t AS (SELECT conv_id, turn, role, text, lead(text) OVER c AS line, lead(role) OVER c AS line_role, first_value(text) OVER c AS topic FROM conversations WINDOW c AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, turn, text, line, ADIS(W(text)) AS q, ADIS(W(line)) AS a, ADIS(FILT(W(topic), x => length(x) >= 5)) AS topic FROM t WHERE role = 'user' AND line_role = 'assistant')"""
#: Fixed values of four languages: words that deny.
_NOT = "R' (not|no|ne|pas|nicht|kein|no) '"

RETRIEVAL = {
    "source_kinds": "SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN 'protocol' WHEN STARTS(source, 'src1') THEN 'attachment' ELSE 'other' END AS source_kind FROM documents",
    # rows that may be seen, by any of three equalities, none of which is asked where the value is empty
    "filter_visible": "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang = 'en' AND d.source <> 'src0' AND coalesce(l.toxic, 0) = 0",
    # a broad question: a marker, and a scope token or three different words at most
    "broad_queries": """
WITH w AS (SELECT conv_id, turn, ADIS(W(text)) AS w FROM conversations WHERE role = 'user')
SELECT conv_id, turn, HAS(AJOIN(ASORT(w), ' '), R'(^| )(the|les|die|los|all|toutes)( |$)') AND (HAS(AJOIN(ASORT(w), ' '), R'(^| )(and|et|und|y)( |$)') OR LEN(w) <= 3) AS broad FROM w""",
    # what a hit is worth: less for boilerplate, more on the topic and at some length
    "hit_quality": f"""
WITH {_TURNS} SELECT conv_id, turn, round(#0.5 + CASE WHEN HAS(lower(line), R'copyright|all rights|license|cookie') OR line = '' THEN -#0.4 ELSE #0 END + CASE WHEN LEN(AINT(a, topic)) > 0 THEN #0.15 ELSE #0 END + CASE WHEN length(line) >= 220 THEN #0.04 ELSE #0 END, 6) AS quality FROM p""",
    # no candidates: what holds the text, the first hundred, each as if ranked first
    "contains_fallback": "SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) AS BIGINT) AS nth, round(1 / (1 + #1), 6) AS score FROM (SELECT doc_id FROM documents WHERE contains(lower(text), 'the th') ORDER BY doc_id LIMIT 100) AS f",
    # a label against a query: equal, one in the other, or enough shared words; numbers must not contradict
    "label_match": """
WITH n AS (SELECT p_partkey, lower(trim(p_name)) AS label, lower(trim(p_type)) AS query FROM part), w AS (SELECT *, W(label) AS a, W(query) AS b, regexp_extract_all(label, R'([0-9]+)', 1) AS x, regexp_extract_all(query, R'([0-9]+)', 1) AS y FROM n),
o AS (SELECT *, coalesce(LEN(AINT(ADIS(a), ADIS(b))) / nullif(greatest(LEN(ADIS(a)), LEN(ADIS(b))), 0), #0) AS ov FROM w)
SELECT p_partkey, round(CASE WHEN label = query THEN #1 WHEN contains(label, query) OR contains(query, label) THEN #0.92 WHEN ov >= #0.6 THEN #0.55 + #0.35 * ov ELSE #0 END, 6) AS match,
  CASE WHEN LEN(x) = 0 AND LEN(y) = 0 THEN #1 WHEN LEN(x) = 0 OR LEN(y) = 0 THEN #0.5 WHEN AJOIN(ASORT(x), ' ') = AJOIN(ASORT(y), ' ') THEN #1 ELSE #0 END AS numbers FROM o""",
    # the best link of each hit and label, and what they add to its score: .25 of the best signal, .10 of the best specificity;
    # products end in half a millionth, which engines round either way, so that a thousandth of that is added first
    "semantic_boost": """
WITH s AS (SELECT l.l_orderkey, p.p_brand, l.l_discount * 10 AS link, least(#1, p.p_size / #50) AS specificity, l.l_discount * 10 * least(#1, p.p_retailprice / #2000) AS signal FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
b AS (SELECT l_orderkey, p_brand, max(signal) AS signal, max(specificity) AS specificity FROM s GROUP BY l_orderkey, p_brand), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY signal DESC, specificity DESC, p_brand) AS k FROM b)
SELECT l_orderkey, count(*) AS n_labels, max(CASE WHEN k = 1 THEN p_brand END) AS best, round(least(#1, #0.25 * max(signal) + #0.10 * max(specificity)) + #0.000000001, 6) AS boost FROM k GROUP BY l_orderkey""",
    # a link with its node and the node's aliases
    "link_aliases": """
WITH a AS (SELECT p_type, AGGTEXT(DISTINCT p_brand; p_brand) AS aliases FROM part GROUP BY p_type) SELECT l.l_orderkey, l.l_linenumber, p.p_type, a.aliases FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN a ON p.p_type = a.p_type WHERE l.l_linenumber = 1""",
    # rows in the order in which their ids were asked for
    "hydrate_order": """
WITH i AS (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS BIGINT) AS pos FROM conversations) SELECT i.conv_id, i.pos, c.turn, md5(c.text) AS hash FROM i JOIN conversations c ON i.conv_id = c.conv_id AND i.turn = c.turn""",
    "candidate_limit": "SELECT conv_id, turn, CAST(greatest(turn + 1, least(greatest(12 * (turn + 1), 60), 120)) AS BIGINT) AS candidates FROM conversations",
    # texts whose vectors are still wanting: blanks skipped, equal ones asked once, keyed by the normalised text
    "embedding_misses": """
WITH n AS (SELECT doc_id, trim(regexp_replace(lower(text), R'[\\s]+', ' ', ALL)) AS t FROM documents), k AS (SELECT concat(SHA(t), '|text|64') AS key, doc_id FROM n WHERE t <> '')
SELECT k.key, count(*) AS n, min(k.doc_id) AS first_doc FROM k WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = k.doc_id) GROUP BY k.key""",
    # an answer can be a quote: a top score, a clear gap to the next, few topic words
    "extractive_gate": """
WITH m AS (SELECT max(l_extendedprice) AS most FROM lineitem), s AS (SELECT l_orderkey, l_linenumber, l_extendedprice / most AS score FROM lineitem CROSS JOIN m), r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS next FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber))
SELECT l_orderkey, l_linenumber, round(score, 6) AS score, score >= #0.9 AND score - coalesce(next, #0) >= #0.08 AS quote FROM r WHERE k = 1""",
    # how far a line supports a claim, and its band
    "claim_scores": f"""
WITH {_TURNS}, s AS (SELECT conv_id, turn, coalesce(LEN(AINT(q, a)) / nullif(LEN(q), 0), #0) AS claim_ov, coalesce(LEN(AINT(topic, a)) / nullif(LEN(topic), 0), #0) AS q_ov, LEN(AINT(q, a)) AS shared,
  contains(lower(line), lower(substr(text, 1, 12))) AS phrase, LEN(topic) > 0 AND LEN(AINT(topic, a)) = 0 AS cross_domain, HAS(lower(text), {_NOT}) <> HAS(lower(line), {_NOT}) AS negation FROM p),
v AS (SELECT conv_id, turn, round(#0.75 * claim_ov + #0.15 * q_ov + CASE WHEN shared >= 2 THEN #0.15 ELSE #0 END + CASE WHEN phrase THEN #0.1 ELSE #0 END - CASE WHEN cross_domain THEN #0.2 ELSE #0 END - CASE WHEN negation THEN #0.35 ELSE #0 END, 6) AS score FROM s)
SELECT conv_id, turn, score, CASE WHEN score >= #0.67 THEN 'supported' WHEN score >= #0.34 THEN 'partial' ELSE 'unsupported' END AS band FROM v""",
    # conversations one of whose used lines has no word of the topic
    "topic_mismatch": f"WITH {_TURNS} SELECT conv_id, count(*) AS used, CAST(sum(CASE WHEN LEN(AINT(topic, a)) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS off_topic, max(CASE WHEN LEN(topic) > 0 AND LEN(AINT(topic, a)) = 0 THEN 1 ELSE 0 END) = 1 AS refused FROM p GROUP BY conv_id",
    # refused where the best of both measures is too low
    "relevance_gate": f"""
WITH {_TURNS}, l AS (SELECT conv_id, max(coalesce(LEN(AINT(q, a)) / nullif(greatest(LEN(q), LEN(a)), 0), #0)) AS lexical FROM p GROUP BY conv_id), n AS (SELECT a.vec_id, COS(a.embedding; b.embedding) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT l.conv_id, round(l.lexical, 6) AS lexical, round(coalesce(n.cosine, #0), 5) AS cosine, coalesce(n.cosine, #0) < #0.18 AND l.lexical < #0.2 AS refused FROM l LEFT JOIN n ON l.conv_id = n.vec_id""",
    # where a conversation has lines with a number, only these stay
    "claim_selection": """
WITH f AS (SELECT conv_id, turn, HAS(text, R'[0-9]') AS decision FROM conversations WHERE role = 'assistant'), m AS (SELECT *, max(CASE WHEN decision THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS some_decide FROM f) SELECT conv_id, turn, decision FROM m WHERE decision OR some_decide = 0""",
    # kinds of source that are asked for and not there, and the reason for a refusal
    "refusals": """
WITH p AS (SELECT conv_id, count(*) AS n, max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS u, max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS a, max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) AS s, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id)
SELECT conv_id, AJOIN(FILT(MAPL(SEQ(1, 3), i => CASE WHEN i = 1 AND a = 0 THEN 'assistant' WHEN i = 2 AND s = 0 THEN 'system' WHEN i = 3 AND u = 0 THEN 'user' ELSE '' END), x => x <> ''), ',') AS missing,
  CASE WHEN n = 0 OR chars = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN a = 0 AND s = 0 THEN 'MISSING_PROTOCOL_AND_ATTACHMENT' WHEN a = 0 THEN 'MISSING_PROTOCOL' WHEN s = 0 THEN 'MISSING_ATTACHMENT' WHEN u = 0 THEN 'NO_QUESTION' WHEN chars < 200 THEN 'LOW_RELEVANCE' ELSE 'ANSWER' END AS reason FROM p""",
    # a topic candidate: .7 of the words shared with the line, .2 of those shared with the root, .1 for length
    "topic_scores": f"""
WITH {_TURNS} SELECT conv_id, turn, round(#0.7 * coalesce(LEN(AINT(q, a)) / nullif(LEN(q), 0), #0) + #0.2 * coalesce(LEN(AINT(q, topic)) / nullif(LEN(q), 0), #0) + #0.1 * least(#1, LEN(q) / #6), 6) AS score FROM p""",
    # compact and extended summaries: two or four sentences, clipped at a word
    "summaries": """
WITH s AS (SELECT doc_id, FILT(MAPL(regexp_extract_all(text, R'([^.!?;]+[.!?;]*)', 1), x => trim(regexp_replace(x, R'[\\s]+', ' ', ALL))), x => x <> '') AS s FROM documents),
j AS (SELECT doc_id, AJOIN(HEAD(s, 1, 2), ' ') AS compact, AJOIN(HEAD(s, 1, 4), ' ') AS extended FROM s)
SELECT doc_id, CASE WHEN length(compact) > 320 THEN concat(regexp_extract(substr(compact, 1, 320), R'^(.*) [^ ]*$', 1), '...') ELSE compact END AS compact, CASE WHEN length(extended) > 720 THEN concat(regexp_extract(substr(extended, 1, 720), R'^(.*) [^ ]*$', 1), '...') ELSE extended END AS extended FROM j""",
    # clauses of a turn, in order
    "clauses": """
WITH l AS (SELECT conv_id, turn, FILT(MAPL(regexp_extract_all(text, R'([^.;:!?\\n,]+)', 1), x => trim(x)), x => x <> '') AS l FROM conversations), c AS (SELECT conv_id, turn, POSEX(l; pos, clause) FROM l) SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, clause FROM c""",
    # words that match by their stem: plural endings go, then the first four letters decide
    "fuzzy_words": f"""
WITH {_TURNS}, s AS (SELECT conv_id, turn, ADIS(MAPL(FILT(q, x => length(x) >= 4), x => substr(regexp_replace(x, R'(es|en|s)$', ''), 1, 4))) AS q, ADIS(MAPL(FILT(a, x => length(x) >= 4), x => substr(regexp_replace(x, R'(es|en|s)$', ''), 1, 4))) AS a FROM p)
SELECT conv_id, turn, CAST(LEN(AINT(q, a)) AS BIGINT) AS matched, CAST(LEN(q) AS BIGINT) AS stems FROM s""",
    # lists of ids: trimmed, empty ones out, the first of equal ones stays, in order
    "id_lists": """
WITH i AS (SELECT user_id, trim(event_type) AS id, min(event_id) AS first FROM events WHERE trim(event_type) <> '' GROUP BY user_id, trim(event_type)) SELECT user_id, AGGTEXT(id; first) AS ids FROM i GROUP BY user_id""",
    # payloads under their defaults
    "metadata_merge": "SELECT event_id, coalesce(JSONGET(props, '$.k'), '0') AS k, coalesce(JSONGET(props, '$.page'), 'none') AS page, coalesce(JSONGET(props, '$.type'), event_type) AS type FROM events",
    # an object out of a fenced or prefixed answer: from the first brace to the last
    "json_salvage": """
WITH f AS (SELECT event_id, concat('answer: ```json ', coalesce(props, ''), ' ``` done') AS raw FROM events), o AS (SELECT event_id, nullif(regexp_extract(raw, R'(?s)([{].*[}])', 1), '') AS body FROM f)
SELECT event_id, body IS NOT NULL AS found, JSONGET(coalesce(body, '{}'), '$.k') AS k FROM o""",
    # the newest twelve answers with the same key before each vector, and whether one is near enough to be used again
    "answer_cache": """
WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings), s AS (SELECT label, vec_id, k, EXPLODE(SEQ(1, 12)) AS back FROM r),
p AS (SELECT s.vec_id, r.vec_id AS other FROM s JOIN r ON r.label = s.label AND r.k = s.k - s.back), c AS (SELECT p.vec_id, COS(a.embedding; b.embedding) AS cosine FROM p JOIN embeddings a ON a.vec_id = p.vec_id JOIN embeddings b ON b.vec_id = p.other)
SELECT vec_id, round(max(cosine), 5) AS best, max(cosine) >= #0.985 AS hit FROM c GROUP BY vec_id""",
}

PAIRS = {name: both(s) for name, s in RETRIEVAL.items()}
STATEMENTS |= PAIRS
QUERIES = {name: statement_query(name) for name in PAIRS}
ORACLE_SQL = {name: duck for name, (_, duck) in PAIRS.items()}
