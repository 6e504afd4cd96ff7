"""All registered queries outside the optional subpackages, and their SQL."""

from docmill.operators import crawl, decided, decisions, hierarchy, matching, nearest, payloads, ranking, relational, retrieval, rules, search, spans, texts
from docmill.streaming import state

MODULES = (texts, search, relational, rules, crawl, retrieval, decisions, decided, matching, spans, hierarchy, nearest, payloads, ranking, state)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
