"""The posting index: pruned search against a plain one, and versions that replace each other."""

import math
import random
from collections import Counter

import pytest

from docmill.operators import index as ix
from docmill.operators.search import hybrid_search
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, part string, kind string, version string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)


def texts(n=300, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 80)))) for i in range(n)]


def brute(rows, query, k, k1=1.2, b=0.75):
    words = {i: (t or "").split() for i, t in rows}
    n, mean = len(rows), sum(map(len, words.values())) / sum(t is not None for _, t in rows)
    terms = list(dict.fromkeys(query.split()[:8]))
    df = {t: sum(t in w for w in words.values()) for t in terms}
    out = []
    for i, w in words.items():
        c = Counter(w)
        s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * len(w) / mean)) for t in terms if c[t])
        if s > 0:
            out.append((-round(s, 6), i))
    return [i for _, i in sorted(out)[:k]]


def bm25(index, query, k):
    hits = ix.search_index(index, [(1, list(dict.fromkeys(query.split()[:8])), set())], k, 1.2, 0.75)
    rows = hits.where("bm25 is not null").select("doc_id", F.round("bm25", 6).alias("s")).collect()
    return [i for _, i in sorted((-r.s, r.doc_id) for r in rows)[:k]]


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "index")


def test_pruned_search_is_exact(spark, root, monkeypatch):
    rows = texts()
    index = ix.PostingIndex.open(spark, root).refresh(frame(spark, rows))
    for query in ("w0 w1 w50", "w3", "w59 w58 w57 w0", "nothing"):
        for k in (3, 25, 1000):
            assert bm25(index, query, k) == brute(rows, query, k)


def test_blocks_are_left_unread():
    # rare long runs of a term: the k-th best score is above most blocks' bounds
    rows = [(i, f"v{i}", " ".join(["common"] * (9 if i < 40 else 1) + ["rest"] * (i % 7))) for i in range(4000)]
    table = ix._build(ix.pa.table({"part": [0] * len(rows), "id": [r[0] for r in rows], "version": [r[1] for r in rows], "n": [r[2] for r in rows]}))
    shard = ix.Shard(table)
    slots, scores, read = shard.best({"common": 1.0}, 10, 4.0, 1.2, 0.75)
    assert read < 1000 and len(slots) >= 10 and scores.min() > 1.7


def test_a_new_version_replaces_the_old_one(spark, root):
    rows = dict(texts(60))
    first = ix.PostingIndex.open(spark, root).refresh(frame(spark, list(rows.items())))
    before = {(r.part, r.gen) for r in first.manifest().collect()}
    rows[7], gone = "fresh words only", rows.pop(9)
    rows[1000] = "another fresh one"
    second = first.refresh(frame(spark, list(rows.items())))
    assert ix.PostingIndex.open(spark, root).version == second.version == 2
    assert bm25(second, "fresh", 10) == brute(list(rows.items()), "fresh", 10)
    for query in ("w0 w1", "w2 w5"):
        assert bm25(second, query, 1000) == brute(list(rows.items()), query, 1000)
    live = second.rows(ix.DOC).select("id").toPandas()["id"].tolist()
    assert sorted(live) == sorted(rows) and 9 not in live and gone
    after = {(r.part, r.gen) for r in second.manifest().collect()}
    assert 1 <= len(after - before) <= 3  # only the shards of 7, 9 and 1000
    # the reader of the first version still sees it, and a refresh without changes writes nothing
    assert bm25(first, "fresh", 10) == [] and second.refresh(frame(spark, list(rows.items()))).version == 2


def test_odd_rows(spark, root):
    rows = [(1, None), (2, ""), (None, "lone word"), (3, "lone word"), (3, "lone word"), (4, "ß É 日本語 " * 5000), (5, "x")]
    index = ix.PostingIndex.open(spark, root).refresh(frame(spark, rows))
    assert index.rows(ix.DOC).count() == 7
    queries = spark.createDataFrame([(1, "lone"), (2, ""), (3, None), (4, "日本語 ss"), (5, "x")], "item_id long, text string")
    got = {(r.item_id, r.doc_id) for r in hybrid_search(index, queries).collect()}
    assert got == {(1, None), (1, 3), (4, 4), (5, 5)}


def test_an_empty_table(spark, root):
    index = ix.PostingIndex.open(spark, root).refresh(frame(spark, []))
    queries = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert index.rows(ix.DOC).count() == 0 and hybrid_search(index, queries).count() == 0
    assert hybrid_search(index.refresh(frame(spark, [(1, "a word")])), queries).count() == 1


def test_queries_in_blocks_find_the_same(spark, root, monkeypatch):
    from docmill.operators import search

    rows = texts(80)
    index = ix.PostingIndex.open(spark, root).refresh(frame(spark, rows))
    queries = spark.createDataFrame([(i, f"w{i} w{i + 3}") for i in range(11)] + [(1, "w1 w4")] * 2, "item_id long, text string")
    once = sorted(tuple(r) for r in hybrid_search(index, queries.distinct()).collect())
    monkeypatch.setattr(search, "BLOCK", 3)
    assert sorted(tuple(r) for r in hybrid_search(index, queries).collect()) == once and len(once) > 50
