"""Modes of search and fused hits: golden rows and odd ones."""

import pytest
from pyspark.sql import functions as F

from docmill.operators import ranking as r

FOUND, LINKS, QUERIES = "item_id long, doc_id long, score double", "doc_id long, label string, confidence double, specificity double, score string", "item_id long, text string, label string, mode string, doc_id string"
HITS, ASKED = "item_id long, chunk long, doc string, kind string, score double", "item_id long, kinds array<string>, broad boolean"


@pytest.mark.parametrize("label,other,want", [("a b", "a b", 1.0), ("a", "a b c", 0.92), ("x y z", "y", 0.92), ("a b c d", "d c b e", 0.55 + 0.35 * 0.75), ("a b", "b c", 0.0), ("", "a", 0.0), ("a", "", 0.0)])
def test_label_match(spark, label, other, want):
    assert spark.range(1).select(r.label_match(F.lit(label), F.lit(other)).alias("m")).first().m == pytest.approx(want)


def searched(spark, mode, label=None, text="The budget of the school"):
    found = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.5), (1, 12, 0.4), (1, 13, 0.95)], FOUND)
    links = spark.createDataFrame([(11, "Budget", 0.8, 0.5, "c"), (11, "school", 0.4, 0.9, "c"), (13, "budget", 1.0, 1.0, "c"), (12, "roads", 1.0, 1.0, "c"), (12, None, 1.0, 1.0, "c")], LINKS)
    rows = r.labelled_search(found, spark.createDataFrame([(1, text, label, mode, "c")], QUERIES), links).orderBy("rank").collect()
    return [(x.doc_id, round(x.score, 6), x.matches) for x in rows]


def test_modes(spark):
    lifted = round(0.5 + 0.25 * 0.8 * 0.92 + 0.1 * 0.9, 6)
    assert searched(spark, "off") == [(13, 0.95, 1), (10, 0.5, 0), (11, 0.5, 2), (12, 0.4, 0)]
    for mode in ("boost", None, " BOOST "):
        assert searched(spark, mode) == [(13, 1.0, 1), (11, lifted, 2), (10, 0.5, 0), (12, 0.4, 0)]
    assert searched(spark, "filter") == searched(spark, "boost")  # nothing was named to filter by
    assert searched(spark, "filter", "ROADS") == [(12, 0.75, 1)]
    assert searched(spark, "filter", "nowhere") == []
    assert searched(spark, "boost", "roads")[1] == (12, 0.75, 1)


def test_the_fallback_is_for_queries_without_hits_only(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["An  !! end", "none", None, "", "!! again", "ab"])], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "!!"), (2, "none"), (3, ""), (4, None), (5, "zz")], "item_id long, text string")
    found = spark.createDataFrame([(2, 1, 0.9)], FOUND)
    got = sorted(tuple(x) for x in r.with_fallback(found, docs, queries).collect())
    assert got == [(1, 0, 0.72), (1, 4, 0.72), (2, 1, 0.9)]


def fused(spark, hits, candidates, kinds, broad, k):
    rows = [(1, c, d, kind, s) for c, d, kind, s in hits]
    more = [(1, c, d, kind, s, q, x) for c, d, kind, s, q, x in candidates]
    asked = spark.createDataFrame([(1, kinds, broad)], ASKED)
    out = r.fuse(spark.createDataFrame(rows, HITS), spark.createDataFrame(more, HITS + ", quality double, decides boolean"), asked, k)
    return [x.chunk for x in out.orderBy("place").collect()]


def test_fusion(spark):
    hits = [(1, "a", "protocol", 0.9), (2, "a", "protocol", 0.8), (3, "b", "protocol", 0.3), (4, "c", "other", 0.7), (4, "c", "other", 0.75), (5, "c", "other", 0.3)]
    none = []
    assert fused(spark, hits, none, None, False, 8) == [1, 2, 4, 3, 5]
    assert fused(spark, hits, none, None, False, 2) == [1, 2]
    # a kind that is asked for and missing brings its best candidates; others leave
    extra = [(9, "x", "attachment", 0.2, 0.2, False), (8, "x", "attachment", 0.2, 0.2, False), (7, "y", "other", 0.99, 0.9, True)]
    assert fused(spark, hits, extra, ["protocol", "attachment"], False, 8) == [1, 2, 3, 8, 9]
    # a broad question: one chunk for each protocol, ahead of the rest; a deciding candidate stands for its protocol
    assert fused(spark, hits, none, [], True, 8) == [1, 3, 4, 5]
    decide = [(6, "a", "protocol", 0.1, 0.5, True), (10, "a", "protocol", 0.2, 0.4, True), (2, "a", "protocol", 0.8, 0.9, False)]
    assert fused(spark, hits, decide, None, True, 8) == [3, 6, 4, 5]
    # one protocol alone is left as it is
    assert fused(spark, hits[:2] + hits[3:], decide, None, True, 8) == [1, 2, 4, 5]
    assert fused(spark, [], none, ["protocol"], True, 8) == []
