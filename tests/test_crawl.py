"""Crawls with cycles and ties, appended JSON lines and evaluation sets, and the placeholders of statements."""

import json

from docmill.operators.crawl import crawl_frontier
from docmill.plans.dialects import both
from docmill.sources.files import append_json_lines, read_gold_set


def test_frontier_ends_on_cycles_and_keeps_the_smallest_parent(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "d"), ("x", "y"), (None, "z"), ("a", None), ("a", "b")], "parent string, url string")
    got = crawl_frontier(edges, spark.createDataFrame([("a",), ("a",), (None,)], "url string"))
    assert sorted(map(tuple, got.collect())) == [("a", 0, None), ("b", 1, "a"), ("c", 1, "a"), ("d", 2, "b")]
    chain = spark.createDataFrame([(str(k), str(k + 1)) for k in range(20)], "parent string, url string")
    assert crawl_frontier(chain, spark.createDataFrame([("0",)], "url string"), 5).count() == 6
    assert crawl_frontier(edges.where("false"), spark.createDataFrame([], "url string")).count() == 0


def test_json_lines_and_gold_sets(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, None, 0.5)], "id long, text string, score double")
    append_json_lines(rows, str(tmp_path / "out"))
    append_json_lines(rows, str(tmp_path / "out"))
    assert spark.read.schema(rows.schema).json(str(tmp_path / "out")).count() == 4
    (tmp_path / "gold.json").write_text(json.dumps({"description": "d", "cases": [{"case_id": "c1", "query": "q", "top_k": 3, "filter_year": 2025}, {"case_id": "c2", "query": "r", "unknown": 1}]}, indent=1))
    got = {r.case_id: r for r in read_gold_set(spark, str(tmp_path / "gold.json")).collect()}
    assert got["c1"].top_k == 3 and got["c1"].filter_year == 2025 and got["c2"].top_k == 5 and got["c2"].filter_topic is None


def test_statements_hold_on_nulls_empty_texts_and_ties(spark):
    from docmill.operators import decisions, retrieval

    docs = [(1, None, "en", "src0", 0), (2, "", "en", "src1", 0), (3, " \n\n", "fr", "src2", 3), (4, "1. the same\n1. the same", None, None, 23), (4, "1. the same\n1. the same", None, None, 23), (None, "x | y", "de", "src3", 5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").createOrReplaceTempView("documents")
    spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (2, 0, "user", "Is it so?"), (2, 1, "assistant", "It is so.")], "conv_id long, turn long, role string, text string").createOrReplaceTempView("conversations")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").createOrReplaceTempView("labels")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").createOrReplaceTempView("embeddings")
    for module in (decisions, retrieval):
        for name, (statement, _) in module.PAIRS.items():
            if not any(t in statement for t in ("part", "lineitem", "orders", "events", "nation", "supplier", "region")):
                spark.sql(statement).collect()
    scores = {r.conv_id: r for r in spark.sql(retrieval.PAIRS["claim_scores"][0]).collect()}
    assert scores[2].band == "supported" and scores[1].band == "unsupported"
    items = [r for r in spark.sql(decisions.PAIRS["decision_items"][0]).collect() if r.doc_id == 4]
    assert items and all(r.n_lines <= 4 for r in items)


def test_placeholders():
    spark, duck = both("SELECT LEN(W(a.t)), #0.5, SHA(x), AGGTEXT(v; k) FROM t WHERE HAS(t, R'a')")
    assert spark == "SELECT size(regexp_extract_all(lower(a.t), r'([\\p{L}\\p{N}]+)', 1)), 0.5D, sha2(x, 256), listagg(v, ',') WITHIN GROUP (ORDER BY k) FROM t WHERE rlike(t, r'a')"
    assert duck == "SELECT len(regexp_extract_all(lower(a.t), '([\\p{L}\\p{N}]+)', 1)), 0.5::DOUBLE, sha256(x), string_agg(v, ',' ORDER BY k) FROM t WHERE regexp_matches(t, 'a')"
