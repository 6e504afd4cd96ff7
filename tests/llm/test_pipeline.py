import random
import zlib

import corpus_pipeline as p
from docmill.llm.common import materialize
from tests.llm.helpers import words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, _gone long"


def tables(spark, folder):
    rng = random.Random(12)
    bench = [(i, words(rng, 30, 9000)) for i in range(5)]
    rows, marks = [], []
    for i in range(160):
        good = i % 4 != 0
        text = words(rng, 150, 5000)
        rows.append([i, text if good else " ".join(w.upper() + "!!" for w in text.split())])
        marks.append((i, int(good), 0))
    for i in range(200, 212):  # a line that twelve documents have
        rows.append([i, words(rng, 120, 5000) + "\n the Shared line\n" + words(rng, 20, 5000)])
    near = words(rng, 200, 5000).split()
    rows.append([300, " ".join(near)])
    near[50] = "changed"
    rows += [[301, " ".join(near)], [302, rows[1][1]], [400, words(rng, 80, 5000) + " " + bench[2][1].upper() + " " + words(rng, 80, 5000)]]
    rows += [[500, words(rng, 150, 5000)], [501, None], [502, ""], [None, words(rng, 100, 5000)]]
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1) for i, t in rows], DOCS).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return rows


def test_repeated_rows_and_very_long_texts(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    rng = random.Random(5)
    long = words(rng, 400_000, 90_000)
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (3, ""), (4, long), (5, long + " more"), (6, words(rng, 40, 9000)), (6, words(rng, 40, 9000))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1) for i, t in rows], DOCS)
    near = sorted((r.doc_id, r.n_chars) for r in p.near_copies(spark, docs, folder).collect())
    assert [i for i, _ in near] == [1, 2, 4, 6, 6]
    kept = p.lines(spark, docs, folder)
    assert kept.count() == len(rows) and kept.where("doc_id = 4").first().text == long
    pieces = p.packed(spark, p.benchmark(spark, docs, folder), folder).where("doc_id = 4")
    assert pieces.groupBy().sum("length").first()[0] == pieces.first().doc_tokens


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    rows = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = {"doc_id", "text", "lang", "source", "n_chars"}
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    kept = []
    for name, stage in p.STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder), "test")
        assert columns <= set(docs.columns)
        kept.append((ids(docs), docs))
    quality, lines, near, bench = kept
    held = [i for i in range(160) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((i in quality[0]) == (i % 4 != 0) for i in held) >= 0.95 * len(held)
    assert lines[0] == quality[0] and lines[1].where("contains(text, 'Shared line')").count() == 0
    assert {300, 1} <= near[0] and not {301, 302} & near[0] and None in near[0]
    assert near[0] - bench[0] == {400}
    packed = p.STAGES[-1][1](spark, docs, folder)
    assert ids(packed) == bench[0]
    assert sorted(map(tuple, p.run(spark, folder).collect()), key=str) == sorted(map(tuple, packed.collect()), key=str)


def test_empty_table(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert p.run(spark, folder).count() == 0
