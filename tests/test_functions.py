from pyspark.sql import functions as F

from docmill.functions.text import cleaned_lines, cosine, jaccard, normalized, overlap, snippet, trigrams
from docmill.operators.texts import chunks, pages


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_normalized_and_trigrams(spark):
    assert one(spark, normalized(F.col("t")), t=" Straße  A ") == "strasse a"
    assert one(spark, trigrams(F.col("t")), t="ababa") == ["aba", "bab"]
    assert one(spark, trigrams(F.col("t")), t="ab") == ["ab"] and one(spark, trigrams(F.col("t")), t="") == []


def test_lines(spark):
    assert one(spark, cleaned_lines(F.col("t")), t=" a \t b\r\n\n  \nc") == "a b\nc"


def test_set_measures(spark):
    a, b, none = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y")), F.array().cast("array<string>")
    assert one(spark, overlap(a, b), t=0) == 0.5 and one(spark, jaccard(a, b), t=0) == 0.5
    assert one(spark, overlap(none, none), t=0) == 0 and one(spark, jaccard(none, none), t=0) == 1


def test_cosine(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, cosine(v(1, 0), v(2, 0)), t=0) == 1 and one(spark, cosine(v(1, 0), v(0, 0)), t=0) == 0 and one(spark, cosine(v(1), v(1, 2)), t=0) == 0


def test_snippet(spark):
    text = "a" * 200 + " Needle " + "b" * 200
    got = one(spark, snippet(F.col("t"), F.lit("needle")), t=text)
    assert got.startswith("...") and got.endswith("...") and "Needle" in got and len(got) < 200
    assert one(spark, snippet(F.col("t"), F.lit("zzz")), t="short") == "short"


def test_pages_and_chunks(spark):
    docs = spark.createDataFrame([(1, "ab\n\ncd"), (2, "x" * 1700), (3, "")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in pages(docs).where("doc_id = 1").orderBy("page").collect()] == [(1, 0, 2), (3, 6, 8)]
    got = chunks(docs).where("doc_id = 2").orderBy("chunk_index").collect()
    assert [(r.start_offset, r.end_offset) for r in got] == [(0, 900), (750, 1650), (1500, 1700)]
    assert chunks(docs).where("doc_id = 3").count() == 0
