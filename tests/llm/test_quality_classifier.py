import random
import zlib

from docmill.llm.quality_classifier import classify_quality, fit, score_quality
from tests.llm.helpers import corpus, frame, words


def labelled(rng, n):
    rows, marks = [], []
    for i in range(n):
        good = i % 4 != 0
        rows.append((i, words(rng, 120, 900) if good else " ".join(w.upper() + "!!" for w in words(rng, 120, 900).split())))
        marks.append((i, int(good), 0))
    return rows, marks


def test_held_out_accuracy(spark):
    rows, marks = labelled(random.Random(3), 400)
    docs, labels = frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = classify_quality(docs, labels).collect()
    assert len(got) == len(rows)
    want = {i: q for i, q, _ in marks}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == want[r.doc_id] for r in held) >= 0.97 * len(held)


def test_held_out_labels_are_not_learnt(spark):
    rows, marks = labelled(random.Random(3), 90)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in marks]
    schema = "doc_id long, quality int, toxic int"
    a, b = (sorted(tuple(r) for r in classify_quality(frame(spark, rows), spark.createDataFrame(x, schema)).collect()) for x in (marks, flipped))
    assert a == b


def test_odd_rows(spark):
    schema = "doc_id long, quality int, toxic int"
    rows = corpus()
    marks = [(i, k % 2 if k % 5 else None, 0) for k, (i, _) in enumerate(rows)]
    got = classify_quality(frame(spark, rows), spark.createDataFrame(marks, schema)).collect()
    assert len(got) == len(rows) and all(r.score is not None for r in got)
    assert classify_quality(frame(spark, []), spark.createDataFrame([], schema)).count() == 0
    one = fit(frame(spark, rows), spark.createDataFrame([(i, 1, 0) for i, _ in rows[:9]], schema))
    assert {r.score > 0.5 for r in score_quality(frame(spark, rows), one).collect()} == {True}


def test_repeated_ids_have_one_text_and_no_contradiction(spark):
    rows, marks = labelled(random.Random(5), 120)
    schema = "doc_id long, quality int, toxic int"
    marks += [(7, 1 - marks[7][1], 0)]  # contradicts: left out
    rows += [(9, "zzz later text"), (9, "~ even later")]
    plain = fit(frame(spark, [r for r in rows[:120] if r[0] != 7]), spark.createDataFrame([m for m in marks if m[0] != 7], schema))
    for shuffled in (rows, rows[::-1]):
        got = fit(frame(spark, [(i, t) for i, t in shuffled if i != 9 or t == min(x for j, x in rows if j == 9)]).repartition(5), spark.createDataFrame(marks, schema))
        again = fit(frame(spark, shuffled).repartition(3), spark.createDataFrame(marks[::-1], schema))
        assert (got.good, got.bad, got.weights) == (again.good, again.bad, again.weights) == (plain.good, plain.bad, plain.weights)
