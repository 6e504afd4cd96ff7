import hashlib
from collections import defaultdict

import pytest

from docmill.llm import line_dedup
from docmill.llm.line_dedup import LineRuns, drop_frequent_lines
from tests.llm.helpers import corpus, frame

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, min_docs):
    docs = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            docs[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not key(x) or len(docs[key(x)]) < min_docs]
        out.append((-1 if i is None else i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "MOST_BROADCAST", most)
    rows = corpus(n=50) + [(None, f"null {i} \n Null Line") for i in range(12)] + [(70, "long line " * 50000 + "\n" + "L\n" * 20000), (71, "\x00\n\tÉ \n")]
    for least, batches in ((3, 1), (3, 9), (10, 4)):
        got = drop_frequent_lines(frame(spark, rows), least, batches, 2).collect()
        assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == brute(rows, least)


def test_empty_table(spark):
    assert drop_frequent_lines(frame(spark, [])).count() == 0


def test_levels_are_compacted_and_closed_hashes_leave(spark):
    runs = LineRuns(spark, min_docs=2, fanout=3)
    for b in range(7):
        runs.add(spark.createDataFrame([(2 * b, b"hot"), (2 * b + 1, b"hot"), (b, bytes([b]))], "doc_id long, hash binary"))
    assert [len(x) for x in runs.levels] == [1, 2]
    totals = {bytes(r.hash): r.n_docs for r in runs.totals().collect()}
    assert totals[b"hot"] == 2 and len(totals) == 8  # closed by the first batch, so later ones add nothing to it


def test_a_batch_joins_the_runs_without_shuffling_them(spark):
    runs = LineRuns(spark, min_docs=2, fanout=4)
    batch = spark.createDataFrame([(1, b"hot"), (2, b"cold")], "doc_id long, hash binary")
    for _ in range(3):
        runs.add(batch)
    plan = runs.fresh(batch)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1  # the batch; the runs are read in their order
    assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange hashpartitioning") == 2  # both of the batch alone


def test_a_store_opens_again_by_its_folder(spark, tmp_path):
    batch = lambda b: spark.createDataFrame([(b, b"hot"), (b, bytes([b]))], "doc_id long, hash binary")
    path = str(tmp_path / "runs")
    first = LineRuns(spark, path, min_docs=3, fanout=2, buckets=3)
    for b in range(3):
        first.add(batch(b))
    for run in first.runs:
        spark.sql(f"DROP TABLE {run}")  # as in a new session; the files stay
    again = LineRuns(spark, path, min_docs=3, fanout=2)
    assert again.levels == first.levels and again.buckets == 3
    assert [bytes(r.hash) for r in again.closed().collect()] == [b"hot"]
    again.add(batch(9))
    totals = {bytes(r.hash): r.n_docs for r in LineRuns(spark, path, min_docs=3).totals().collect()}
    assert totals == {b"hot": 3, bytes([0]): 1, bytes([1]): 1, bytes([2]): 1, bytes([9]): 1}


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_hot_and_rare_lines_are_both_found(spark, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "MOST_BROADCAST", most)
    # over 2^14 lines: "shared" is a hot hash in them, "pair 7" and the like are not
    rows = [(i, "\n".join(["shared", f"pair {i // 3}", *(f"{i} {j}" for j in range(60))])) for i in range(600)]
    got = drop_frequent_lines(frame(spark, rows), min_docs=3).collect()
    assert {r.n_dropped for r in got} == {2} and len(got) == 600


def test_hash_of_the_kept_text(spark):
    got = drop_frequent_lines(frame(spark, [(1, None)])).first()
    assert got.kept_text == "" and got.n_lines == 1 and hashlib.sha256(b"").hexdigest()
