import random

from docmill.llm.decontamination import Items, best_alignment, code_points, decontaminate, find_contamination, normalised
from tests.llm.helpers import corpus, frame, words


def edits(item, text):
    """The least number of edits of item against any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def changed(rng, text, n):
    x = list(text)
    for _ in range(n):
        i = rng.randrange(len(x))
        x[i : i + 1] = rng.choice([[], ["Q"], [x[i], "Q"]])
    return "".join(x)


def case():
    rng = random.Random(9)
    items = [(k, words(rng, 12, 4000)) for k in range(12)] + [(50, "w17 w"), (51, None), (52, ""), (53, "abcdefgh")]
    items.append((60, items[0][1]))
    rows = corpus(n=20)
    for k in range(36):
        body = changed(rng, items[k % 12][1], k // 4)
        rows.append((2000 + k, f"{words(rng, 20)} {body.upper() if k % 5 == 0 else body}\n{words(rng, 300)}"))
    rows.append((2100, items[3][1]))
    return rows, items


def brute(rows, items, rate=0.1):
    out = set()
    for i, t in rows:
        for k, p in items:
            p = normalised(p or "")
            if p and (n := edits(p, normalised(t or ""))) <= int(rate * len(p)):
                out.add((-1 if i is None else i, k, n))
    return out


def test_against_brute_force(spark):
    rows, items = case()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block in (2_000_000, 200):
        got = find_contamination(frame(spark, rows), benchmark, block_chars=block).collect()
        assert {(-1 if r.doc_id is None else r.doc_id, r.item_id, r.edits) for r in got} == brute(rows, items)
        assert len(got) == len({(r.doc_id, r.item_id) for r in got})


def test_rows_that_stay(spark):
    rows, items = case()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    gone = {i for i, _, _ in brute(rows, items)}
    docs = frame(spark, rows)
    got = decontaminate(docs, benchmark)
    assert got.columns == docs.columns
    want = [-1 if i is None else i for i, _ in rows if (-1 if i is None else i) not in gone]
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got.collect()) == sorted(want)
    assert find_contamination(frame(spark, []), benchmark).count() == 0
    assert decontaminate(docs, benchmark.where("false")).count() == docs.count()


def test_alignment():
    item = code_points("abcdefghij")
    assert best_alignment(item, code_points("xxabcdefghijyy"), 2, 4) == (0, 2, 12)
    assert best_alignment(item, code_points("xxabcdXfghijyy"), 2, 4) == (1, 2, 12)
    assert best_alignment(item, code_points("xxabcdfghijyy"), 2, 4)[0] == 1
    assert best_alignment(item, code_points("abXcdeXfghXij"), 2, 3) is None


def test_random_alignments():
    rng = random.Random(4)
    for _ in range(60):
        item = "".join(rng.choice("abcd") for _ in range(30))
        text = "".join(rng.choice("abcd") for _ in range(rng.randrange(12))) + changed(rng, item, rng.randrange(5)) + "".join(rng.choice("abcd") for _ in range(8))
        got, want = best_alignment(code_points(item), code_points(text), 5, len(text)), edits(item, text)
        assert (got[0] if got else 99) == (want if want <= 5 else 99)
        if got:
            assert edits(item, text[got[1] : got[2]]) == got[0]


def test_short_items_keep_their_budget():
    items = Items([(1, "abcdefgh"), (2, "abcdefghijklmnopqrstuvwxyz"), (3, "abcdefghij"), (4, "xyz")], 8, 0.1)
    assert [(x.q, x.budget, x.needed) for x in items.indexes] == [(3, [0], [1]), (5, [1], [1]), (8, [0, 2], [1, 3])]


def test_short_items_against_brute_force(spark):
    rng = random.Random(12)
    items = [(n, "".join(rng.choice("abcdefghijkl") for _ in range(n))) for n in (1, 3, 7, 8, 9, 10, 12, 15, 19, 20, 21, 23, 29, 30, 31, 39, 40, 47)]
    rows = [(k, "".join(rng.choice("mnopqrst ") for _ in range(20)) + changed(rng, t, e) + "".join(rng.choice("mnopqrst ") for _ in range(20))) for k, (t, e) in enumerate((t, e) for _, t in items for e in range(5))]
    got = find_contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.edits) for r in got} == brute(rows, items)
