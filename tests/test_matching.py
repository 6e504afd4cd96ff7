"""Joins by likeness against brute force: near vectors, edits, aliases, one-to-one matches; odd rows."""

import random

import numpy as np
import pytest

from docmill.operators import matching as m

VECTORS = "id long, grp string, place double, embedding array<double>"


def sequential(rows, threshold):
    """The pass in order."""
    unit = {i: np.array(x) / np.linalg.norm(x) for i, _, _, x in rows if x and any(x)}
    kept = []
    for i, g, place, x in sorted(rows, key=lambda r: (r[2], r[0])):
        if i not in unit or not any(g == h and len(x) == len(unit[j]) and round(float(unit[i] @ unit[j]), 6) >= threshold for j, h in kept if j in unit):
            kept.append((i, g))
    return {i for i, _ in kept}


@pytest.mark.parametrize("tile", [1024, 3])
def test_collapse_is_the_greedy_pass(spark, monkeypatch, tile):
    monkeypatch.setattr(m, "TILE", tile)
    rng = np.random.default_rng(1)
    rows = [(i, f"g{i % 3}", float(rng.integers(0, 5)), rng.normal(size=3).tolist()) for i in range(90)]
    # a chain: each is near the next one only, so that every other one stays
    rows += [(200 + i, "chain", float(i), [float(np.cos(i * 0.2)), float(np.sin(i * 0.2))]) for i in range(9)]
    rows += [(300, "g0", 0.0, None), (301, "g0", 0.0, []), (302, "g0", 0.0, [0.0, 0.0, 0.0]), (303, None, 0.0, [1.0, 0.0, 0.0]), (304, None, 1.0, [2.0, 0.0, 0.0])]
    got = {r.id for r in m.collapse_near(spark.createDataFrame(rows, VECTORS), 0.965).where("kept").collect()}
    assert got == sequential(rows, 0.965)
    assert {i for i in got if 200 <= i < 300} == {200, 202, 204, 206, 208} and 304 not in got
    assert m.collapse_near(spark.createDataFrame([], VECTORS)).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_every_pair_within_the_edits_is_found(spark, most):
    rng = random.Random(most)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(0, 7)))
    known, cited = {word() for _ in range(60)}, {word() for _ in range(60)} | {"", "a"}
    frame = lambda x: spark.createDataFrame([(i,) for i in [*x, None]], "id string")
    got = {(r.id, r.known, r.edits) for r in m.within_edits(frame(cited), frame(known), most).collect()}
    assert got == {(a, b, levenshtein(a, b)) for a in cited for b in known if levenshtein(a, b) <= most}


def test_repairs(spark):
    known = spark.createDataFrame([("abcdefgh",), ("ijklmnop",), ("ijklmnoz",)], "id string")
    cited = [(1, "Xbcdefgh"), (1, "abcdefgh"), (2, "Xijklmnop"), (2, "ijklmno"), (3, "qqq"), (4, None), (5, "bacdefgh")]
    got = {(r.answer, r.id): (r.repaired, r.edits, r.accepted) for r in m.repair_ids(spark.createDataFrame(cited, "answer int, id string"), known).collect()}
    assert got == {
        (1, "Xbcdefgh"): ("abcdefgh", 1, True), (1, "abcdefgh"): ("abcdefgh", 0, True), (2, "Xijklmnop"): ("ijklmnop", 1, False), (2, "ijklmno"): (None, 1, False),
        (3, "qqq"): (None, -1, False), (4, None): (None, -1, False), (5, "bacdefgh"): ("abcdefgh", 2, True),
    }


NODES = "id long, label string, kind string, parent string"


def test_alias_rules(spark):
    # a kind of its own for each rule
    rows = [
        (1, "education committee", "same", None), (2, "education committee", "same", "root"),
        (3, "budget committee 2024", "numbers", "root"), (4, "budget committee 2025", "numbers", "root"),
        (5, "sports centre", "one", "root"), (6, "sports centre", "other", "root"),
        (7, "town hall roof works", "parents", "x"), (8, "town hall roof works", "parents", "y"),
        (9, "dept of roads and bridges", "short", None), (10, "department of roads and bridges", "short", None),
        (11, "the new city library building", "close", None), (12, "the new city library buildings", "close", None),
        (13, None, "close", None), (14, "", "close", None), (15, "a b", None, None), (16, "the new city library building", "close", None),
    ]
    nodes = spark.createDataFrame(rows, NODES)
    got = {(r.left_id, r.right_id): (r.score, r.action) for r in m.alias_pairs(nodes, m.ABBREVIATIONS).collect()}
    assert got == {(1, 2): (1.0, "auto_merge")}
    assert {(r.id, r.of) for r in m.alias_members(nodes).collect() if r.id != r.of} == {(16, 11)}


def test_no_alias_pair_is_missed(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(12)] + ["7", "8", "dept", "department"]
    rows = []
    for i in range(120):
        words = rng.sample(vocabulary, rng.randrange(5, 10))
        rows.append((2 * i, " ".join(words), "kind", rng.choice([None, "p", "q"])))
        words = words[:]
        rng.shuffle(words) if i % 2 else words.__setitem__(0, "dept" if words[0] == "department" else "department" if words[0] == "dept" else words[0])
        rows.append((2 * i + 1, " ".join(words), "kind", rng.choice([None, "p"])))

    def score(a, b):
        jac = lambda x, y: len(x & y) / len(x | y) if x | y else 0.0
        grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
        wide = lambda t: " ".join(m.ABBREVIATIONS.get(w, w) for w in t.split())
        x, y = ({w for w in t.split() if w.isdigit()} for t in (a, b))
        if x and y and x != y:
            return 0
        return round(0.05 * (a == b) + 0.4 * jac(set(a.split()), set(b.split())) + 0.3 * jac(grams(a), grams(b)) + 0.15 * (wide(a) == wide(b)) + 0.1 * (0.5 if bool(x) != bool(y) else 1) + 1e-9, 6)

    reps = {}
    for i, label, kind, parent in rows:
        reps.setdefault((label, parent), i)
    want = {}
    items = sorted((i, label, parent) for (label, parent), i in reps.items())
    for k, (i, a, p) in enumerate(items):
        for j, b, q in items[k + 1 :]:
            if (p is None or q is None or p == q) and (s := score(a, b)) >= 0.85:
                want[i, j] = s
    got = {(r.left_id, r.right_id): r.score for r in m.alias_pairs(spark.createDataFrame(rows, NODES), m.ABBREVIATIONS).collect()}
    assert got == want and len(want) > 10


def test_one_to_one_is_the_pass(spark):
    rng = random.Random(6)
    words = ["red", "blue", "sky", "sea", "a", "bb"]
    side = lambda n: [(g, k, " ".join(rng.choices(words, k=rng.randrange(0, 5)))) for g in ("x", "y", "z") for k in range(n)]
    expected, predicted = side(12), side(10) + [("w", 0, "red")]

    def passed(least):
        out = set()
        for g in "xyz":
            used = set()
            for _, e, x in [r for r in expected if r[0] == g]:
                best = None
                for _, p, y in [r for r in predicted if r[0] == g and r[1] not in used and r[2]]:
                    if x in y or y in x:
                        best = (1.0, p)
                        break
                    a, b = set(x.split()), set(y.split())
                    o = len(a & b) / max(len(a), len(b), 1)
                    if o >= least and (best is None or o > best[0]):
                        best = (o, p)
                if best:
                    used.add(best[1])
                    out.add((g, e, best[1]))
        return out

    frame = lambda rows: spark.createDataFrame(rows, "grp string, at long, sig string")
    got = {tuple(r) for r in m.one_to_one(m.candidate_matches(frame(expected), frame(predicted), 0.65)).collect()}
    assert got == passed(0.65) and len(got) > 15
    assert m.one_to_one(m.candidate_matches(frame([]), frame(predicted), 0.65)).count() == 0


@pytest.mark.parametrize("most", [512, 5])
def test_copies_in_a_conversation_make_no_rounds_and_no_pairs_of_copies(spark, monkeypatch, tmp_path, most):
    monkeypatch.setattr(m, "SENTENCES", most)
    monkeypatch.setattr(m, "lasting", lambda df: pytest.fail("a round"))
    pairs, passed = [], m.one_to_one
    monkeypatch.setattr(m, "one_to_one", lambda x, *copies: pairs.append(x) or passed(x, *copies))
    rng = random.Random(3)
    texts = lambda n: ". ".join(rng.choice(["yes", "no", "yes we do", "do it now", "not now or here", "now"]) for _ in range(n))
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", texts(14)) for c in (1, 2) for t in range(8)] + [(None, 0, "user", "yes"), (None, 1, "assistant", "yes"), (3, 0, "user", "yes"), (4, 0, "system", "no"), (4, 1, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = set()
    for c in (1, 2):
        said = [(t * 1000 + k, r, x.strip()) for g, t, r, text in rows if g == c for k, x in enumerate(text.split("."))]
        used = set()
        for e, x in [(at, x) for at, r, x in said if r == "user"]:
            best = None
            for p, y in [(at, y) for at, r, y in said if r == "assistant" and at not in used]:
                a, b = set(x.split()), set(y.split())
                inside, o = x in y or y in x, len(a & b) / max(len(a), len(b))
                if (inside or o >= 0.5) and (best is None or (not inside, -o * (not inside), p) < best):
                    best = (not inside, -o * (not inside), p)
            if best:
                used.add(best[2])
                want.add((c, e, best[2]))
    assert {tuple(r) for r in m.match_pairs(spark, str(tmp_path)).collect()} == want and len(want) > 60
    assert pairs[0].count() <= 2 * 56 * 6  # 112 sentences of users, six different ones of assistants
    assert {(r.conv_id, r.matched) for r in m.match_scores(spark, str(tmp_path)).where("conv_id < 3").collect()} == {(c, sum(x[0] == c for x in want)) for c in (1, 2)}


def test_parts_of_ids_are_never_broadcast(spark, tmp_path):
    spark.createDataFrame([(f"id{i:06d}",) for i in range(50)] + [(None,)], "id string").write.parquet(f"{tmp_path}/ids")
    ids = spark.read.parquet(f"{tmp_path}/ids")
    pairs = m.within_edits(ids, ids)
    assert "Broadcast" not in pairs._jdf.queryExecution().toString()  # the file is small, its ids' parts need not be
    assert {(r.id, r.known): r.edits for r in pairs.collect()} == {(a, b): n for a, b, n in ((f"id{i:06d}", f"id{j:06d}", levenshtein(f"{i:06d}", f"{j:06d}")) for i in range(50) for j in range(50)) if n <= 2}


def test_marks_of_words_meet_wherever_three_quarters_are_shared_and_seldom_elsewhere(spark):
    rng = random.Random(12)
    sets = []
    for size in (1, 2, 3, 4, 5, 7, 8, 9, 12, 13, 15, 16, 17, 20, 24):
        for _ in range(12):
            words = set(rng.sample(range(60), size))
            sets += [words, words ^ {rng.randrange(60)}, {*list(words)[1:], rng.randrange(60)}, words | {*rng.sample(range(60), size // 3)}]
    sets = [sorted(x) for x in sets if x]
    rows = m._marked(spark.createDataFrame(list(enumerate(sets)), "id int, words array<long>")).collect()
    marks = [{} for _ in sets]
    for r in rows:
        marks[r.id][r.mark] = (r.held, r.rest)
    near = far = met = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            like = len({*a} & {*b}) / len({*a} | {*b})
            if like >= m.LEAST_WORDS:
                near += 1
                both = marks[i].keys() & marks[j].keys()
                assert any(marks[i][k][0] + min(marks[i][k][1], marks[j][k][1]) >= len({*a} & {*b}) for k in both), (a, b)
            elif len(a) <= m.LONG and len(b) <= m.LONG and min(len(a), len(b)) > m.TOGETHER:
                far += 1
                met += bool(marks[i].keys() & marks[j].keys())
    assert near > 300 and met < far / 50
    assert max(map(len, marks)) == 35 + 5  # of 16 words


@pytest.mark.parametrize("head,dense", [(8, True), (3, False), (1, False)])
def test_collapse_in_steps_is_the_pass_without_all_pairs(spark, monkeypatch, head, dense):
    monkeypatch.setattr(m, "HEAD", head)
    monkeypatch.setattr(m, "TILE", 16)
    monkeypatch.setattr(m, "AT_ONCE", 5)
    monkeypatch.setattr(m, "FEW", -1 if dense else 1)
    if dense:
        monkeypatch.setattr(m, "near_pairs", lambda *_: pytest.fail("all near pairs"))
    rng = np.random.default_rng(head)
    size = lambda i: 3 if i % 4 else 2
    rows = [(i, None if i % 3 == 2 else f"g{i % 3}", float(rng.integers(0, 9)), (rng.normal(size=size(i)) + 0.5).tolist()) for i in range(240)]
    rows += [(300 + i, "g0", 1.0, [1.0, 1.0, 1.0]) for i in range(30)] + [(400 + i, "g0", -1.0, [[0.0], [], None, [1.0, None]][i % 4]) for i in range(20)]
    threshold = 0.6 if dense else 0.97
    got = {r.id for r in m.collapse_near(spark.createDataFrame(rows, VECTORS), threshold).where("kept").collect()}
    assert got == sequential([r for r in rows if r[0] < 400], threshold) | {*range(400, 420)}
