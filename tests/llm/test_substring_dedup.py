import random
import re
from collections import defaultdict

import numpy as np

from docmill.llm import seeds, substring_dedup
from docmill.llm.hashing import Spans, sliding_min
from docmill.llm.substring_dedup import drop_repeated_words, extended
from tests.llm.helpers import corpus, frame, words


def brute(rows, window):
    none = lambda i: -1 if i is None else i
    texts = [(none(i), re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in texts:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (i, s):
                gone[s : s + window] = [True] * window
        out.append((i, " ".join(x for x, g in zip(w, gone) if not g), len(w), sum(gone)))
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    rows = corpus(n=60)
    for window, seed_words, block in ((20, 5, 1 << 21), (20, 5, 900), (7, 3, 2000)):
        monkeypatch.setattr(substring_dedup, "BLOCK", block)
        got = drop_repeated_words(frame(spark, rows).repartition(3), window, seed_words, 20).collect()
        assert sorted((-1 if r[0] is None else r[0], *r[1:4]) for r in got) == brute(rows, window)
        assert all(sum(s.words for s in r.spans) == r.n_removed for r in got)
    assert sum(x[3] for x in brute(rows, 20)) > 500


def test_hot_anchors(spark, monkeypatch):
    rng = random.Random(3)
    line = [f"w{k}" for k in range(27)]
    rows = [(i, " ".join([rng.choice("abc") for _ in range(rng.randrange(18))] + line[: rng.choice([12, 19, 20, 27])] + [rng.choice("xy")] * 9)) for i in range(150)]
    monkeypatch.setattr(seeds, "HOT", 5)
    monkeypatch.setattr(substring_dedup, "BLOCK", 2000)
    monkeypatch.setattr(substring_dedup, "OCCURRENCES", 40)
    got = drop_repeated_words(frame(spark, rows), filter_bits=20).collect()
    assert sorted(tuple(r[:4]) for r in got) == brute(rows, 20)


def test_words_that_collide_and_very_long_texts(spark):
    thue = ["a"]
    while len(thue) < 2048:
        thue += ["b" if x == "a" else "a" for x in thue]
    one, other = "".join(thue), "".join("b" if x == "a" else "a" for x in thue)
    rest = " ".join(f"w{k}" for k in range(19))
    long = words(random.Random(4), 300_000, 90_000)  # more than two blocks
    rows = [(1, f"{one} {rest}"), (2, f"{other} {rest}"), (3, f"{one} {rest}"), (4, f"{long} {one} {rest}"), (5, f"tail {long[-900_000:]}")]
    got = {r.doc_id: r for r in drop_repeated_words(frame(spark, rows), filter_bits=22).collect()}
    assert [got[i].n_removed for i in (1, 2, 3, 4)] == [0, 0, 20, 20]
    assert got[5].n_removed >= len(long[-900_000:].split()) - 1
    assert got[4].spans[0].start == 300_000


def test_matches_are_extended_both_ways():
    # one anchor "x y", windows of four words; the occurrences differ to the left or to the right
    texts = [b"p q x y r s ", b"p q x y t u ", b"m q x y r s "]
    three = np.array([2, 2, 2])
    found = {(d, s) for doc, start in extended(np.zeros(3, np.uint64), np.arange(3), three, three, three + 2, texts, 4) for d, s in zip(doc.tolist(), start.tolist())}
    assert found == {(1, 0), (2, 1), (2, 2)}


def test_empty_table(spark):
    assert drop_repeated_words(frame(spark, [])).count() == 0


def test_a_full_filter_changes_nothing(spark):
    rows = corpus(n=30)
    got = drop_repeated_words(frame(spark, rows), 20, 5, 19).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:4]) for r in got) == brute(rows, 20)


def test_span_hashes():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 4, 400).astype(np.uint8)
    spans = Spans(x)
    seen = defaultdict(set)
    for a in range(0, 380):
        for n in (0, 1, 3, 7):
            seen[int(spans.of(np.array([a]), np.array([a + n]))[0])].add(bytes(x[a : a + n]))
    assert all(len(v) == 1 for v in seen.values())
    assert (spans.rolling(7) == spans.of(np.arange(394), np.arange(394) + 7)).all()


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 99, 50)
    for w in (1, 2, 5, 13, 50):
        assert (sliding_min(x, w) == [x[i : i + w].min() for i in range(51 - w)]).all()
    assert len(sliding_min(x, 51)) == 0
