import random

import numpy as np

from docmill.llm import seeds, suffix_array
from docmill.llm.suffix_array import OUTSIDE, drop_repeated_bytes, lcp_intervals, maximal_repeats
from tests.llm.helpers import corpus, frame


def brute(rows, length):
    texts = [(-1 if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in texts:
        for s in range(len(b) - length + 1):
            first[b[s : s + length]] = min(first.get(b[s : s + length], i), i)
    out = []
    for i, b in texts:
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < i:
                gone[s : s + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, bytes(x for x, g in zip(b, gone) if not g), len(b), sum(gone), spans))
    return sorted(out)


def plain(got):
    return sorted((-1 if r[0] is None else r[0], bytes(r[1]), *r[2:]) for r in got)


def test_against_brute_force(spark, monkeypatch):
    rows = corpus(n=60)
    for length, gram, block, most in ((50, 24, 1 << 21, 1 << 15), (50, 24, 700, 60), (20, 8, 5000, 500)):
        monkeypatch.setattr(suffix_array, "BLOCK", block)
        monkeypatch.setattr(suffix_array, "SUFFIXES", most)
        assert plain(drop_repeated_bytes(frame(spark, rows).repartition(3), length, gram, 20).collect()) == brute(rows, length)
    assert sum(x[3] for x in brute(rows, 50)) > 5000


def test_hot_beginnings(spark, monkeypatch):
    rng = random.Random(6)
    line = "a line that stands in nearly every document of the table, as it were"
    rows = [(i, "".join(rng.choice("abcde ") for _ in range(rng.randrange(80))) + line[: rng.choice([40, 49, 55, 69])] + rng.choice("xyz") * 9) for i in range(220)]
    monkeypatch.setattr(seeds, "HOT", 5)
    monkeypatch.setattr(suffix_array, "BLOCK", 2000)
    assert plain(drop_repeated_bytes(frame(spark, rows), filter_bits=20).collect()) == brute(rows, 50)


def test_empty_table(spark):
    assert drop_repeated_bytes(frame(spark, []), filter_bits=20).count() == 0


def test_intervals():
    # banana's suffixes: a, ana, anana, banana, na, nana
    assert sorted(lcp_intervals([0, 1, 3, 0, 0, 2], 1)) == [(1, 0, 2), (2, 4, 5), (3, 1, 2)]


def test_maximal_repeats_have_all_occurrences():
    text = b"xxabcdefgh1 yyabcdefgh2 xxabcdefgh3 zabcd"
    left, length = 4, 6
    places = [i for i in range(len(text)) if text[i : i + 4] == b"abcd"]
    padded = bytes([OUTSIDE]) * left + text + bytes([OUTSIDE]) * length
    context = np.array([list(padded[i : i + left + length]) for i in places], np.uint8)
    found = set()
    for group, row, before, after in maximal_repeats(context, left, length, 4):
        for g in set(group.tolist()):
            at = group == g
            r, b, a = row[at], before[at], after[at]
            strings = {text[places[i] - x : places[i] + y] for i, x, y in zip(r.tolist(), b.tolist(), a.tolist())}
            assert len(strings) == 1
            found.add((strings.pop(), len(r)))
    assert found == {(b"abcdef", 3), (b"xxabcdef", 2), (b" xxabcdef"[1:], 2)}
