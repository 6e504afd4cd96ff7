"""Phrases against a brute force; the quotient filter's round trip; odd inputs."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from docmill.llm import phrases as ph
from tests.llm.helpers import SCHEMA

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    key = lang, tuple(words[i : i + k])
                    f[key] = f.get(key, 0) + 1
    out = {}
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, w), a in cand.items():
        score, _, l, r = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        inside = [b for (x, v), b in cand.items() if x == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if all(100 * b < 80 * a for b in inside):
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top]))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, "s", 1, "h", 1, "y", "z", "w") for i, x, t in rows], SCHEMA)


def texts(seed=2):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "New", "york", "city", "é", "日本", "a" * 70] + [f"w{i}" for i in range(12)]
    rows = []
    for i in range(60):
        body = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "\x00 "]) for _ in range(60))
        rows.append((i, rng.choice(["en", "de", None, ""]), f"new York city hall, {body} NEW york"))
    return rows + [(100, "en", None), (101, "en", ""), (102, "fr", "  . ,"), (None, "en", "new york city hall"), (3, "en", "new york city hall"), (3, "en", "new york city hall")]


@pytest.mark.parametrize("least,top", [(5, 2000), (5, 3), (2, 50)])
def test_against_brute_force(spark, monkeypatch, least, top):
    monkeypatch.setattr(ph, "HELD", 64)
    monkeypatch.setattr(ph, "STRETCH", 100)
    rows = texts()
    docs = frame(spark, rows)
    got = [tuple(r) for r in ph.mine_phrases(docs.repartition(3), least, top).collect()]
    assert sorted(got) == brute([(x, t) for _, x, t in rows], least, top)


def test_repeats_ties_and_a_very_long_text(spark):
    rows = [(1, "en", "b a " * 40), (1, "en", "b a " * 40), (2, "en", "x y. " * 30 + "y x. " * 30), (3, "en", "long tale " * 100000)]
    got = [tuple(r) for r in ph.mine_phrases(frame(spark, rows)).collect()]
    assert sorted(got) == brute([(x, t) for _, x, t in rows], 30, 2000)


@pytest.mark.parametrize("rows", [[], [(1, "en", None)], [(1, "en", "one two")]])
def test_without_phrases(spark, rows):
    assert ph.mine_phrases(frame(spark, rows)).collect() == []


@pytest.mark.parametrize("n", [2, 3, 4])
@pytest.mark.parametrize("bits", [1, 5, 13, 17, 21, 32])
def test_the_filter_loses_nothing(n, bits):
    rng = np.random.default_rng(n * 100 + bits)
    packing = ph.Packing(n, bits)
    ids = [rng.integers(0, 1 << bits, 500, dtype=np.uint64) for _ in range(n)]
    ids = [np.concatenate((x, x[:200], x[:50])) for x in ids]
    left, right = packing.permute(*packing.pack(ids))
    assert all((a == b).all() for a, b in zip(packing.unpack(*packing.restore(left, right)), ids))
    left, right, counts = packing.counted(left, right)
    want = Counter(zip(*(x.tolist() for x in ids)))
    assert Counter(dict(zip(zip(*(x.tolist() for x in packing.unpack(*packing.restore(left, right)))), counts.tolist()))) == want
    bucket_bits = min(3, 2 * packing.half)
    form = ph.QuotientFilter(packing, bucket_bits, 6)
    bucket = packing.quotient(left, right, bucket_bits).astype(int)
    assert (np.diff(bucket) >= 0).all()
    for b in set(bucket.tolist()):
        m = bucket == b
        for x, y in zip(form.read(b, form.write(b, left[m], right[m], counts[m])), (left[m], right[m], counts[m])):
            assert (x == y).all()
    # merging two filters adds their counts
    twice = packing.counted(np.concatenate((left, left[:9])), np.concatenate((right, right[:9])), np.concatenate((counts, counts[:9])))
    assert (twice[2][:9] == 2 * counts[:9]).all() and (twice[2][9:] == counts[9:]).all()


def test_scores_of_huge_counts(spark):
    grams = spark.createDataFrame([([1], 9 * 10**14), ([2], 8 * 10**14), ([1, 2], 7 * 10**14)], "gram array<long>, n long")
    words = spark.createDataFrame([("en", "a", 9 * 10**14, 1), ("en", "b", 8 * 10**14, 2)], "lang string, word string, n long, id long")
    totals = spark.createDataFrame([("en", 10**16)], "lang string, n long")
    row = ph._ranked(grams, words, totals, 10).first()
    assert (row.phrase, row.score) == ("a b", 2000000 * 7 * 10**14 // (17 * 10**14))
