"""The divergence of sources against a brute force, and odd inputs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from docmill.llm import source_divergence as sd
from tests.llm.helpers import SCHEMA

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        mine = [s for x, s in groups if x == lang]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in mine}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 5) // (total[s] + 5 * len(kept)) for t in kept} for s in mine}
        q = {t: 1 + 10**9 * (sum(counts[lang, s][t] for s in mine) + 5) // (sum(total.values()) + 5 * len(kept)) for t in kept}
        pairs = sorted((-sum(abs(p[source][t] - p[s][t]) for t in kept), s.encode()) for s in mine if s != source)
        terms = sorted((q[t] - p[source][t], t.encode()) for t in kept if counts[lang, source][t] and p[source][t] > q[t])[:top]
        out += [(lang, source, part, i.decode(), -v, k + 1) for part, x in (("pair", pairs), ("term", terms)) for k, (v, i) in enumerate(x)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, s, 1, "h", 1, "y", "z", "w") for i, x, s, t in rows], SCHEMA)


def corpus(seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(90):
        source = rng.choice(["a", "b", "c", "é", None, "Z"])
        words = [f"{rng.choice('abcdefgh')}{'x' * rng.randrange(3)}" for _ in range(rng.randrange(30))] + (["Only" + (source or "")] * 2)
        rows.append((i, rng.choice(["en", "de", None]), source, rng.choice([" ", "-", "1", "\n"]).join(words)))
    return rows + [(200, "en", "empty", None), (201, "en", "empty", ""), (202, "xx", "alone", "word"), (203, "yy", "s", ""), (204, "yy", "t", "1 2"), (None, "en", "a", "É日本 é日本"), (3, "en", "a", "axx"), (3, "en", "a", "axx")]


@pytest.mark.parametrize("least,top", [(5, 50), (1, 3), (1000, 50)])
def test_against_brute_force(spark, monkeypatch, least, top):
    monkeypatch.setattr(sd, "TERMS_PER_BLOCK", 7)
    monkeypatch.setattr(sd, "SOURCES_PER_TILE", 2)
    monkeypatch.setattr(sd, "HELD", 50)
    rows = corpus()
    got = [tuple(r) for r in sd.source_divergence(frame(spark, rows).repartition(3), least, top).collect()]
    assert sorted(got) == brute([r[1:] for r in rows], least, top)


def test_ties_and_a_very_long_text(spark):
    rows = [(i, "en", "abc"[i % 3], "same words here") for i in range(90)] + [(99, "en", "a", "long tale " * 200000)]
    got = [tuple(r) for r in sd.source_divergence(frame(spark, rows)).collect()]
    assert sorted(got) == brute([r[1:] for r in rows], 30, 50)


def test_an_empty_table(spark):
    assert sd.source_divergence(frame(spark, [])).collect() == []


def test_shares_of_huge_counts():
    counts = np.array([0, 1, 10**12, 9 * 10**14])
    total, terms = 9 * 10**14 + 10**12 + 1, 10**6
    assert sd.shares(counts, total, terms).tolist() == [1 + 10**9 * (int(c) + 5) // (total + 5 * terms) for c in counts]
