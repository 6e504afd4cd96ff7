import math
import random
from collections import Counter, defaultdict

import numpy as np

from docmill.llm import char_model
from docmill.llm.char_model import ORDER, PAD, distinct, stream
from docmill.llm.quality_rules import codes, quality_rules
from tests.llm.helpers import frame, words


def test_letters_of_one_class_are_told_apart(spark):
    rng = random.Random(4)
    letters = [chr(0x4E00 + rng.randrange(3000)) for _ in range(300)]
    common = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 4))) for _ in range(200)]
    rows = [(i, " ".join(rng.choice(common) for _ in range(120))) for i in range(200)]
    other = lambda c: chr(ord(c) + 26 * rng.randrange(1, 40)) if c > " " else c
    noise = [(1000 + i, "".join(map(other, rows[i][1]))) for i in range(4)]
    assert all((codes(rows[i][1]) == codes(t)).all() for i, (_, t) in enumerate(noise))  # 32 classes can't tell these from prose
    got = {r.doc_id: r for r in quality_rules(frame(spark, rows + noise)).collect()}
    assert sum(got[i].kept for i, _ in rows) >= 190 and not any(got[i].kept for i, _ in noise)


def exact(texts, text, letters):
    """The log10 probability of each code point of text by an interpolated modified Kneser-Ney model of texts."""
    counts = {ORDER: Counter(x[i : i + ORDER] for t in texts for x in [PAD + t] for i in range(len(t)))}
    for k in range(ORDER - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    follow = defaultdict(dict)
    for c in counts.values():
        for g, n in c.items():
            follow[g[:-1], len(g)][g[-1]] = n
    discounts = {}
    for k, c in counts.items():
        of = [sum(n == j for n in c.values()) for j in range(1, 5)]
        y = of[0] / (of[0] + 2 * of[1]) if of[0] else 0.5
        d = [j - (j + 1) * y * of[j] / of[j - 1] if of[j - 1] else j * 0.5 for j in (1, 2, 3)]
        discounts[k] = [0, *(min(max(x, 0.05 * j), 0.95 * j) for j, x in enumerate(d, 1))]

    def p(context, c):
        k = len(context) + 1
        lower = p(context[1:], c) if k > 1 else 1 / letters
        seen = follow.get((context, k))
        if not seen:
            return lower
        d = discounts[k]
        n, total = seen.get(c, 0), sum(seen.values())
        return (n - d[min(n, 3)]) / total + sum(d[min(x, 3)] for x in seen.values()) / total * lower

    return [math.log10(p((PAD + text)[i : i + ORDER - 1], c)) for i, c in enumerate(text)]


def test_letter_perplexity_against_brute_force_in_one_range_or_many(spark):
    rows = [(i, words(random.Random(i), 60, 40)) for i in range(8)] + [(9, "Zebra! 12 שלום עולם 😀\n" * 15), (10, None), (11, "x"), (12, " ")]
    docs = frame(spark, [*rows, rows[3], (3, "another text of that doc_id " * 12)])
    texts = [(r.text, r.half) for r in docs.fillna("", "text").select("text", char_model.fold().alias("half")).collect()]
    half = dict(texts)
    assert {h for _, h in texts} == {0, 1}
    letters = len(set("".join(t for t, _ in texts)))
    want = {}
    for i, t in rows:
        if i != 3 and (t or "").strip():
            logs = exact([x for x, h in texts if h != half[t]], t, letters)
            want[i] = -sum(logs) / len(logs)
    whole = quality_rules(docs).collect()
    for r in whole:
        assert (r.letter_perplexity is None) == (r.n_words == 0)
        if r.doc_id in want:
            assert math.isclose(math.log10(r.letter_perplexity), want[r.doc_id], abs_tol=1e-4)
    parts = quality_rules(docs, held=200).collect()
    key = lambda r: (r.doc_id, r.n_words, r.perplexity or 0)
    for a, b in zip(sorted(whole, key=key), sorted(parts, key=key), strict=True):
        assert a[:8] == b[:8] and (a.letter_perplexity is None or math.isclose(a.letter_perplexity, b.letter_perplexity, rel_tol=1e-9))


def test_counts_of_any_alphabet_are_exact():
    rng = random.Random(2)
    texts = ["".join(chr(rng.choice((0x4E00, 0x20000)) + rng.randrange(9000)) for _ in range(15000)), "", "ab" * 40, "\0\U0010ffff é"]
    halves = [0, 1, 1, 0]
    points, starts, own = stream(texts)
    got = Counter()
    for grams, half, n in distinct(points, own, np.repeat(halves, np.diff(np.append(starts, len(points))))):
        for g, h, k in zip(grams, half, n):
            got["".join(map(chr, g)), int(h)] += int(k)
    assert len(set(texts[0])) > 1 << char_model.PLACE
    assert got == Counter(((PAD + t)[i : i + ORDER], h) for t, h in zip(texts, halves) for i in range(len(t)))
