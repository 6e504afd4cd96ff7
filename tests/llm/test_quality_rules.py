import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from docmill.llm.quality_rules import BLANK, ORDER, SIZE, KneserNey, codes, quality_rules
from tests.llm.helpers import corpus, frame, words


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = (text or "").split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:k] for k, x in enumerate(lines))
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(three)
    again = {i + k for i, x in enumerate(three) if n[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again)


def test_base_against_brute_force(spark):
    rows = corpus(n=50) + [(3000, "a b c\na b c\n a b c\n\n\n# $5 <b> |\n" * 3), (3001, "x\x85y z w \x1c q")]
    got = quality_rules(frame(spark, rows)).collect()
    want = Counter((-1 if i is None else i, *(b := brute(t)), b[0] < 50 or 100 * b[4] > 50 * b[0]) for i, t in rows)
    assert Counter((-1 if r.doc_id is None else r.doc_id, *r[1:7]) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got) and all((r.perplexity is None) == (r.n_words == 0) for r in got)
    assert quality_rules(frame(spark, [])).count() == 0


def test_noise_is_rejected_and_prose_kept(spark):
    rng = random.Random(5)
    common = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(common) for _ in range(150))) for i in range(300)]
    noise = [(1000 + i, " ".join("".join(rng.choice("qxzjkvw#$%0123") for _ in range(7)) for _ in range(90))) for i in range(5)]
    got = {r.doc_id: r for r in quality_rules(frame(spark, rows + noise)).collect()}
    assert sum(got[i].kept for i, _ in rows) >= 297 and not any(got[i].kept for i, _ in noise)


def test_each_language_and_script_has_its_own_band(spark):
    rng = random.Random(8)
    rows, noise = [], []
    for k, (lang, letters) in enumerate([("he", "אבגדהוזחטיכלמנסעפצקרשת"), ("ru", "абвгдежзийклмнопрстуфхцчшщъыьэюя"), (None, "abcdefghijklmnopqrstuvwxyz")]):
        syllables = [a + b for a in letters[::2] for b in letters[1::5]]
        common = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(250)]
        rows += [(1000 * k + i, " ".join(rng.choice(common) for _ in range(150)), lang) for i in range(150)]
        noise += [(1000 * k + 900 + i, " ".join("".join(rng.choice(letters) for _ in range(9)) for _ in range(90)), lang) for i in range(3)]
    docs = spark.createDataFrame([(i, t, lang, "src0") for i, t, lang in rows + noise], "doc_id long, text string, lang string, source string")
    for languages in (32, 1):  # one pass, and three
        got = {r.doc_id: r for r in quality_rules(docs, languages=languages).collect()}
        assert len(got) == len(rows + noise)
        assert sum(got[i].kept for i, _, _ in rows) >= len(rows) - 9 and not any(got[i].kept for i, _, _ in noise)


def exact(texts, text):
    """The log10 probability of each character by an interpolated modified Kneser-Ney model of nested dictionaries."""
    def grams(k):
        return Counter(tuple(x[i : i + k]) for x in padded for i in range(ORDER - k, len(x) - k + 1))

    fold = lambda t: [BLANK] * (ORDER - 1) + [int(c) & SIZE - 1 for c in codes(t)]
    padded = [fold(t) for t in texts]
    counts = {ORDER: grams(ORDER)}
    for k in range(ORDER - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    follow = {k: defaultdict(dict) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            follow[k][g[:-1]][g[-1]] = n

    def discount(k, n):
        of = [sum(x == j for x in counts[k].values()) for j in range(1, 5)]
        y = of[0] / (of[0] + 2 * of[1]) if of[0] else 0.5
        j = min(n, 3)
        d = j - (j + 1) * y * of[j] / of[j - 1] if of[j - 1] else j * 0.5
        return min(max(d, 0.05 * j), 0.95 * j)

    def p(context, c):
        k = len(context) + 1
        lower = p(context[1:], c) if k > 1 else 1 / SIZE
        seen = follow[k].get(context)
        if not seen:
            return lower
        total = sum(seen.values())
        weight = sum(discount(k, n) for n in seen.values()) / total
        return max(seen.get(c, 0) - discount(k, seen[c]) if c in seen else 0, 0) / total + weight * lower

    x = fold(text)
    return [math.log10(p(tuple(x[i - ORDER + 1 : i]), x[i])) for i in range(ORDER - 1, len(x))]


def test_perplexity_against_brute_force(spark):
    rows = [(i, words(random.Random(i), 60, 40)) for i in range(6)] + [(9, "Zebra! 12 שלום עולם " * 15)]
    got = {r.doc_id: r.perplexity for r in quality_rules(frame(spark, rows)).collect()}
    for i, t in rows:
        want = exact([t for _, t in rows], t)
        assert math.isclose(math.log10(got[i]), -sum(want) / len(want), abs_tol=1e-4)


def test_probabilities_add_up_to_one():
    text = codes(words(random.Random(1), 3000))
    code, n = np.unique(text, return_counts=True)
    table = KneserNey.of(code, n).of_codes(np.arange(SIZE**ORDER)).astype(float)
    sums = (10**table).reshape(-1, SIZE).sum(axis=1)
    assert len(table) == SIZE**ORDER and np.allclose(sums, 1, atol=1e-4)
