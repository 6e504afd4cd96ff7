"""Language identification: code lengths against a plain coder, held-out accuracy, odd inputs."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from docmill.llm import language_id as lid
from docmill.llm.quality_classifier import remainder
from tests.llm.helpers import SCHEMA, frame

SYLLABLES = {"aa": ["ba", "do", "ki", "lu"], "bb": ["sch", "er", "ung", "ge"], "cc": ["éau", "que", "le", "ça"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def brute_bits(texts, wanted, order=lid.ORDER):
    """The code length of a text by the definition: method C with exclusion, contexts of `order` bytes or fewer."""
    follow = defaultdict(Counter)
    pad = b" " * order
    for t in texts:
        t = pad + t
        for i in range(order, len(t)):
            for k in range(order + 1):
                follow[t[i - k : i]][t[i]] += 1
    bits, t = 0.0, pad + wanted
    for i in range(order, len(t)):
        excluded = set()
        for k in range(order, -1, -1):
            if not (seen := follow.get(t[i - k : i])):
                continue
            left = {s: n for s, n in seen.items() if s not in excluded}
            if not left:
                continue
            whole = sum(left.values()) + len(left)
            if t[i] in left:
                bits += math.log2(whole / left[t[i]])
                break
            bits += math.log2(whole / len(left))
            excluded |= set(left)
        else:
            bits += math.log2(256 - len(follow[b""]))
    return bits


def test_code_lengths_are_those_of_a_plain_coder(monkeypatch):
    monkeypatch.setattr(lid, "BLOCK", 97)
    rng = random.Random(3)
    samples = [[prose(rng, x, rng.randrange(1, 40)).encode() for _ in range(12)] for x in SYLLABLES]
    tables = []
    for texts in samples:
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        tables.append(lid._strings(np.frombuffer(b"".join(texts), np.uint8), at))
    model = lid.ContextTrees.of(list(SYLLABLES), tables)
    wanted = [prose(rng, "aa", 9).encode(), b"", prose(rng, "cc", 30).encode(), b"x", "日本 schéau".encode(), samples[1][0]]
    at = np.concatenate(([0], np.cumsum([len(t) for t in wanted])))
    got = model.lengths(np.frombuffer(b"".join(wanted), np.uint8), at)
    for i, t in enumerate(wanted):
        for j, texts in enumerate(samples):
            assert got[i, j] == pytest.approx(brute_bits(texts, t), rel=1e-5, abs=1e-4)


def test_a_code_is_proper():
    texts = [b"abab acab", b"abba"]
    for context in (b"", b"ab", b"xab ", b"zzzz"):
        whole = sum(2 ** -(brute_bits(texts, context + bytes([b])) - brute_bits(texts, context)) for b in range(256))
        assert whole == pytest.approx(1)


def languages(spark, extra=()):
    rng = random.Random(5)
    rows = [(i, prose(rng, x, rng.randrange(4, 60)), x, "s", 1, "h", 1, "y", "z", "w") for i, x in enumerate(list(SYLLABLES) * 40)]
    return spark.createDataFrame(rows + [(i, t, x, "s", 1, "h", 1, "y", "z", "w") for i, t, x in extra], SCHEMA)


def test_held_out_languages_and_odd_rows(spark, monkeypatch):
    extra = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !?", "bb"), (1003, "éau que", None), (None, "sch er ung", "bb"), (4, "sch er ge", "bb"), (1004, "ungsch er ge " * 40000, "bb"), (1005, None, None)]
    docs = languages(spark, extra)
    trees = lid.fit_trees(docs.where(remainder(4) != 2))
    assert [r.lang for r in trees.orderBy("lang").collect()] == sorted(SYLLABLES)
    found = lid.identify_languages(docs, trees)
    assert found.columns == ["doc_id", "lang_pred", "score"] and found.count() == docs.count()
    got = {(r.doc_id, r.lang_pred): r.score for r in found.collect()}
    assert all(0 <= s <= 1 for s in got.values())
    for i in (1000, 1001, 1002, 1005):
        assert got[i, "und"] == 0
    assert got[1003, "cc"] > 0.3 and (None, "bb") in got and (4, "bb") in got and got[1004, "bb"] > 0.99
    truth = {r.doc_id: r.lang for r in docs.where(remainder(4) == 2).where("doc_id < 120").collect()}
    assert sum((i, x) in got for i, x in truth.items()) >= 0.97 * len(truth)
    # languages one at a time give the same
    monkeypatch.setattr(lid, "TOGETHER", 1)
    order = lambda df: sorted((str(r.doc_id), r.lang_pred, round(r.score, 9)) for r in df.collect())
    assert order(lid.identify_languages(docs, trees)) == order(found)


def test_nothing_to_learn_or_to_read(spark):
    docs = frame(spark, [(1, "ba do"), (2, None)]).withColumn("lang", lid.F.lit(None).cast("string"))
    trees = lid.fit_trees(docs)
    assert trees.count() == 0
    assert {(r.doc_id, r.lang_pred, r.score) for r in lid.identify_languages(docs, trees).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert lid.identify_languages(docs.limit(0), lid.fit_trees(languages(spark))).count() == 0


def test_the_sample_is_bounded_by_bytes(spark):
    docs = languages(spark)
    rows = lid.sample_by_language(docs, 1000, 4000).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.lang] += len(r.text.encode())
    assert set(sizes) == set(SYLLABLES) and all(900 < n < 2500 for n in sizes.values())
