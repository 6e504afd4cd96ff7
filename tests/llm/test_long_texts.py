"""Texts of megabytes beside short ones, in the operators whose own tests have none."""

import random
import zlib

import pytest
import zstandard

from docmill.llm.decontamination import decontaminate
from docmill.llm.lm_scoring import score_language
from docmill.llm.quality_classifier import MAGIC, fit, score_quality
from docmill.llm.quality_rules import quality_rules
from docmill.llm.sharding import shard_documents
from docmill.llm.simhash import near_duplicates
from docmill.llm.suffix_array import drop_repeated_bytes
from tests.llm import test_lm_scoring, test_packing, test_quality_rules, test_sharding, test_simhash
from tests.llm.helpers import frame, words
from tests.llm.test_quality_classifier import labelled


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    long = words(rng, 300_000, 50_000)
    return [(1, "short text of a few words"), (2, long), (3, words(rng, 50)), (4, "x" * 1_500_000), (5, None), (6, "a\n" * 200_000)]


def test_long_simhash(spark, rows):
    got = sorted((r.doc_id, r.fp0 % 2**64, r.component_id) for r in near_duplicates(frame(spark, rows)).collect())
    assert got == test_simhash.brute(rows)


def test_long_sharding(spark, rows):
    got = shard_documents(frame(spark, rows), 4).collect()
    test_sharding.laws(rows, got, 4)


def test_long_quality_rules(spark, rows):
    rows = rows[:5]  # the plain count of equal lines is quadratic
    got = {r.doc_id: tuple(r[1:6]) for r in quality_rules(frame(spark, rows)).collect()}
    assert got == {i: test_quality_rules.brute(t) for i, t in rows}


def test_long_suffix_array(spark, rows):
    """A long text that returns under a larger id is gone but for what was put into it."""
    rng = random.Random(2)
    long = rows[1][1]
    at = len(long) // 2
    fresh = " ".join(f"fresh{rng.random()}" for _ in range(40))
    got = {r.doc_id: r for r in drop_repeated_bytes(frame(spark, [*rows[:2], (9, long[:at] + fresh + long[at:])])).collect()}
    assert got[2].n_removed == 0 and got[9].n_spans == 2
    assert len(fresh) - 2 <= got[9].n_bytes - got[9].n_removed <= len(fresh) + 2


def test_long_language_model(spark, rows):
    got = score_language(frame(spark, rows)).collect()
    assert sorted((r[0], *r[1:5], round(r.base_score, 3)) for r in got) == [(*x[:5], pytest.approx(x[5], abs=1e-3)) for x in test_lm_scoring.brute(rows)]
    assert all(r.score <= 0 for r in got)


def test_long_decontamination(spark, rows):
    rng = random.Random(3)
    item = words(rng, 30, 9000)
    hidden = rows[1][1][:900_000] + " " + item.upper() + " " + rows[1][1][900_000:]
    kept = decontaminate(frame(spark, [*rows, (7, hidden)]), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [1, 2, 3, 4, 5, 6]


def test_long_packing(spark, rows):
    from docmill.llm.packing import pack_documents, public_tokenizer

    few = [(i, t) for i, t in rows if i not in (4,)]
    test_packing.laws(few, pack_documents(frame(spark, few), public_tokenizer()).collect(), 2048)


def plain_score(model, text):
    """The score by compressors of their own, one for each block, and the logistic formula."""
    import math

    def size(dictionary, part):
        kind = {} if dictionary[:4] == MAGIC else {"dict_type": zstandard.DICT_TYPE_RAWCONTENT}
        c = zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(dictionary, **kind), write_checksum=False, write_content_size=False, write_dict_id=False)
        return len(c.compress(part))

    n = max(1, round(len(text) / model.block))
    parts = [text[len(text) * i // n : len(text) * (i + 1) // n] for i in range(n)]
    good, bad = ([size(d, p) for p in parts] for d in (model.good, model.bad))
    whole = (sum(bad) - sum(good)) / (sum(bad) + sum(good))
    worst = min(1.0, *((b - g) / (b + g) for g, b in zip(good, bad)))
    return 1 / (1 + math.exp(-max(-30, min(30, model.weights[0] + model.weights[1] * whole + model.weights[2] * worst))))


def test_quality_scores_against_plain_compressors(spark, rows):
    marked, marks = labelled(random.Random(3), 120)
    model = fit(frame(spark, marked), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    everything = [(10_000 + i, t) for i, t in rows] + marked
    got = {r.doc_id: r.score for r in score_quality(frame(spark, everything), model).collect()}
    for i, t in everything:
        assert got[i] == pytest.approx(plain_score(model, (t or "").encode()), abs=1e-6), (i, zlib.crc32((t or "").encode()))
