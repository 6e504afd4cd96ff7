"""The band join against every pair."""

import random

from docmill.operators.nearest import best_contexts

CHUNKS, CANDIDATES = "doc long, chunk long, start long, end long, score string", "doc long, candidate long, start long, end long, confidence double, listed array<long>, b string"


def test_every_candidate_within_reach_is_considered(spark):
    rng = random.Random(4)
    chunks = [(d, k, k * 750, k * 750 + 900, "c") for d in range(4) for k in range(rng.choice([3, 30]))]
    candidates = []
    for d in range(3):
        for c in range(25):
            at = rng.randrange(25000)
            candidates.append((d, c, at, at + rng.choice([5, 300, 9000]), rng.choice([0.1, 0.5, None]), rng.choice([None, [], [rng.randrange(35), 1]]), "c"))
    candidates += [(2, 90, None, None, 0.4, [2, 2], "c"), (7, 1, 0, 5, 0.5, None, "c"), candidates[0]]
    want = {}
    for d, k, a, b, _ in chunks:
        best = None
        for e, c, x, y, confidence, listed, _ in candidates:
            if e == d:
                score = (confidence or 0.0) + (2.0 if k in (listed or []) else 0.0)
                if x is not None:
                    gap = min(abs(a - x), abs(b - y))
                    score += 1.0 if a < y and x < b else max(0.0, 0.5 - gap / 5000) if gap <= 2200 else 0.0
                best = min(best or (9, 9), (-round(score + 1e-9, 6), c))
        if best:
            want[d, k] = (best[1], -best[0])
    got = {(r.doc, r.chunk): (r.candidate, r.score) for r in best_contexts(spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(candidates, CANDIDATES)).collect()}
    assert got == want and len(want) > 30


def test_without_candidates(spark):
    assert best_contexts(spark.createDataFrame([(1, 0, 0, 9, "c")], CHUNKS), spark.createDataFrame([], CANDIDATES)).count() == 0
