import os
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash

from docmill.llm import simhash as s
from tests.llm.helpers import corpus, frame, words


TABLES = "/root/testdata/sf0.1"


def brute(rows, shingle=3, threshold=2):
    prints = []
    for _, text in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        k = min(shingle, len(w))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    ids = [-1 if i is None else i for i, _ in rows]
    out = []
    for start in range(len(rows)):
        seen, todo = {start}, [start]
        while todo:
            x = todo.pop()
            for y in range(len(rows)):
                if y not in seen and (prints[x] ^ prints[y]).bit_count() <= threshold:
                    seen.add(y)
                    todo.append(y)
        out.append((ids[start], prints[start], min(ids[y] for y in seen)))
    return sorted(out)


def test_against_brute_force(spark):
    rows = corpus(n=60)
    got = s.near_duplicates(frame(spark, rows)).collect()
    none = lambda x: -1 if x is None else x
    assert sorted((none(r.doc_id), r.fp0 % 2**64, none(r.component_id)) for r in got) == brute(rows)


def test_empty_table(spark):
    assert s.near_duplicates(frame(spark, [])).count() == 0


def test_anchors_cover_every_flip():
    rng = np.random.default_rng(3)
    for t in (1, 2, 3):
        x = rng.integers(0, 2**63, (40, 1), dtype=np.uint64)
        y = x ^ np.array([[sum(1 << int(b) for b in rng.choice(64, t, replace=False))] for _ in x], np.uint64)
        links = s.Links(3, 1, ((0, 23),), t, t)
        home = {int(i): int(a) for i, anchor, is_home in s.anchors(x, links) if is_home for i, a in zip(i, anchor)}
        reach = {(int(i), int(a)) for i, anchor, _ in s.anchors(y, links) for i, a in zip(i, anchor)}
        assert len(home) == len(x) and all((i, a) in reach for i, a in home.items())


def test_each_syndrome_has_one_nearest_code_word():
    assert s.patterns(0).shape == (2048, 1) and (s.patterns(0) >= 0).all()


def test_links_of_chains_and_dense_groups(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 2**62))
    chain = [base]
    for b in range(0, 60, 2):
        chain.append(chain[-1] ^ (3 << b))
    dense = [int(base ^ 0x5555555555555555) ^ (1 << b) for b in range(40)]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    fps = spark.createDataFrame([(signed(x), signed(x)) for x in {*chain, *dense}], "id long, fp0 long")
    from docmill.llm.graph import connected_components

    found = s.link_forest(fps, s.EXACT)
    assert found.count() < 20 * (len(chain) + len(dense))
    roots = {r.node: r.root for r in connected_components(found).collect()}
    assert len({roots[signed(x)] for x in chain}) == 1 and len({roots[signed(x)] for x in dense}) == 1


def test_similar_texts_meet(spark):
    rng = random.Random(8)
    rows = []
    for i in range(120):
        text = words(rng, 400, 100_000).split()
        rows.append((2 * i, " ".join(text)))
        for _ in range(6):  # each change touches five of 396 shingles: a similarity of about 0.86
            text[rng.randrange(400)] = "changed"
        rows.append((2 * i + 1, " ".join(text)))
    got = {r.doc_id: r.component_id for r in s.near_duplicates(frame(spark, rows), s.SIMILAR).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(120)) >= 100 and all(c in (d, d - d % 2) for d, c in got.items())


def test_similar_links_are_those_of_the_shingle_sets(spark):
    rng = random.Random(21)
    rows, like = [], {}
    for i in range(300):  # one run of k changed words touches k + 4 of 396 shingles
        text = words(rng, 400, 100_000).split()
        k = 25 + i % 44
        other = text[:100] + [f"new{i}_{j}" for j in range(k)] + text[100 + k :]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(other))]
        like[i] = (396 - k - 4) / (396 + k + 4)
    got = {r.doc_id: r.component_id for r in s.near_duplicates(frame(spark, rows), s.SIMILAR).collect()}
    linked = {i for i in like if got[2 * i + 1] == 2 * i}
    assert all(like[i] >= 0.8 for i in linked) and all(c in (d, d - d % 2) for d, c in got.items())
    wanted = {i for i in like if like[i] >= 0.8}
    assert len(wanted) > 80 and len(linked) >= 0.97 * len(wanted)


def test_components_with_a_hot_node(spark):
    from docmill.llm.graph import connected_components

    rng = random.Random(4)
    edges = [(0, i) for i in range(1, 3000)] + [(9000, 2 * i) for i in range(2000, 2400)] + [(10_000 + rng.randrange(900), 10_000 + rng.randrange(900)) for _ in range(700)]
    low = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: low[x] for e in edges if e[0] != e[1] for x in e}


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_near_copies_of_the_tables_are_linked(spark):
    """Every pair of texts with a Jaccard similarity of 0.8 or more of their five-word shingles, found by counting shared shingles (but for those of over 400 texts)."""
    rows = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()
    sets = {}
    for r in rows:
        x = frozenset(s.shingle_set(r.text or "", 5).tolist())
        sets[x] = min(sets.get(x, r.doc_id), r.doc_id)
    ids = {i: x for x, i in sets.items()}
    holders = defaultdict(list)
    for i, x in ids.items():
        for g in x:
            holders[g].append(i)
    shared = Counter()
    for held in holders.values():
        shared.update(combinations(sorted(held), 2)) if len(held) <= 400 else None
    pairs = [(a, b) for (a, b), n in shared.items() if n / (len(ids[a]) + len(ids[b]) - n) >= 0.8]
    root = {r.doc_id: r.component_id for r in s.near_duplicates(spark.createDataFrame(rows), s.SIMILAR).select("doc_id", "component_id").collect()}
    assert len(pairs) >= 40 and sum(root[a] == root[b] for a, b in pairs) >= 0.9 * len(pairs)
