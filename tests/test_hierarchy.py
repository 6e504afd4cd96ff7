"""Ways to the root by pointer doubling against a walk: deep chains, cycles, lost parents, repeated ids."""

import hashlib
import random

from docmill.operators.hierarchy import nearest_of_kind, paths

NODES = "id long, parent long, title string, kind string, depth string"


def brute(rows):
    up, title, kind = {}, {}, {}
    for i, parent, t, k, _ in rows:
        up[i], title[i], kind[i] = parent, t or "", k
    ways, near = {}, {}
    for i in up:
        way, j = [], i
        while j in up and j not in way:
            way.append(j)
            j = up[j]
        ways[i] = None if j in up else (way[-1], len(way) - 1, " > ".join(title[x] for x in reversed(way)))
        hit = next((n for n, x in enumerate(way[1:], 1) if kind[x] == "folder"), None)
        if hit is None and j in up and kind[j] == "folder":
            hit, way = len(way), [*way, j]  # the cycle's first node again
        near[i] = (None, None) if hit is None else (way[hit], hit)
    return ways, near


def tree():
    rng = random.Random(8)
    rows = [(i, i - 1 if i % 40 else None, f"t{i}", rng.choice(["page", "page", "page", "folder", None]), "c") for i in range(160)]  # 39 deep
    rows += [(1000 + i, 1000 + (i + 1) % 7, None, "page", "c") for i in range(7)]  # a cycle
    rows += [(1100 + i, 1000 if i == 0 else 1099 + i, "below", "folder" if i == 2 else "page", "c") for i in range(5)]  # and a chain that ends in it
    rows += [(1200, 1200, "self", "folder", "c"), (1201, 99999, "lost", "page", "c"), (1202, 1201, "x", "page", "c")]
    return rows + [(2000 + i, rng.choice([None, *range(2000, 2000 + i)]) if i else None, f"r{i}", rng.choice(["page", "folder"]), "c") for i in range(80)]


def test_ways(spark):
    rows = tree()
    ways, near = brute(rows)
    got = {r.id: r for r in paths(spark.createDataFrame(rows, NODES).repartition(5)).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r.cyclic == (ways[i] is None)
        assert (None if r.cyclic else (r.root, r.depth, r.path)) == ways[i]
        assert r.key == (None if r.cyclic else hashlib.sha1(r.path.encode()).hexdigest())
    assert {r.id: (r.ancestor, r.steps) for r in nearest_of_kind(spark.createDataFrame(rows, NODES), "folder").collect()} == near


def test_odd_rows(spark):
    rows = [(1, None, None, None, "c"), (1, None, None, None, "c"), (2, 1, "b", None, "c"), (2, 1, "a", None, "c"), (None, 1, "x", None, "c"), (3, 3, "s", None, "c")]
    got = {r.id: (r.depth, r.path, r.cyclic) for r in paths(spark.createDataFrame(rows, NODES)).collect()}
    assert got == {1: (0, "", False), 2: (1, " > a", False), 3: (None, None, True)}
    assert paths(spark.createDataFrame([], NODES)).count() == 0 and nearest_of_kind(spark.createDataFrame([], NODES), "x").count() == 0
