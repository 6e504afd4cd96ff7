import zlib
from collections import defaultdict

from docmill.llm.sharding import _quantiles, shard_documents, write_shards
from tests.llm.helpers import corpus, frame


def laws(rows, got, shards):
    size = lambda t: len((t or "").encode()) + 1
    want = sorted((-1 if i is None else i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots, load = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    return [load[k] for k in range(shards)]


def test_near_equal_bytes(spark):
    rows = [(i, "x" * (37 * i % 900)) for i in range(1500)]
    load = laws(rows, shard_documents(frame(spark, rows), 8).collect(), 8)
    assert max(load) - min(load) <= 2 * 901 + sum(load) // 8 // 32


def test_a_hot_group_is_subdivided(spark):
    rows = [(i, "same text") for i in range(800)] + [(1000 + i, f"text {i}") for i in range(400)]
    load = laws(rows, shard_documents(frame(spark, rows), 8).collect(), 8)
    assert max(load) - min(load) <= 40


def test_odd_rows(spark):
    rows = corpus()
    laws(rows, shard_documents(frame(spark, rows), 4).collect(), 4)
    assert shard_documents(frame(spark, [])).count() == 0
    laws([(None, None)] * 5, shard_documents(frame(spark, [(None, None)] * 5), 4).collect(), 4)


def test_quantiles():
    assert _quantiles([], 4) == [] and _quantiles([(1, 0)] * 9, 4) == [(1, 0)] and _quantiles([(i, 0) for i in range(8)], 4) == [(2, 0), (4, 0), (6, 0)]


def test_groups_of_every_size_are_cut_at_the_same_places(spark):
    # 200 copies are under a 64th of a shard of the larger table and over it in the smaller one
    for others in (300, 6000):
        rows = [(i, "same text") for i in range(200)] + [(1000 + i, f"text {i:06d} of its own") for i in range(others)]
        load = laws(rows, shard_documents(frame(spark, rows), 4).collect(), 4)
        assert max(load) - min(load) <= 2 * 23


def test_written_shards(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(50)] + [(None, "none"), (None, None), (3, "text 3"), (3, "text 3"), (3, "another")]
    docs = frame(spark, rows)
    write_shards(docs, shard_documents(docs, 4), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=order) == sorted(rows, key=order)
    assert back.select("shard").distinct().count() == 4
