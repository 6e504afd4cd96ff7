"""Merged state: batches, replays, restarts, odd rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from docmill.streaming.state import StateStore

ROWS = "key string, at timestamp, value string, flagged boolean, bucket string"


def rows(n=200, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", "c", "é", "", None]), dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(40)), rng.choice(["x", "y", None]), rng.choice([True, False, False, None]), "clash") for _ in range(n)]


def brute(all_rows):
    out = {}
    for key, at, value, flagged, _ in all_rows:
        if key is not None:
            first, last, n, newest, flag = out.get(key, (at, at, 0, (at, value), False))
            newest = max(newest, (at, value), key=lambda x: (x[0], x[1] is not None, x[1] or ""))
            out[key] = (min(first, at), max(last, at), n + 1, newest, flag or bool(flagged))
    return out


def state(store, version=None):
    return {r.key: (r.first_seen, r.last_seen, r.seen, tuple(r.newest), r.flagged) for r in store.rows(version).collect()}


def test_batches_in_any_order_and_replayed_give_the_state_of_one_run(spark, tmp_path):
    data = rows()
    frame = lambda part: spark.createDataFrame(part, ROWS)
    parts = [data[:50], data[50:51], [], data[51:180], data[180:]]
    one, many = StateStore(spark, str(tmp_path / "one"), 4), StateStore(spark, str(tmp_path / "many"), 4)
    assert one.merge(frame(data), "all") and state(one) == brute(data)
    for i in (3, 0, 4, 2, 1):
        assert many.merge(frame(parts[i]), f"b{i}")
        assert not many.merge(frame(parts[i]), f"b{i}")
    assert state(many) == brute(data) and many.version() == 5
    assert state(many, 1) == brute(parts[3])  # older versions can still be read
    # a writer that dies before its manifest leaves nothing
    many.rows().limit(1).write.parquet(str(tmp_path / "many/rows/gen=dead/bucket=0"))
    again = StateStore(spark, str(tmp_path / "many"), 4)
    assert state(again) == brute(data)
    # a batch that touches one key rewrites its bucket alone
    gens = lambda v: {(r.bucket, r.gen) for r in again._manifests().where(F.col("version") == v).where("bucket is not null").collect()}
    assert again.merge(frame([("a", dt.datetime(2030, 1, 1), "z", None, "c")]), "late") and len(gens(6) - gens(5)) == 1
    assert state(again)["a"][3] == (dt.datetime(2030, 1, 1), "z")


def test_without_rows(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "s"))
    assert store.rows().count() == 0 and store.merge(spark.createDataFrame([], ROWS), "empty")
    assert store.rows().count() == 0 and not store.merge(spark.createDataFrame([], ROWS), "empty")


def test_a_stream_that_restarts(spark, tmp_path):
    data = [(k, at, v, bool(f), b) for k, at, v, f, b in rows(60, 3)]
    store = StateStore(spark, str(tmp_path / "s"), 3)
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    stream = lambda: spark.readStream.schema(ROWS).parquet(source)
    for i, part in enumerate((data[:20], data[20:40], data[40:])):
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(source)
        store.follow(stream(), "events", check).awaitTermination()
        assert state(store) == brute(data[: 20 * (i + 1)])
    # the progress of the last batch is lost: it is replayed, and has no second effect
    for f in (tmp_path / "check/commits").glob("*2*"):
        f.unlink()
    store.follow(stream(), "events", check).awaitTermination()
    assert state(store) == brute(data)
