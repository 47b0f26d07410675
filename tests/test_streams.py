"""Kept-up graphs against full rebuilds, and debounced streams against their batch form."""

import datetime as dt
import random
import time

import pytest

from callscope.plans import stream_queries
from callscope.streaming import maintain, reindex


def version_rows(rng, version, paths):
    rows = []
    for p in paths:
        edges = [(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(rng.randrange(4))]
        rows += [(p, version, a, b) for a, b in edges] or [(p, version, None, None)]
    return rows


def test_batches_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(1)
    store = maintain.Store(spark, f"file://{tmp_path}/store", buckets=4, deltas=2)
    every = []
    for version in range(5):
        rows = version_rows(rng, version, rng.sample([f"f{k}" for k in range(12)], 6 if version else 12))
        every += rows
        batch = spark.createDataFrame(rows, maintain.EDGES)
        assert store.apply(batch) == len({r[0] for r in rows})
        assert store.apply(batch) == 0  # the same again
        edges, degrees = maintain.rebuilt(spark.createDataFrame(every, maintain.EDGES))
        assert sorted(store.edges().collect()) == sorted(edges.collect())
        assert sorted(store.degrees().collect()) == sorted(degrees.collect())
    old = spark.createDataFrame([("f0", 0, "n1", "n2"), ("f99", 0, "n1", "n2")], maintain.EDGES)
    assert store.apply(old) == 1  # an older version of a file changes nothing
    assert len(store.manifest()["degrees"]) <= 2


def test_a_failure_before_the_commit_changes_nothing(spark, tmp_path, monkeypatch):
    store = maintain.Store(spark, f"file://{tmp_path}/store", buckets=2)
    store.apply(spark.createDataFrame([("a", 1, "x", "y")], maintain.EDGES))
    monkeypatch.setattr(store, "_commit", lambda m: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.apply(spark.createDataFrame([("a", 2, "x", "z"), ("b", 1, "y", "z")], maintain.EDGES))
    monkeypatch.undo()
    assert [tuple(r) for r in store.edges().collect()] == [("a", 1, "x", "y")]
    assert store.apply(spark.createDataFrame([("a", 2, "x", "z"), ("b", 1, "y", "z")], maintain.EDGES)) == 2
    assert sorted(tuple(r) for r in store.degrees().collect()) == [("x", 1, 0), ("y", 1, 0), ("z", 0, 2)]


def test_a_new_checkpoint_changes_nothing(spark, sf_dir, tmp_path):
    store = maintain.Store(spark, f"file://{tmp_path}/store")
    for n in range(2):
        q = stream_queries.page_links(spark, sf_dir, stream=True).writeStream.foreachBatch(store.replaced_by()).option("checkpointLocation", f"{tmp_path}/c{n}").trigger(availableNow=True).start()
        q.awaitTermination()
    assert store.manifest()["commits"] == 1
    edges, degrees = maintain.rebuilt(stream_queries.page_links(spark, sf_dir))
    assert sorted(store.edges().collect()) == sorted(edges.collect()) and sorted(store.degrees().collect()) == sorted(degrees.collect())


T0 = dt.datetime(2024, 1, 1)


def written(spark, path, n, rows):
    spark.createDataFrame([(u, T0 + dt.timedelta(minutes=m)) for u, m in rows], "user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{path}/in")
    time.sleep(1.1)  # files are taken in the order of their times


def test_debounced_stream_and_late_changes(spark, tmp_path):
    path = f"file://{tmp_path}"
    seen = reindex.Progress()
    spark.streams.addListener(seen)
    run = lambda: reindex.to_parquet(reindex.reindexed(spark.readStream.schema("user_id long, ts timestamp").parquet(f"{path}/in"), gap=600, late="30 minutes"), f"{path}/out", f"{path}/ck")
    written(spark, path, 0, [(1, 0), (1, 5), (1, 40), (2, 3), (None, 7)])
    run()
    written(spark, path, 1, [(1, 14), (1, 24), (2, 90), (1, 95)])  # 14 and 24 join the first burst: within the watermark's half hour
    run()
    written(spark, path, 2, [(1, 30), (2, 200)])  # 30 comes too late and is dropped
    got = sorted((r["user_id"], (r["start"] - T0).seconds // 60, (r["stop"] - T0).seconds // 60, r["n"]) for r in run().collect())
    assert got == [(1, 0, 24, 4), (1, 40, 40, 1), (1, 95, 95, 1), (2, 3, 3, 1), (2, 90, 90, 1)]
    spark.streams.removeListener(seen)
    assert sum(b[2] for b in seen.batches) == 11 and len(seen.ended) >= 2  # the last end may still be on its way


def test_debounced_events_equal_their_batch(spark, sf_dir):
    closed = stream_queries.stream_reindex_runs(spark, sf_dir)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    end = events.agg({"ts": "max"}).first()[0] - dt.timedelta(hours=1)
    want = [tuple(r) for r in reindex.reindexed(events).collect() if r["stop"] + dt.timedelta(seconds=1800) < end]
    assert sorted(map(tuple, closed.collect())) == sorted(want)
