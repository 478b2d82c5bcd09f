"""Streams with exact rows over several batches, and versions written side by side."""

import threading
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evidentia.sources import sinks as K
from evidentia.streaming import streams as X

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
T0 = datetime(2024, 5, 6, 7, 0, 0)


def at(s):
    return T0 + timedelta(seconds=s)


class Stream:
    """A folder that a query reads, one batch of rows at a time."""

    def __init__(self, spark, path, schema, build, trigger=None):
        self.spark, self.path, self.schema, self.trigger = spark, path, schema, trigger or {"availableNow": True}
        (path / "in").mkdir(parents=True)
        self.build = build

    def batch(self, rows):
        if rows:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(str(self.path / "in"))
        df = self.spark.readStream.schema(self.schema).parquet(str(self.path / "in"))
        q = self.build(df).writeStream.format("parquet").option("path", str(self.path / "out")).option("checkpointLocation", str(self.path / "c")).outputMode("append").trigger(**self.trigger).start()
        assert q.awaitTermination(100)
        found = self.spark.read.parquet(str(self.path / "out")).collect()
        return sorted(map(tuple, found), key=str)


def test_debounce_first_and_idle_over_batches(spark, tmp_path):
    events = "event_id long, ts timestamp, user_id long"
    s = Stream(spark, tmp_path / "d", events, lambda d: X.debounced(d, "1 second", "2 seconds"))
    assert s.batch([(1, at(0), 1), (2, at(0.5), 1), (3, at(1.4), 1), (4, at(0), 2), (5, at(9), 2)]) == [(1, 3, at(1.4), 3), (2, 4, at(0), 1)]
    assert s.batch([(6, at(9.5), 2), (7, at(30), 1)]) == [(1, 3, at(1.4), 3), (2, 4, at(0), 1), (2, 6, at(9.5), 2)]
    f = Stream(spark, tmp_path / "f", events, lambda d: X.first_of(d.select("user_id", "ts"), "user_id", late="1 hour"))
    assert f.batch([(1, at(0), 1)]) == [(1, at(0))]
    assert f.batch([(2, at(5), 1), (3, at(6), 2)]) == [(1, at(0)), (2, at(6))]
    i = Stream(spark, tmp_path / "i", "service string, ts timestamp", lambda d: X.idle_since(d, "300 seconds", "1 second"))
    assert i.batch([("a", at(0)), ("a", at(200)), ("b", at(100)), ("b", at(900))]) == [("a", at(200), 2), ("b", at(100), 1)]


def test_prompts_are_paired_with_usage_or_flushed(spark, tmp_path):
    kinds = "kind string, call_id string, at timestamp"

    def build(d):
        prompts = d.where("kind = 'prompt'").select("call_id", F.col("at").alias("ts"))
        usage = d.where("kind = 'usage'").select("call_id", F.col("at").alias("used_at"))
        return X.paired(prompts, usage, "10 seconds")

    s = Stream(spark, tmp_path, kinds, build)
    assert s.batch([("prompt", "a", at(0)), ("prompt", "b", at(1)), ("usage", "a", at(2))]) == [("a", at(0), "a", at(2))]
    got = s.batch([("prompt", "z", at(100)), ("usage", "z", at(101)), ("usage", "x", at(102))])
    got = s.batch([("prompt", "y", at(200)), ("usage", "w", at(200))])
    assert [r for r in got if r[0] in "abz"] == [("a", at(0), "a", at(2)), ("b", at(1), None, None), ("z", at(100), "z", at(101))]


def test_analyses_hold_state_until_it_lapses_or_idles(spark, tmp_path):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        s = Stream(spark, tmp_path, "user_id long, ts timestamp, kind string, key string", lambda d: X.analyses(d, lapse=600, idle=900), {"once": True})
        rows = [(1, at(0), "request", "a"), (1, at(1), "request", "a"), (1, at(2), "request", "b"), (1, at(3), "request", "c"), (2, at(0), "request", "a"), (2, at(1), "done", "other")]
        first = [(1, "skip", "a"), (1, "start", "a"), (1, "wait", "b"), (1, "wait", "c"), (2, "start", "a")]
        assert s.batch(rows) == first
        # the waiting key, the later one, starts in the next batch, when the first is done
        second = [*first, (1, "skip", "a"), (1, "start", "c")]
        assert s.batch([(1, at(5), "done", "a"), (1, at(6), "request", "a")]) == sorted(second, key=str)
        t = Stream(spark, tmp_path / "t", "user_id long, ts timestamp, kind string, key string", lambda d: X.analyses(d, lapse=0.2, idle=1.5), {"once": True})
        assert t.batch([(1, at(0), "request", "a"), (1, at(1), "request", "b")]) == [(1, "start", "a"), (1, "wait", "b")]
        time.sleep(2)
        t.batch([(9, at(0), "done", "x")])
        time.sleep(2)
        got = t.batch([(9, at(1), "done", "x")])
        assert [r for r in got if r[0] == 1][:1] == [(1, "close", None)] and {(1, "lapse", "a"), (1, "start", "b")} <= set(got)
        # all is forgotten: the same key starts again
        assert sum(r == (1, "start", "a") for r in t.batch([(1, at(9), "request", "a")])) == 2
    finally:
        spark.conf.set(PROVIDER, before)


def test_two_writers_lose_no_row(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    assert K.newest(spark, path) is None
    K.upsert_table(spark, path, rows((1, "a"), (2, "a")), "k")
    once = []

    def other():
        if not once:  # another writer takes the number in between
            once.append(K.upsert_table(spark, path, rows((2, "b"), (3, "b")), "k"))

    K.upsert_table(spark, path, rows((3, "c"), (4, "c")), "k", before_commit=other)
    assert sorted(map(tuple, spark.read.parquet(K.newest(spark, path)).collect())) == [(1, "a"), (2, "b"), (3, "c"), (4, "c")]
    assert K.newest(spark, path).endswith("/v2")
    threads = [threading.Thread(target=K.upsert_table, args=(spark, path, rows((10 + i, "t")), "k")) for i in range(4)]
    [t.start() for t in threads]
    [t.join(100) for t in threads]
    assert spark.read.parquet(K.newest(spark, path)).count() == 8 and K.newest(spark, path).endswith("/v6")
    with pytest.raises(OSError, match="came first"):
        K.upsert_table(spark, path, rows((1, "x")), "k", tries=1, before_commit=lambda: K.upsert_table(spark, path, rows((9, "y")), "k"))
