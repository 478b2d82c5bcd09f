"""Streaming forms of event handling: debounce, first of a key, pairing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor


def debounced(events: DataFrame, gap: str = "1 second", late: str = "10 minutes") -> DataFrame:
    """The last event (event_id, ts, user_id) of each session, once `gap` passes without another."""
    return (
        events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.max(F.struct("ts", "event_id")).alias("last"), F.count("*").alias("n"))
        .select("user_id", "last.event_id", "last.ts", "n")
    )


def first_of(events: DataFrame, *keys: str, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def paired(prompts: DataFrame, usage: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Prompts (call_id, ts) with their usage (call_id, used_at); those without one come when the watermark has passed."""
    p, u = prompts.withWatermark("ts", late), usage.withWatermark("used_at", late).withColumnRenamed("call_id", "used_call")
    return p.join(u, F.expr(f"call_id = used_call AND used_at BETWEEN ts AND ts + INTERVAL {late}"), "leftOuter")


def latest_wins(requests: list[tuple[float, str]], busy: float, pending: tuple[float, str] | None = None, free_at: float = float("-inf")) -> tuple[list[tuple[float, str]], tuple[float, str] | None, float]:
    """(started (time, key), request still pending, time when free) of requests in order of time.

    One request is worked on at a time, for `busy` seconds. One that comes meanwhile waits
    in a single slot, where a later one takes its place.
    """
    started = []
    for t, key in requests:
        if pending and free_at <= t:
            started.append((free_at, pending[1]))
            pending, free_at = None, free_at + busy
        if t < free_at:
            pending = (t, key)
        else:
            started.append((t, key))
            free_at = t + busy
    return started, pending, free_at


SLOT = "pending_at double, pending_key string, free_at double"


def one_at_a_time(requests: DataFrame, busy: float, late: str = "10 minutes") -> DataFrame:
    """(user_id, started, key) of a stream of requests (user_id, ts, key), by latest_wins() for
    each user; what still waits starts when the watermark passes the time it's free."""

    def work(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at, name, free = state.get if state.exists else (None, None, float("-inf"))
        pending = (at, name) if name is not None else None
        if state.hasTimedOut:
            started, pending, free = ([(free, pending[1])], None, free + busy) if pending else ([], None, free)
        else:
            rows = sorted((t.timestamp(), k) for b in batches for t, k in zip(b["ts"], b["key"], strict=True))
            started, pending, free = latest_wins(rows, busy, pending, free)
        state.update((*(pending or (None, None)), free))
        if pending:
            state.setTimeoutTimestamp(max(int(free * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]] * len(started), "started": [s for s, _ in started], "key": [k for _, k in started]})

    kind = requests.schema["user_id"].dataType.simpleString()
    keyed = requests.withWatermark("ts", late).groupBy("user_id")
    return keyed.applyInPandasWithState(work, f"user_id {kind}, started double, key string", SLOT, "append", "EventTimeTimeout")


def idle_since(events: DataFrame, gap: str = "300 seconds", late: str = "10 minutes") -> DataFrame:
    """(service, last, n): times at which a service had no event for `gap`, once the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy("service", F.session_window("ts", gap).alias("w")).agg(F.max("ts").alias("last"), F.count("*").alias("n")).drop("w")


# --- state of several kinds for each key, closed by timers -------------------------------


class Analyses(StatefulProcessor):
    """For each user: keys in flight (with the time each lapses), keys done, one waiting key, and when all is forgotten.

    A request whose key is in flight or done is skipped. Otherwise it starts, if nothing is in
    flight; else it takes the single waiting place. A done event ends its key, and the waiting
    one starts. A key in flight that isn't done by `lapse` seconds is given up, and after `idle`
    seconds without any event the user's state is closed. Times are those of the processing clock.
    """

    def __init__(self, lapse: float, idle: float):
        self.lapse, self.idle = int(lapse * 1000), int(idle * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.flying = handle.getMapState("flying", "key string", "until long")
        self.done = handle.getMapState("done", "key string", "at long")
        self.waiting = handle.getValueState("waiting", "key string")
        self.idle_at = handle.getValueState("idle_at", "at long")

    def _start(self, user, key: str, now: int) -> tuple:
        self.flying.updateValue((key,), (now + self.lapse,))
        self.handle.registerTimer(now + self.lapse)
        return user, "start", key

    def _next(self, user, now: int) -> Iterator[tuple]:
        if self.waiting.exists() and not any(True for _ in self.flying.keys()):
            (key,) = self.waiting.get()
            self.waiting.clear()
            if not self.done.containsKey((key,)):
                yield self._start(user, key, now)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, out, user = timerValues.getCurrentProcessingTimeInMs(), [], key[0]
        found = sorted((tuple(r) for part in rows for r in part[["ts", "kind", "key"]].itertuples(index=False)), key=lambda r: r[0])
        for _, kind, name in found:
            if kind == "done":
                if self.flying.containsKey((name,)):
                    self.flying.removeKey((name,))
                    self.done.updateValue((name,), (now,))
                    out += self._next(user, now)
            elif self.flying.containsKey((name,)) or self.done.containsKey((name,)):
                out.append((user, "skip", name))
            elif any(True for _ in self.flying.keys()):
                self.waiting.update((name,))
                out.append((user, "wait", name))
            else:
                out.append(self._start(user, name, now))
        if self.idle_at.exists():
            self.handle.deleteTimer(self.idle_at.get()[0])
        self.idle_at.update((now + self.idle,))
        self.handle.registerTimer(now + self.idle)
        yield pd.DataFrame(out, columns=["user_id", "event", "key"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, now, out, user = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentProcessingTimeInMs(), [], key[0]
        for (name,), (until,) in list(self.flying.iterator()):
            if until <= at:
                self.flying.removeKey((name,))
                out.append((user, "lapse", name))
        out += self._next(user, now)
        if self.idle_at.exists() and self.idle_at.get()[0] <= at:
            for state in (self.flying, self.done, self.waiting, self.idle_at):
                state.clear()
            out.append((user, "close", None))
        yield pd.DataFrame(out, columns=["user_id", "event", "key"])

    def close(self) -> None:
        pass


def analyses(events: DataFrame, lapse: float = 120, idle: float = 300) -> DataFrame:
    """(user_id, event, key) of a stream of events (user_id, ts, kind, key), kind request or done: start, wait, skip,
    lapse and close, by Analyses for each user. State is kept by RocksDB, which the session must name
    in spark.sql.streaming.stateStore.providerClass."""
    kind = events.schema["user_id"].dataType.simpleString()
    return events.groupBy("user_id").transformWithStateInPandas(Analyses(lapse, idle), f"user_id {kind}, event string, key string", "Append", "ProcessingTime")
