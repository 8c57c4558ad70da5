"""Folds over keyed streams in event-time order: value and list state, timers, and state that expires.

A fold takes a key's rows in the order of (time, id), whatever order they arrive in: rows wait in list state until the
watermark has passed them, then a timer folds them into the value state.  Rows behind the watermark are late and dropped
by Spark.  Keys share state by parts.  A fold names the time at which a key's state says nothing any more; a timer takes it
out then, so keys that are heard of no longer cost nothing.  Times are microseconds; timers have milliseconds.

The batch forms of the same folds are in ``jobs``; a batch over the rows that the watermark has passed gives the same rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: A key's rows and state are kept with those of other keys, in so many parts by hash: a part is read and written at once.
PARTS = 2_048


class OrderedFold(StatefulProcessor):
    """A fold of each key of a part.  Subclasses name ``fields`` (what a waiting row holds, after its time and id) and
    ``columns`` (of the output, after the key's), and define ``step`` and ``expiry``.

    Every call to the store and every timer is a round trip, so there are a few a part and batch, however many keys it has:
    the rows that wait are a list of packed rows, one a batch, the states of a part's keys one packed value.
    """

    keys: list[str]
    fields: dict[str, str]
    columns: list[str]

    def step(self, state: tuple | None, at: int, row: tuple) -> tuple[tuple, tuple | None]:
        """The new state, and an output row or None.  ``row`` is (at, id, fields)."""
        raise NotImplementedError

    def expiry(self, state: tuple) -> int:
        """When the state can be forgotten."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "packed binary")
        self.value = handle.getValueState("value", "packed binary")
        self.folded: tuple = (None, set())

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(at // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = []
        for pdf in rows:
            # numbers come as strings: beside a null, pandas would make them floats
            plain = lambda n: [None if v is None or v != v else v for v in pdf[n].tolist()]  # noqa: B023, E731
            fields = ([None if v is None else int(v) for v in plain(n)] if t == "long" else plain(n) for n, t in self.fields.items())
            came += zip(zip(*map(plain, self.keys)), zip(pdf["at"].tolist(), plain("id"), *fields))
        if came:
            self.waiting.appendValue((pickle.dumps(came, 5),))
            self._wake(min(r[0] for _, r in came))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        if self.folded[0] != passed:
            self.folded = (passed, set())
        if key in self.folded[1]:  # by another timer of this batch
            return iter([])
        self.folded[1].add(key)
        rows = [r for (packed,) in self.waiting.get() for r in pickle.loads(packed)] if self.waiting.exists() else []
        states = pickle.loads(self.value.get()[0]) if self.value.exists() else {}
        now = sorted((r for r in rows if r[1][0] // 1000 < passed), key=lambda r: (r[1][0], r[1][1] or ""))
        later = [r for r in rows if r[1][0] // 1000 >= passed] if len(now) < len(rows) else []
        out = []
        for k, row in now:
            state = states.get(k)
            if state is not None and row[0] > self.expiry(state):
                state = None
            states[k], given = self.step(state, row[0], row)
            if given is not None:
                out.append((*k, *given))
        live = {k: state for k, state in states.items() if self.expiry(state) // 1000 >= passed}
        if now:
            if later:
                self.waiting.put([(pickle.dumps(later, 5),)])
            else:
                self.waiting.clear()
        if live:
            if now or len(live) < len(states):
                self.value.update((pickle.dumps(live, 5),))
        elif self.value.exists():
            self.value.clear()
        if later or live:
            self._wake(min([r[0] for _, r in later] + [self.expiry(state) for state in live.values()]))
        return iter([pd.DataFrame(out, columns=[*self.keys, *self.columns])] if out else [])

    def close(self) -> None:
        pass


class Repeats(OrderedFold):
    """(user, action, target): kept events and how many like them were suppressed since the one before."""

    keys = ["user_id", "action", "target"]
    fields = {"detail": "string"}
    columns = ["id", "at", "detail", "repeats"]

    def __init__(self, window: float, forget: float):
        self.window, self.forget = round(window * 1e6), round(forget * 1e6)

    def step(self, state, at, row):
        since, hidden = state or (None, 0)
        if since is not None and at - since < self.window:
            return (since, hidden + 1), None
        return (at, 0), (row[1], at, row[2], hidden)

    def expiry(self, state):
        return state[0] + (self.forget if state[1] else self.window)


class Stable(OrderedFold):
    """path: the status of each scan of a file."""

    keys = ["path"]
    fields = {"size": "long", "mtime_ns": "long", "locked": "boolean"}
    columns = ["at", "status"]

    def __init__(self, min_age: float, locked_max: int, forget: float):
        self.min_age, self.locked_max, self.forget = min_age, locked_max, round(forget * 1e6)

    def step(self, state, at, row):
        _, _, size, mtime, locked = row
        same = state is not None and (size, mtime) == (state[1], state[2])
        locks = (state[4] if same and state[3] else 0) + 1 if locked else 0
        if locked:
            status = "given-up" if locks >= self.locked_max else "locked"
        else:
            status = "ready" if self.min_age <= 0 or (same and at / 1e6 - mtime / 1e9 >= self.min_age) else "waiting"
        return (at, size, mtime, bool(locked), locks), (at, status)

    def expiry(self, state):
        return state[0] + self.forget


def _folded(stream: DataFrame, fold: OrderedFold, schema: str, delay: str, parts: int = PARTS) -> DataFrame:
    """The fold's keys and ``schema``.  ``stream`` has the keys, id, ts (a timestamp) and the fold's fields; where its batches
    are large the number of parts is what can be worked on at once, and it stays with a checkpoint."""
    use_rocksdb(stream.sparkSession)
    text = [F.col(n).cast("string").alias(n) if t == "long" else F.col(n) for n, t in fold.fields.items()]
    part = F.pmod(F.xxhash64(*fold.keys), F.lit(parts)).cast("int").alias("part")
    rows = stream.select(part, *(F.col(k).cast("string").alias(k) for k in fold.keys), F.col("id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("ts"), *text).withWatermark("ts", delay)
    rows = rows.withColumn("at", F.unix_micros("ts"))
    out = rows.groupBy("part").transformWithStateInPandas(fold, ", ".join([*(f"{k} string" for k in fold.keys), schema]), "Append", "EventTime")
    return out.withColumns({k: F.col(k).cast(stream.schema[k].dataType) for k in fold.keys})


def use_rocksdb(spark: SparkSession) -> None:
    """Value and list state need this store; a session that names another one keeps it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBackedStateStoreProvider" in spark.conf.get(name, "HDFSBackedStateStoreProvider"):
        spark.conf.set(name, ROCKSDB)


#: What is kept of an audit row's strings.
TARGET_SIZE, DETAIL_SIZE = 200, 500
FORGET = 86_400.0


def audit_rows(audit: DataFrame) -> DataFrame:
    """id, ts, user_id, action, target, detail with the strings cut."""
    cut = lambda name, size: F.substring(F.coalesce(F.col(name).cast("string"), F.lit("")), 1, size).alias(name)
    return audit.select(F.col("id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "action", cut("target", TARGET_SIZE), cut("detail", DETAIL_SIZE))


def noted(detail: str = "detail", repeats: str = "repeats"):
    """The detail of a kept row, with how many repeats it stands for."""
    return F.when(F.col(repeats) > 0, F.trim(F.concat(F.col(detail), F.lit(" repeats_suppressed="), F.col(repeats)))).otherwise(F.col(detail))


def coalesced_audit_stream(audit: DataFrame, actions: tuple[str, ...], window: float = 60.0, forget: float = FORGET, delay: str = "10 minutes") -> DataFrame:
    """id, ts, user_id, action, target, detail, repeats of the rows that are kept: ``jobs.coalesced_audit`` as a stream.

    Rows of other actions pass at once; rows of ``actions`` come when the watermark has passed them.
    """
    rows = audit_rows(audit)
    some = _folded(rows.where(F.col("action").isin(*actions)), Repeats(window, forget), "id string, at long, detail string, repeats long", delay)
    some = some.select(F.col("id").cast("long").alias("id"), F.timestamp_micros("at").alias("ts"), "user_id", "action", "target", noted().alias("detail"), "repeats")
    return some.unionByName(rows.where(~F.col("action").isin(*actions)).withColumn("repeats", F.lit(0).cast("long")))


def stable_files_stream(obs: DataFrame, min_age: float = 0.0, locked_max: int = 60, forget: float = FORGET, delay: str = "1 minute") -> DataFrame:
    """path, scan_ts, status of every scan that the watermark has passed; a path's last row is ``jobs.stable_files``'s."""
    rows = obs.select("path", F.lit("").alias("id"), F.col("scan_ts").alias("ts"), F.col("size").cast("long").alias("size"), F.col("mtime_ns").cast("long").alias("mtime_ns"), "locked")
    out = _folded(rows, Stable(min_age, locked_max, forget), "at long, status string", delay)
    return out.select("path", F.timestamp_micros("at").alias("scan_ts"), "status")
