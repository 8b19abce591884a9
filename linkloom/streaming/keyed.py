"""Request admission as a stream with keyed state: one small value per origin and per page, expired by event time.

The rules and their order are those of `admission.admit`. A rate window is the time it opened at and the quota used; a
cooldown is the time of the last accepted request. Each goes when the watermark has passed the last moment at which a
request can depend on it. So state grows with the keys seen within a window and the watermark's delay.

The values lie in hash buckets of keys (`buckets`), as a call per key costs several milliseconds. A micro-batch reads and
writes only the buckets of its keys.

Requests count in the order of ts and request_id within a micro-batch. With micro-batches in the order of ts the decisions
are those of the batch operator; a request older than its key's window counts in that window. Rows later than the
watermark are dropped by Spark, which counts them in the query's progress (`numRowsDroppedByWatermark`).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from linkloom.graph import Graph
from linkloom.streaming.admission import (
    COOLDOWN_MS,
    POLICIES,
    RATE_LIMIT,
    RATE_WINDOW_MS,
    _stateless,
    reason_text,
    status_code,
)
from linkloom.streaming.buckets import ROCKSDB, Bucket, bucket_schema, by_bucket, first_values, stretches


class _Keyed(StatefulProcessor):
    """The values of a bucket's keys, each there until the watermark passes its last moment; rows that failed before pass through."""

    name, fields = "", {}

    @property
    def schema(self) -> str:
        """The newest value's time, which the bucket's timer follows, and the keys with their values."""
        return bucket_schema("start", self.fields)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = Bucket(handle, self.name, self.schema, lambda value: self.last_moment(value) + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["state_key", "ts", "request_id"], ignore_index=True)
        asked = np.flatnonzero(pdf["failed"].isna().to_numpy())
        if len(asked):
            values = self.held.get()
            ts, failed = pdf["ts"].to_numpy(np.int64)[asked], pdf["failed"].to_numpy(object)
            changed = False
            for name, at, end in stretches(pdf["state_key"].to_numpy(object)[asked]):
                before = values.get(name)
                now, refused = self.decide(before, ts[at:end])
                failed[asked[at:end][refused]] = self.name
                if now != before:
                    values[name], changed = now, True
            pdf["failed"] = failed
            if changed:
                self.held.put(values, timerValues.getCurrentWatermarkInMs())
        yield pdf.drop(columns="state_key")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.expire(timerValues.getCurrentWatermarkInMs())
        yield from ()

    def close(self) -> None:
        pass

    def decide(self, held: tuple | None, ts: np.ndarray) -> tuple[tuple, np.ndarray]:
        """The value after requests at the times `ts`, in order, and which of them are refused."""
        raise NotImplementedError

    def last_moment(self, state: tuple) -> int:
        """The last time at which a request depends on the value."""
        raise NotImplementedError


class RateWindows(_Keyed):
    """The first `limit` requests of a window pass; the next window opens at the first request after its end."""

    name, fields = "rate", {"start": "long", "used": "int"}

    def __init__(self, window_ms: int, limit: int):
        self.window_ms, self.limit = window_ms, limit

    def decide(self, held, ts):
        refused = np.ones(len(ts), bool)
        start, used = held if held else (None, 0)
        at = 0
        while at < len(ts):
            if start is None or ts[at] > start + self.window_ms:
                start, used = int(ts[at]), 0
            end = int(np.searchsorted(ts, start + self.window_ms, "right"))
            taken = min(max(0, self.limit - used), end - at)
            refused[at : at + taken] = False
            used, at = used + taken, end  # what is refused need not be counted
        return (start, used), refused

    def last_moment(self, state):
        return state[0] + self.window_ms


class Cooldowns(_Keyed):
    """A request is accepted when the last accepted one of its key is `cooldown_ms` old."""

    name, fields = "cooldown", {"start": "long"}

    def __init__(self, cooldown_ms: int):
        self.cooldown_ms = cooldown_ms

    def decide(self, held, ts):
        refused = np.ones(len(ts), bool)
        start, at = held[0] if held else None, 0
        if start is not None:
            at = int(np.searchsorted(ts, start + self.cooldown_ms))
        while at < len(ts):
            start = int(ts[at])
            refused[at] = False
            at = max(at + 1, int(np.searchsorted(ts, start + self.cooldown_ms)))
        return (start,), refused

    def last_moment(self, state):
        return state[0] + self.cooldown_ms - 1

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for names, starts in zip(initialState["state_key"], initialState["start"]):
            values = {name: (int(start),) for name, start in zip(names, starts)}
            self.held.put(self.held.get() | values, timerValues.getCurrentWatermarkInMs())


def admission_stream(
    requests: DataFrame,
    graph: Graph,
    policy: str | Sequence[str] = "registered",
    limit: int = RATE_LIMIT,
    window_ms: int = RATE_WINDOW_MS,
    cooldown_ms: int = COOLDOWN_MS,
    allow_hosts: Sequence[str] = ("localhost",),
    delay: str = "10 minutes",
) -> DataFrame:
    """A stream of (request_id, ts, uri, requesting_origin, rule_set, opted_in) → decision and reason, as `admit` gives.

    Pages indexed before the stream starts are in their cooldown as of then. `delay` is how late a request may come.
    """
    spark = graph.spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rules = POLICIES[policy] if isinstance(policy, str) else tuple(policy)
    timed = requests.withColumn("event_time", F.timestamp_millis("ts")).withWatermark("event_time", delay)
    checked = _stateless(timed, graph, rules, allow_hosts)
    # a request without an origin or page is refused already: keyed by itself, it leaves no state
    alone = F.concat(F.lit("?"), F.col("request_id").cast("string"))
    checked = checked.select(*timed.columns, "page", "origin", "rules_ok", "failed")
    rated = _through(checked.withColumn("state_key", F.coalesce("origin", alone)), RateWindows(window_ms, limit))
    ruled = rated.withColumn("failed", F.when(F.col("failed").isNull() & ~F.col("rules_ok"), "rules").otherwise(F.col("failed")))
    before = graph.pages.filter("indexed IS NOT NULL").groupBy(F.col("uri").alias("state_key")).agg(F.max("indexed").alias("start"))
    cooled = _through(
        ruled.withColumn("state_key", F.coalesce("page", alone)), Cooldowns(cooldown_ms), first_values(before, "state_key", "start")
    )
    return cooled.select(
        *requests.columns, "page", "origin", F.col("failed").isNull().alias("accepted"), "failed",
        reason_text("failed").alias("reason"), status_code("failed").alias("status"),
    )


def _through(rows: DataFrame, processor: _Keyed, before=None) -> DataFrame:
    out = StructType([f for f in rows.schema.fields if f.name != "state_key"])
    for field in out.fields:
        field.nullable, field.metadata = True, {}
    return by_bucket(rows, "state_key").transformWithStateInPandas(
        processor, out, "Append", "EventTime", initialState=before, eventTimeColumnName="event_time"
    )
