"""Duplicate suppression as a stream that accounts for every row: kept, repeated or late.

A request repeats the last kept one of its page when it comes less than `span_ms` after it, in event time, or before it.
Requests count in the order of the micro-batches, and of ts and request_id within one. A row without a time or a page has
nothing to repeat and is kept. The state of a page is the time of its last kept request and goes once the watermark has
passed the end of its span, as no later row can depend on it. Pages share the calls to the state store by buckets.

Spark drops rows that are older than the watermark before they reach the state. `Ledger` counts them: the rows of a
micro-batch are observed before the state and after it, and what is missing is late. `late_rows` finds them.
"""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from linkloom.functions.urls import normalize
from linkloom.streaming.buckets import ROCKSDB, Bucket, bucket_schema, by_bucket, stretches

LEDGER = "batch long, watermark string, n_in long, n_kept long, n_repeated long, n_late long"
KEPT, REPEATED = "kept", "repeated"


class LastKept(StatefulProcessor):
    """The times of the last kept requests of a bucket's pages, each there to the end of its span."""

    def __init__(self, span_ms: int):
        self.span_ms = span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = Bucket(handle, "last", bucket_schema("ts", {"ts": "long"}), lambda value: value[0] + self.span_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["page", "ts", "request_id"], ignore_index=True)
        outcome = np.full(len(pdf), KEPT, object)
        named = np.flatnonzero((pdf["ts"].notna() & pdf["page"].notna()).to_numpy())
        if len(named):
            values, changed = self.last.get(), False
            ts, judged = pdf["ts"].to_numpy()[named].astype(np.int64), np.full(len(named), REPEATED, object)
            for page, at, end in stretches(pdf["page"].to_numpy(object)[named]):
                before = values.get(page)
                last = self._walk(before and before[0], ts[at:end], judged[at:end])
                if before is None or last != before[0]:
                    values[page], changed = (last,), True
            outcome[named] = judged
            if changed:
                self.last.put(values, timerValues.getCurrentWatermarkInMs())
        pdf["outcome"] = outcome
        yield pdf

    def _walk(self, last: int | None, ts: np.ndarray, outcome: np.ndarray) -> int:
        """Marks the kept ones of a page's sorted times and gives the last one, or the one before."""
        at = 0 if last is None else int(np.searchsorted(ts, last + self.span_ms))
        while at < len(ts):
            outcome[at], last = KEPT, int(ts[at])
            at = max(at + 1, int(np.searchsorted(ts, last + self.span_ms)))
        return last

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.expire(timerValues.getCurrentWatermarkInMs())
        yield from ()

    def close(self) -> None:
        pass


def judged_requests(requests: DataFrame, span_ms: int, delay: str = "10 minutes") -> DataFrame:
    """A stream of (request_id, ts, uri, …) → the rows that were in time, with page and outcome: kept or repeated.

    A column of the name page, outcome or state_bucket is replaced. Rows of equal ts and request_id are taken one after the
    other, so the second of them repeats the first.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = requests.drop("outcome", "state_bucket").withColumn("page", normalize("uri"))
    timed = timed.withColumn("event_time", F.timestamp_millis("ts"))
    timed = timed.observe("arrived", F.count(F.lit(1)).alias("n")).withWatermark("event_time", delay)
    # a row with nothing to repeat has a key of its own and leaves no state
    alone = F.concat(F.lit("?"), F.uuid())
    key = F.when(F.col("ts").isNull(), alone).otherwise(F.coalesce("page", alone))
    fields = [f for f in timed.schema.fields if f.name != "event_time"]
    out = StructType.fromJson(StructType(fields + [timed.schema["event_time"]]).jsonValue()).add("outcome", "string")
    for field in out.fields:
        field.nullable, field.metadata = True, {}
    judged = by_bucket(timed, key).transformWithStateInPandas(
        LastKept(span_ms), out, "Append", "EventTime", eventTimeColumnName="event_time"
    )
    judged = judged.observe(
        "judged", F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == KEPT).alias("n_kept")
    )
    return judged.drop("event_time")


class Ledger(StreamingQueryListener):
    """Counts the rows of each micro-batch of the named query: in, kept, repeated, late.

    A micro-batch that is run again after a failure replaces its earlier line. The newest `keep` micro-batches are held;
    `totals` adds those that left, so no row is lost from the sums.
    """

    def __init__(self, query_name: str, keep: int = 10_000):
        self.query_name, self.keep = query_name, keep
        self.lines: OrderedDict[int, tuple] = OrderedDict()
        self.left = [0, 0, 0, 0]
        self.ids: set = set()
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        if event.name == self.query_name:
            self.ids.add(event.runId)
            self.ended.clear()

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if progress.name != self.query_name or "arrived" not in progress.observedMetrics:
            return
        n_in = progress.observedMetrics["arrived"].n or 0
        judged = progress.observedMetrics["judged"]
        n, kept = judged.n or 0, judged.n_kept or 0
        if n_in or n:
            self.add((progress.batchId, progress.eventTime.get("watermark"), n_in, kept, n - kept, n_in - n))

    def add(self, line: tuple) -> None:
        self.lines[line[0]] = line
        while len(self.lines) > self.keep:
            _, old = self.lines.popitem(last=False)
            self.left = [a + b for a, b in zip(self.left, old[2:])]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId in self.ids:
            self.ended.set()

    def totals(self) -> dict[str, int]:
        sums = [a + sum(line[k] for line in self.lines.values()) for k, a in enumerate(self.left, 2)]
        return dict(zip(("n_in", "n_kept", "n_repeated", "n_late"), sums))

    def frame(self, spark: SparkSession, timeout: float = 60) -> DataFrame:
        """The lines as rows; after the query's end, as Spark reports to listeners a little later."""
        if not self.ended.wait(timeout):
            raise TimeoutError(f"no end of query {self.query_name} was reported within {timeout} seconds")
        return spark.createDataFrame(list(self.lines.values()), LEDGER)


def late_rows(requests: DataFrame, judged: DataFrame, by: str = "request_id") -> DataFrame:
    """The rows of the stream's input, read as a table, that were dropped as late; `by` names each row."""
    return requests.join(judged.select(by), by, "left_anti")
