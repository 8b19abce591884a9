"""State of many keys in one value: each call to a state store from Python costs a round trip, so keys share it by buckets.

A bucket holds the newest time of its keys, which its timer follows, and the keys with their values as arrays. What the
watermark has passed is left out each time the bucket is written, and the bucket goes with its newest value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: a micro-batch makes at most this many calls; a bucket is written with all the keys it holds
BUCKETS = 2048


def _bucket(key: str | Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def first_values(values: DataFrame, key: str, *fields: str) -> GroupedData:
    """Values from before the stream, put together without Python: one row per bucket, with arrays."""
    held = F.collect_list(F.struct(key, *fields)).alias("of")
    rows = values.withColumn("state_bucket", _bucket(key)).groupBy("state_bucket").agg(held)
    return rows.select("state_bucket", *[F.col(f"of.{f}").alias(f) for f in (key, *fields)]).groupBy("state_bucket")


def by_bucket(rows: DataFrame, key: str | Column) -> GroupedData:
    """The rows in groups of keys of one hash."""
    return rows.withColumn("state_bucket", _bucket(key)).groupBy("state_bucket")


def bucket_schema(newest: str, fields: dict[str, str]) -> str:
    return f"{newest} long, keys array<string>, " + ", ".join(f"{n}_of array<{t}>" for n, t in fields.items())


def stretches(sorted_keys: np.ndarray) -> Iterator[tuple[str, int, int]]:
    """(key, begin, end) of each stretch of equal keys."""
    n = len(sorted_keys)
    cuts = np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1
    for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), n]):
        if end > at:
            yield sorted_keys[at], at, end


class Bucket:
    """The values of a bucket, tuples whose first field is a time; `ends` gives when a value may go."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, schema: str, ends: Callable[[tuple], int]):
        self.handle, self.ends = handle, ends
        self.state = handle.getValueState(name, schema)
        self.timed = False

    def get(self) -> dict[str, tuple]:
        """The value of each key."""
        found = self.state.get()
        self.timed = found is not None
        return dict(zip(found[1], zip(*found[2:]))) if found else {}

    def put(self, values: dict[str, tuple], watermark: int) -> None:
        """Write what `get` gave, as changed since, but for the values that the watermark has passed."""
        kept = {key: value for key, value in values.items() if self.ends(value) > watermark}
        if not kept:
            if self.timed:  # the timer that is left finds nothing
                self.state.clear()
            return
        newest = max(kept.values(), key=self.ends)
        self.state.update((newest[0], list(kept), *map(list, zip(*kept.values()))))
        if not self.timed:
            self.handle.registerTimer(self.ends(newest))

    def expire(self, watermark: int) -> None:
        """A timer has come: clear the bucket, or let it wait for the newest value it has got since."""
        values = self.get()
        self.timed = False  # Spark takes the expired timer away
        if values and max(map(self.ends, values.values())) <= watermark:
            self.state.clear()
        elif values:
            self.put(values, watermark)
