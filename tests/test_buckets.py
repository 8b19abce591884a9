"""Keyed state by buckets: many keys in few calls, values pruned by the watermark."""

from linkloom.streaming.buckets import Bucket, bucket_schema, by_bucket, first_values, stretches

import numpy as np


class Handle:
    """A store of one key that counts its calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


def test_a_thousand_keys_take_three_calls():
    handle = Handle()
    held = Bucket(handle, "last", bucket_schema("ts", {"ts": "long"}), lambda v: v[0] + 10)
    values = held.get() | {f"k{i}": (i,) for i in range(1000)}
    held.put(values, 0)
    assert handle.calls == 3 and handle.timers == [1009] and handle.value[0] == 999
    assert held.get() == values
    held.put(held.get() | {"new": (5000,)}, 1004)  # values that end by 1004 are gone; the timer stays
    assert set(held.get()) == {f"k{i}" for i in range(995, 1000)} | {"new"} and handle.timers == [1009]
    held.expire(1009)
    assert held.get() == {"new": (5000,)} and handle.timers == [1009, 5010]
    held.expire(5010)
    assert handle.value is None and held.get() == {}


def test_stretches_of_equal_keys():
    assert list(stretches(np.array(["a", "a", "b"], object))) == [("a", 0, 2), ("b", 2, 3)]
    assert list(stretches(np.array([], object))) == []


def test_values_from_before_come_as_one_row_per_bucket(spark):
    values = spark.range(20_000).selectExpr("concat('https://a.example/', id) AS key", "id AS start")
    rows = first_values(values, "key", "start").count().collect()
    assert len(rows) <= 2048 and all(r["count"] == 1 for r in rows)
    assert {r["state_bucket"] for r in rows} == {r["state_bucket"] for r in by_bucket(values, "key").count().collect()}
