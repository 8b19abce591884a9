"""The keyed stream against the batch operator, and that its state expires."""

import pytest
from pyspark.sql import functions as F

from core_helpers import INSTANCE
from linkloom.graph import Graph
from linkloom.sources.shop_graph import requests
from linkloom.streaming.admission import admit
from linkloom.streaming.keyed import Cooldowns, RateWindows, admission_stream

HOUR = 3_600_000
LIMITS = {"limit": 2, "window_ms": 24 * HOUR, "cooldown_ms": 6 * HOUR}


@pytest.fixture(scope="module")
def asked(spark):
    """All requests of some users, from one time on."""
    return requests(spark, "/root/testdata/sf0.001").filter("request_id % 3 = 0").cache()


@pytest.fixture(scope="module")
def users(spark, asked):
    origins = asked.select(F.regexp_extract("uri", "^https://[^/]*", 0).alias("origin")).distinct()
    known = origins.withColumn("verified", F.crc32("origin") % 7 != 0).withColumn("banned", F.lit(False))
    low = asked.agg(F.min("ts")).first()[0]
    pages = asked.select("uri").distinct().limit(5).select("uri", F.lit(low).alias("indexed"))
    empty = Graph.empty(spark, INSTANCE)
    pages = empty.pages.unionByName(pages, allowMissingColumns=True)
    return empty.with_tables(origins=known, pages=pages)


def run(spark, frames, users, folder, checkpoint):
    for rows in frames:
        rows.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)
    decided = admission_stream(stream, users, delay="1 minute", **LIMITS)
    out = checkpoint + "-out"
    decided.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out)


def held(spark, checkpoint, operator, name):
    reader = spark.read.format("statestore").option("path", checkpoint).option("operatorId", operator)
    return reader.option("stateVarName", name).load()


def test_stream_equals_batch_and_state_expires(spark, asked, users, tmp_path):
    low, high = asked.agg(F.min("ts"), F.max("ts")).first()
    step = (high - low) // 3 + 1
    parts = [asked.filter(F.floor((F.col("ts") - low) / step) == k) for k in range(3)]
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    got = run(spark, parts, users, folder, checkpoint)
    want = admit(asked, users, **LIMITS)
    columns = ["request_id", "page", "origin", "accepted", "failed", "reason", "status"]
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(map(tuple, want.select(columns).collect()), key=str)
    assert {r["failed"] for r in got.collect()} >= {None, "origin", "verified", "rate", "rules", "cooldown"}
    # windows that ended before the watermark are gone, later ones are held
    mark = high - 60_000
    windows = [r["value"]["start"] for r in held(spark, checkpoint, 1, "rate").collect()]
    assert windows and all(start + LIMITS["window_ms"] >= mark for start in windows)
    assert len(windows) < want.filter("origin IS NOT NULL").select("origin").distinct().count()
    cooling = [r["value"]["start"] for r in held(spark, checkpoint, 0, "cooldown").collect()]
    assert all(start + LIMITS["cooldown_ms"] > mark for start in cooling)
    # a request two days on leaves nothing of what was there
    last = asked.limit(1).withColumns({"ts": F.lit(high + 48 * HOUR), "request_id": F.lit(-1).cast(asked.schema["request_id"].dataType)})
    run(spark, [last], users, folder, checkpoint)
    assert held(spark, checkpoint, 1, "rate").count() <= 1 and held(spark, checkpoint, 0, "cooldown").count() <= 1


def test_windows_and_cooldowns_step_by_step():
    import numpy as np

    rate = RateWindows(10, 2)
    state, refused = rate.decide(None, np.array([0, 1, 10, 11, 11, 12, 30]))
    assert refused.tolist() == [False, False, True, False, False, True, False] and state == (30, 1)
    state, refused = rate.decide((0, 1), np.array([5, 6]))
    assert refused.tolist() == [False, True] and state == (0, 2)
    cool = Cooldowns(10)
    state, refused = cool.decide((0,), np.array([9, 10, 10, 19, 20]))
    assert refused.tolist() == [True, False, True, True, False] and state == (20,)
    assert cool.last_moment((20,)) == 29 and rate.last_moment((30, 1)) == 40
