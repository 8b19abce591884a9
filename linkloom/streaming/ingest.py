"""Stream jobs: duplicate suppression, admission and incremental ingest.

The admission stream keeps its state as tables written per micro-batch, so a hot origin
is handled by the same distributed operator as in batch, and a replayed batch reads the
state of the batch before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkloom.functions.urls import normalize
from linkloom.graph import Graph
from linkloom.operators.store import GraphStore
from linkloom.streaming.admission import COOLDOWN_MS, RATE_LIMIT, RATE_WINDOW_MS, admit, window_usage

RATE_SCHEMA = "key string, start long, used long"
LAST_SCHEMA = "key string, start long"


def distinct_requests(requests: DataFrame, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Drop repeated requests for a page within the watermark; later rows are dropped."""
    timed = requests.withColumn("event_time", F.timestamp_millis(F.col(ts)))
    timed = timed.withColumn("page", normalize("uri")).withWatermark("event_time", delay)
    return timed.dropDuplicatesWithinWatermark(["page"])


def ingest_stream(
    pages: DataFrame,
    store: GraphStore,
    harvest: Callable[[DataFrame], DataFrame],
    now_ms: Callable[[int], int],
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Harvest and upsert each micro-batch; one the store has committed is skipped.

    Streams number their batches from 0, so each checkpoint folder is a writer of its own.
    """
    writer = "stream-" + hashlib.md5(checkpoint.encode()).hexdigest()

    def upsert(df: DataFrame, batch: int) -> None:
        store.ingest(batch, harvest(df), now_ms(batch), writer)

    return (
        pages.writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


class AdmissionStream:
    """Decisions of micro-batches, with rate windows and acceptances carried between them."""

    def __init__(
        self,
        graph: Graph,
        root: str,
        limit: int = RATE_LIMIT,
        window_ms: int = RATE_WINDOW_MS,
        cooldown_ms: int = COOLDOWN_MS,
        **rules,
    ):
        self.graph = graph
        self.root = root.rstrip("/")
        self.limit, self.window_ms, self.cooldown_ms = limit, window_ms, cooldown_ms
        self.rules = rules

    def _read(self, name: str, batch: int, schema: str) -> DataFrame:
        spark = self.graph.spark
        if batch < 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.root}/{name}/batch_id={batch}")

    def process(self, requests: DataFrame, batch: int) -> None:
        rate = self._read("rate", batch - 1, RATE_SCHEMA)
        last = self._read("accepted", batch - 1, LAST_SCHEMA)
        if batch == 0:
            last = self.graph.pages.filter("indexed IS NOT NULL").select(
                F.col("uri").alias("key"), F.col("indexed").alias("start")
            )
        decided = admit(
            requests,
            self.graph,
            limit=self.limit,
            window_ms=self.window_ms,
            cooldown_ms=self.cooldown_ms,
            rate_state=rate,
            last_accepted=last,
            **self.rules,
        )
        out = f"{self.root}/decisions/batch_id={batch}"
        decided.write.mode("overwrite").parquet(out)
        decided = self.graph.spark.read.parquet(out)

        # requests that reached the rate limit used up quota
        counted = decided.filter("failed IS NULL OR failed IN ('rate', 'rules', 'cooldown')")
        usage = window_usage(counted, "origin", self.window_ms, self.limit, rate)
        untouched = rate.join(usage.select("key"), "key", "left_anti")
        usage.unionByName(untouched).write.mode("overwrite").parquet(f"{self.root}/rate/batch_id={batch}")

        newer = decided.filter("accepted").select(F.col("page").alias("key"), F.col("ts").alias("start"))
        last.unionByName(newer).groupBy("key").agg(F.max("start").alias("start")).write.mode(
            "overwrite"
        ).parquet(f"{self.root}/accepted/batch_id={batch}")

    def start(self, requests: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        return (
            requests.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def decisions(self) -> DataFrame:
        return self.graph.spark.read.parquet(f"{self.root}/decisions")
