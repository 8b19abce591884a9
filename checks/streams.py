"""Request admission over the event table, as batch jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.functions import normal_sql, origin_sql
from checks.registry import check
from linkloom.sources.shop_graph import read, requests, shop_graph
from linkloom.session import shared_dir
from linkloom.streaming import admission, keyed, late

DAY = 86_400_000
COOLDOWN = 6 * 3_600_000


def walk(name: str, rows: str, span: int) -> str:
    """Window starts of (key, t) rows, one window per step."""
    return f"""{name}_w AS (SELECT key, min(t) AS s FROM {rows} GROUP BY key
        UNION ALL SELECT w.key, min(r.t) FROM {name}_w w JOIN {rows} r ON r.key = w.key AND r.t > w.s + {span}
        GROUP BY w.key, w.s)"""


_BASE = f"""WITH RECURSIVE rq AS (SELECT *, {origin_sql('uri')} AS origin, {normal_sql('uri')} AS page FROM lg_requests),
    base AS (SELECT origin AS key, ts AS t, request_id FROM rq),
    {walk('rate', 'base', DAY)},
    placed AS (SELECT b.*, (SELECT max(s) FROM rate_w w WHERE w.key = b.key AND w.s <= b.t) AS s FROM base b),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY key, s ORDER BY t, request_id) <= 2 AS within FROM placed)"""


@check("stream_t01_rate_limit", _BASE + " SELECT request_id, within FROM ranked")
def _(spark, d):
    rows = requests(spark, d).withColumn("origin", admission.origin("uri"))
    return admission.rate_limited(rows, "origin", 2, DAY).select("request_id", "within")


_COOL = f"""WITH RECURSIVE rq AS (SELECT request_id, ts AS t, {normal_sql('uri')} AS key FROM lg_requests),
    {walk('cool', 'rq', COOLDOWN - 1)},
    firsts AS (SELECT key, t, min(request_id) AS request_id FROM rq GROUP BY key, t)
    SELECT request_id, request_id IN (SELECT f.request_id FROM firsts f JOIN cool_w w ON f.key = w.key AND f.t = w.s)
           AS accepted FROM rq"""


@check("stream_t02_cooldown", _COOL)
def _(spark, d):
    rows = requests(spark, d).withColumn("page", admission.normalize("uri"))
    return admission.cooled_down(rows, "page", COOLDOWN).select("request_id", "accepted")


_ONE = """WITH RECURSIVE one AS (SELECT DISTINCT 'all' AS key, ts AS t FROM lg_requests),
    {walk} SELECT t, (SELECT max(s) FROM hot_w WHERE s <= t) AS start FROM one"""


def _one_key(name: str, span: int) -> None:
    @check(name, _ONE.format(walk=walk("hot", "one", span)))
    def _(spark, d):
        """All requests under one key, walked slot by slot."""
        times = requests(spark, d).select(F.lit("all").alias("key"), F.col("ts").alias("t")).distinct()
        return admission.window_starts(times, span, walk_rows=0).select("t", "start")


_one_key("stream_t01_hot_key", DAY)
_one_key("stream_t02_hot_key_short_span", 3_600_000)


def known_users(spark, d):
    """A graph that knows the origins of the requesting users, but one in seven."""
    k = F.col("user_id")
    users = read(spark, d, "events").select("user_id").distinct().select(
        F.concat(F.lit("https://u"), k.cast("string"), F.lit(".example")).alias("origin"),
        (k % 7 != 0).alias("verified"),
        F.lit(False).alias("banned"),
    )
    return shop_graph(spark, d).with_tables(origins=users)


_ADMIT = f"""WITH RECURSIVE rq AS (SELECT *, {origin_sql('uri')} AS origin, {normal_sql('uri')} AS page,
      CAST(regexp_extract(uri, 'https://u([0-9]+)', 1) AS BIGINT) AS u FROM lg_requests),
    pre AS (SELECT *, CASE WHEN origin <> requesting_origin THEN 'origin' WHEN u % 7 = 0 THEN 'verified' END AS f FROM rq),
    base AS (SELECT origin AS key, ts AS t, request_id FROM pre WHERE f IS NULL),
    {walk('rate', 'base', DAY)},
    placed AS (SELECT b.*, (SELECT max(s) FROM rate_w w WHERE w.key = b.key AND w.s <= b.t) AS s FROM base b),
    within AS (SELECT request_id FROM (SELECT *, row_number() OVER (PARTITION BY key, s ORDER BY t, request_id) AS n
      FROM placed) WHERE n <= 2),
    mid AS (SELECT *, CASE WHEN f IS NOT NULL THEN f WHEN request_id NOT IN (SELECT request_id FROM within) THEN 'rate'
      WHEN rule_set <> 'default' THEN 'rules' END AS g FROM pre),
    left_over AS (SELECT page AS key, ts AS t, request_id FROM mid WHERE g IS NULL),
    {walk('cool', 'left_over', COOLDOWN - 1)},
    firsts AS (SELECT key, t, min(request_id) AS request_id FROM left_over GROUP BY key, t),
    good AS (SELECT f.request_id FROM firsts f JOIN cool_w w ON f.key = w.key AND f.t = w.s),
    done AS (SELECT request_id, coalesce(g, CASE WHEN request_id NOT IN (SELECT request_id FROM good) THEN 'cooldown' END)
      AS failed FROM mid)"""


def decided(spark, d):
    return admission.admit(
        requests(spark, d), known_users(spark, d), limit=2, window_ms=DAY, cooldown_ms=COOLDOWN
    )


@check("stream_t03_admission", _ADMIT + " SELECT request_id, failed, failed IS NULL AS accepted FROM done")
def _(spark, d):
    return decided(spark, d).select("request_id", "failed", "accepted")


@check("stream_t03_keyed_state", _ADMIT + " SELECT request_id, failed, failed IS NULL AS accepted FROM done")
def _(spark, d):
    """The same decisions by the stream with keyed state, over three micro-batches in the order of time."""
    folder = f"{shared_dir(spark)}/keyed-{uuid.uuid4().hex}"
    rows = requests(spark, d)
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    part = F.floor((F.col("ts") - low) * 3 / (high - low + 1))
    for k in range(3):
        rows.filter(part == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    done = keyed.admission_stream(stream, known_users(spark, d), limit=2, window_ms=DAY, cooldown_ms=COOLDOWN)
    sink = done.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    sink.start(f"{folder}/out").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("request_id", "failed", "accepted")


@check(
    "stream_t06_status_codes",
    _ADMIT + """ SELECT status, count(*) AS n FROM (SELECT CASE failed WHEN 'origin' THEN 403 WHEN 'verified' THEN 401
       WHEN 'rate' THEN 429 WHEN 'rules' THEN 403 ELSE 200 END AS status FROM done) GROUP BY status""",
)
def _(spark, d):
    return decided(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@check(
    "stream_t08_distinct_pages",
    f"SELECT DISTINCT {normal_sql('uri')} AS page FROM lg_requests",
)
def _(spark, d):
    return requests(spark, d).select(admission.normalize("uri").alias("page")).distinct()


# Six micro-batches: four parts of the time, and every ninth request two micro-batches later than the others of its time.
# Rows are late from the watermark of the micro-batch before on, so the one that takes two of them into account is L.
LATE_DELAY = 2 * 3_600_000
_TIMED = f"""WITH RECURSIVE bounds AS (SELECT min(ts) AS low, max(ts) AS high FROM lg_requests),
    rq AS (SELECT request_id, ts, {normal_sql('uri')} AS page,
      (ts - low) * 4 // (high - low + 1) + CASE WHEN request_id % 9 = 0 THEN 2 ELSE 0 END AS b FROM lg_requests, bounds),
    tops AS (SELECT b, max(ts) AS top FROM rq GROUP BY b),
    marks AS (SELECT t.b, (SELECT max(u.top) FROM tops u WHERE u.b <= t.b - 2) - {LATE_DELAY} AS mark FROM tops t),
    arrived AS (SELECT rq.*, coalesce(ts <= mark, FALSE) AS late FROM rq JOIN marks USING (b)),
    timely AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY b, ts, request_id) AS pos
      FROM arrived WHERE NOT late),
    kept AS (SELECT page, pos, ts, request_id FROM timely WHERE pos = 1
      UNION ALL SELECT n.page, n.nxt.pos, n.nxt.ts, n.nxt.request_id FROM (
        SELECT k.page, min(struct_pack(pos := r.pos, ts := r.ts, request_id := r.request_id)) AS nxt
        FROM kept k JOIN timely r ON r.page = k.page AND r.pos > k.pos AND r.ts >= k.ts + {COOLDOWN}
        GROUP BY k.page) n),
    judged AS (SELECT request_id, b, CASE WHEN late THEN 'late'
      WHEN request_id IN (SELECT request_id FROM kept) THEN 'kept' ELSE 'repeated' END AS outcome FROM arrived)"""


def judged_stream(spark, d):
    """The requests of six files, in order, as judged by the stream, and its ledger."""
    run = uuid.uuid4().hex
    folder = f"{shared_dir(spark)}/late-{run}"
    rows = requests(spark, d)
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    part = F.floor((F.col("ts") - low) * 4 / (high - low + 1)) + F.when(F.col("request_id") % 9 == 0, 2).otherwise(0)
    for k in range(6):
        rows.filter(part == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    ledger = late.Ledger(f"late-{run}")
    spark.streams.addListener(ledger)
    try:
        sink = late.judged_requests(stream, COOLDOWN, f"{LATE_DELAY} milliseconds").writeStream.queryName(f"late-{run}")
        sink = sink.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        sink.start(f"{folder}/out").awaitTermination()
        lines = ledger.frame(spark)
    finally:
        spark.streams.removeListener(ledger)
    return rows, spark.read.parquet(f"{folder}/out"), lines


@check("stream_t08_outcomes", _TIMED + " SELECT request_id, outcome FROM judged")
def _(spark, d):
    """Each request as kept, repeated or late by the stream with keyed state and watermark."""
    rows, judged, _ = judged_stream(spark, d)
    missed = late.late_rows(rows, judged).select("request_id", F.lit("late").alias("outcome"))
    return judged.select("request_id", "outcome").unionByName(missed)


@check(
    "stream_t08_ledger",
    _TIMED + """ SELECT b AS batch, count(*) AS n_in, count(*) FILTER (outcome = 'kept') AS n_kept,
       count(*) FILTER (outcome = 'repeated') AS n_repeated, count(*) FILTER (outcome = 'late') AS n_late
       FROM judged GROUP BY b""",
)
def _(spark, d):
    """What the listener counted per micro-batch."""
    return judged_stream(spark, d)[2].drop("watermark")
