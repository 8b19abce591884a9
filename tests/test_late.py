"""Every row of a stream is kept, repeated or late, in the stream and in the ledger."""

from linkloom.streaming.late import Ledger, judged_requests, late_rows

MIN = 60_000
SCHEMA = "request_id long, ts long, uri string, outcome string"
U, V = "https://a.example/1", "https://b.example/2"


def run(spark, batches, folder, name, span=10 * MIN, delay="5 minutes"):
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    ledger = Ledger(name)
    spark.streams.addListener(ledger)
    try:
        sink = judged_requests(stream, span, delay).writeStream.queryName(name)
        sink = sink.option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True)
        sink.start(f"{folder}/out").awaitTermination()
        lines = [tuple(r) for r in ledger.frame(spark).drop("watermark").orderBy("batch").collect()]
    finally:
        spark.streams.removeListener(ledger)
    judged = spark.read.parquet(f"{folder}/out")
    late = late_rows(spark.read.parquet(f"{folder}/in"), judged)
    return {r["request_id"]: r["outcome"] for r in judged.collect()}, {r["request_id"] for r in late.collect()}, lines, ledger


def test_kept_repeated_and_late(spark, tmp_path):
    hour = 60 * MIN
    batches = [
        [(1, hour, U, "x"), (2, hour + MIN, U + "/", None), (3, hour, V, None), (4, hour + 10 * MIN, U, None)],
        [(5, 2 * hour, V, None), (6, hour + 15 * MIN, U, None)],
        # the watermark of the first batch, 65 minutes, holds for the third
        [(7, hour + 4 * MIN, U, None), (8, hour + 12 * MIN, U, None), (9, hour + 21 * MIN, U, None), (10, 2 * hour + MIN, V, None)],
        [(11, hour + 30 * MIN, U, None), (12, 2 * hour + 11 * MIN, V, None)],
    ]
    outcome, late, lines, ledger = run(spark, batches, str(tmp_path), "late-a")
    assert late == {7, 11}
    assert {k for k, v in outcome.items() if v == "kept"} == {1, 3, 4, 5, 9, 12}
    assert {k for k, v in outcome.items() if v == "repeated"} == {2, 6, 8, 10}
    assert lines == [(0, 4, 3, 1, 0), (1, 2, 1, 1, 0), (2, 4, 1, 2, 1), (3, 2, 1, 0, 1)]
    assert ledger.totals() == {"n_in": 12, "n_kept": 6, "n_repeated": 4, "n_late": 2}
    held = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "last").load()
    assert [r["value"]["ts"] for r in held.collect()] == [2 * hour + 11 * MIN]


def test_nulls_and_equal_rows(spark, tmp_path):
    rows = [(1, None, U, None), (2, None, U, None), (3, MIN, None, None), (4, MIN, None, None), (5, MIN, U, None), (5, MIN, U, None)]
    outcome, late, lines, _ = run(spark, [rows], str(tmp_path), "late-b")
    assert lines == [(0, 6, 5, 1, 0)] and not late
    assert all(outcome[k] == "kept" for k in (1, 2, 3, 4))


def test_ledger_holds_sums_of_lines_that_left():
    ledger = Ledger("q", keep=2)
    for k in range(4):
        ledger.add((k, None, 10, 5, 3, 2))
    assert list(ledger.lines) == [2, 3]
    assert ledger.totals() == {"n_in": 40, "n_kept": 20, "n_repeated": 12, "n_late": 8}
