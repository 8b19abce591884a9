import math
from collections import Counter

import corpus_pipeline
from conftest_llm import table
from pyspark.sql import functions as F

from linkloom.llm import mixing

SF = "/root/testdata/sf0.001"


def test_exponent_meets_entropy_or_repetition(spark):
    sizes = [9000, 500, 400, 100]
    sources = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, tokens long")

    def entropy(a):
        w = [n**a for n in sizes]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w) / math.log(len(sizes))

    a = mixing.exponent(sources, 0.8, 1e9)
    assert abs(entropy(a) - 0.8) < 1e-4
    assert abs((90.0) ** (1 - mixing.exponent(sources, 0.8, 1.5)) - 1.5) < 1e-9
    assert mixing.exponent(sources.limit(1)) == 1.0 and mixing.exponent(sources.limit(0)) == 1.0


def test_stream_keeps_all_and_meets_the_weights(spark, empty, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 30)
    texts = ["w " * 20] * 700 + ["w " * 20] * 200 + ["w " * 20] * 60 + [None, ""]
    sources = ["a"] * 700 + ["b"] * 200 + ["c"] * 60 + [None, None]
    rows = mixing.mixed(table(spark, texts, sources=sources), 0.95, 1.5, 2000).collect()
    assert {r["doc_id"] for r in rows if r["epoch"] == 0} == set(range(len(texts)))
    tokens, weight = Counter(), {}
    for r in rows:
        tokens[r["source"]] += r["tokens"]
        weight[r["source"]] = r["weight"]
    total = sum(tokens.values())
    assert abs(sum(weight.values()) - 1) < 1e-9
    for source, w in weight.items():
        assert abs(tokens[source] / total - w) < 0.005
    per_block = Counter((r["block"], r["source"]) for r in rows)
    blocks = {r["block"] for r in rows}
    assert all(per_block[b, s] > 0 for b in blocks for s in "abc")
    assert len(rows) == len({(r["doc_id"], r["epoch"]) for r in rows})
    assert mixing.mixed(empty).count() == 0


def test_remix_repeats_whole_rows(spark, odd, empty):
    docs = table(spark, ["x y"] * 90 + ["z"] * 10, sources=["a"] * 90 + ["b"] * 10)
    out = mixing.remix(docs, 0.9, 1.5)
    times = Counter(r["doc_id"] for r in out.collect())
    assert out.columns == docs.columns and set(times) == set(range(100)) and set(times.values()) <= {1, 2}
    assert all(times[i] == 1 for i in range(90)) and 4 <= sum(times[i] == 2 for i in range(90, 100)) <= 6
    assert mixing.remix(odd).count() == odd.count() and mixing.remix(empty).count() == 0


def test_stages_keep_the_columns_and_only_drop_or_repeat_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == docs.columns and 0 < after.count(), name
        assert after.join(before, docs.columns, "left_anti").count() == 0, name
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    want = before.groupBy("doc_id").count()
    got = packed.where("piece = 0").groupBy("doc_id").count()
    assert want.exceptAll(got).count() == 0 and got.exceptAll(want).count() == 0
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_stages_on_odd_and_no_rows(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
        stage(spark, odd, SF).collect()


def test_run_equals_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())
