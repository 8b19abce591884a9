"""Needle tables against `contains`."""

import random

import pytest

from linkloom.operators.filters import filter_by_needles
from linkloom.operators.needles import with_needles, without_needles


def frame(spark, values, name):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def words(seed, n, alphabet="abé/😀\n", longest=9):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("shard_texts", [200_000, 3])
def test_same_as_contains(spark, shard_texts):
    texts = [*words(1, 300), None, None, "x" * 50_000 + "needle", "50%_\\"]
    needles = [*(w for w in words(2, 40, longest=5) if w), None, "needle", "%_", "zzz", "b", "b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, uri string")
    want = {k for k, t in enumerate(texts) if t is not None and any(n in t for n in needles if n)}
    table = frame(spark, needles, "uri")
    assert {r["id"] for r in with_needles(rows, "uri", table, shard_texts).collect()} == want
    assert {r["id"] for r in without_needles(rows, "uri", table, shard_texts).collect()} == set(range(len(texts))) - want


def test_edges_of_the_needles(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("", "y"), (None, "z")], "dst string, _text string")
    assert with_needles(rows, "dst", frame(spark, [""], "n")).count() == 3
    assert with_needles(rows, "dst", frame(spark, [None], "n")).count() == 0
    assert with_needles(rows, "dst", frame(spark, [], "n")).count() == 0
    assert without_needles(rows, "dst", frame(spark, [], "n")).count() == 4
    assert with_needles(rows, "dst", frame(spark, ["a"], "n")).count() == 2
    assert with_needles(rows.limit(0), "dst", frame(spark, ["a"], "n")).columns == ["dst", "_text"]
    both = filter_by_needles(rows, include=frame(spark, ["a", ""], "n"), exclude=frame(spark, ["a"], "n"))
    assert [tuple(r) for r in both.collect()] == [("", "y")]


def test_ten_thousand_needles_without_a_nested_loop(spark):
    rows = spark.range(5_000).selectExpr("id", "concat('https://s', id % 700, '.example/p/', id) AS dst")
    needles = spark.range(10_000).selectExpr("concat('/p/', id * 7) AS needle")
    found = with_needles(rows, "dst", needles)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    named = {str(k * 7) for k in range(10_000)}
    want = {k for k in range(5_000) if any(str(k)[:n] in named for n in range(1, 5))}
    assert {r["id"] for r in found.collect()} == want


def test_needles_of_frequent_pieces_meet_only_texts_that_hold_them(spark):
    """Digits make every piece a piece of many texts; needles are looked up whole, not compared with all of those."""
    texts = [f"https://s{k % 97}.example/p/{k * 31 % 10_007}😀" for k in range(3_000)]
    needles = [f"/p/{k * 4 + 1}" for k in range(2_500)] + [f"s{k}." for k in range(1, 97, 2)] + ["0😀", "p", "7😀x", None]
    found = with_needles(frame(spark, texts, "dst"), "dst", frame(spark, needles[:-3], "n"))
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "contains(" not in plan and "nestedloop" not in plan
    assert sorted(r["dst"] for r in found.collect()) == sorted(t for t in texts if any(n in t for n in needles[:-3]))
    every = with_needles(frame(spark, texts, "dst"), "dst", frame(spark, needles, "n"))
    assert every.count() == len(texts)
