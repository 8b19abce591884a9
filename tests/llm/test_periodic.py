"""Runs of words against brute force, and the query's digests against a plain re-implementation."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest_llm import table
from linkloom.llm import queries
from linkloom.llm.periodic import LEAST, POWER, lyndon_lengths, periodic_runs, runs_of


def brute_runs(words, least, power):
    n, out = len(words), []
    for q in range(1, n // power + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - at + q
            shorter = any(all(words[at + t] == words[at + t + d] for t in range(length - d)) for d in range(1, q))
            if length >= max(least, power * q) and not shorter:
                out.append((at, length, q))
            at = end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_lyndon(ids):
    def lyndon(word):
        return all(word < word[k:] for k in range(1, len(word)))

    return [max(j - i for j in range(i + 1, len(ids) + 1) if lyndon(ids[i:j])) for i in range(len(ids))]


@given(st.lists(st.integers(0, 2), max_size=30))
@settings(max_examples=200, deadline=None)
def test_grouping_gives_the_lyndon_array(ids):
    assert lyndon_lengths(ids) == brute_lyndon(ids)


@pytest.mark.parametrize("least, power", [(24, 3), (2, 2), (6, 2), (5, 4)])
def test_runs_equal_brute_force(least, power):
    rng = random.Random(least)
    for _ in range(200):
        words = []
        for _ in range(rng.randrange(5)):
            root = [rng.randrange(3) for _ in range(rng.randrange(1, 9))]
            words += (root * rng.randrange(1, 12))[: rng.randrange(1, 80)]
        assert runs_of(words, least, power) == brute_runs(words, least, power)


def plain(doc, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words, LEAST, POWER)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in runs)]
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    milli = 1000 * top[1] // top[2] if runs else None
    return (doc, len(runs), *top, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", " \t\n ", "one"]
    while len(texts) < 60:
        words = []
        for _ in range(rng.randrange(1, 6)):
            root = [rng.choice("aé字 bc") + str(rng.randrange(9)) for _ in range(rng.randrange(1, 14))]
            words += root * rng.choice([1, 1, 2, 4, 9])
        texts.append(rng.choice([" ", "\n", " \t "]).join(words))
    ids = [None if k == 7 else k // 2 if k > 50 else k for k in range(len(texts))]
    table(spark, texts, ids).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    want = sorted((plain(d, t) for d, t in zip(ids, texts)), key=repr)
    assert got == want
    assert sum(r[1] > 0 for r in want) > 10


def test_odd_rows(spark, odd, empty):
    rows = periodic_runs(odd).collect()
    assert len(rows) == odd.count()
    long = next(r for r in rows if r["doc_id"] == 8)
    assert [tuple(r) for r in long["runs"]] == [(0, 30_000, 1)] and long["collapsed"] == "word"
    assert sum(r["collapsed"] == "" for r in rows) == 3 and all(r["runs"] is not None for r in rows)
    assert periodic_runs(empty).collect() == []
