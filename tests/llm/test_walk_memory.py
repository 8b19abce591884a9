"""What a task of the trie walk holds."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from linkloom.llm import trie


def keys(rows):
    """Rows (tab, key) of one pair of nodes for each tab, as a sorted table."""
    n = len(rows)
    tabs, found = np.array([r[0] for r in rows], np.int32), np.array([r[1] for r in rows], np.int64)
    payload = pa.array([int(k).to_bytes(32, "big") for k in found], pa.binary())
    zeros = np.zeros(n, np.int64)
    return pa.table({"tab": tabs, "key": found, "item": np.arange(n), "payload": payload, "a": zeros, "b": zeros,
                     "side": zeros.astype(np.int32)})


def test_groups_stay_whole_whatever_the_batches(monkeypatch):
    rng = random.Random(1)
    table = keys(sorted((rng.randint(0, 30), rng.randint(0, 99)) for _ in range(2_000)))
    for limit in (5, 60, 5_000):
        monkeypatch.setattr(trie, "WALK_KEYS", limit)
        parts = list(trie.whole_groups(iter(table.to_batches(max_chunksize=7)), ("tab", "a", "b")))
        assert pa.concat_tables(parts).equals(table)
        tabs = [set(p["tab"].to_pylist()) for p in parts]
        assert sum(map(len, tabs)) == len(set().union(*tabs))


def test_a_walk_holds_little_beside_its_rows():
    """A hundred thousand random keys under one node took 39 MB."""
    rng = np.random.default_rng(2)
    table = keys([(0, k) for k in rng.integers(0, 2**17, 100_000)])
    tracemalloc.start()
    try:
        u, _ = trie.walk(table, 17, 0, 1, lambda x, y: np.zeros(len(x), bool))
        assert not len(u) and tracemalloc.get_traced_memory()[1] < 25 << 20
    finally:
        tracemalloc.stop()


def test_payloads_of_slices_and_chunks():
    rows = keys([(0, k) for k in range(20)])
    column = pa.concat_tables([rows.slice(3, 5), rows.slice(11, 2)])["payload"]
    assert [bytes(r) for r in trie._fixed_bytes(column)] == column.to_pylist()
