"""Self-join of bit keys within a few differing bits, by walking pairs of nodes of a binary trie.

The walk goes down both nodes of a pair together, adds up the bits in which their paths differ and drops a pair as
soon as that passes the budget. The top of the walk is a Spark shuffle: a key goes to every pair of prefixes within
the budget, so each pair of nodes meets in one task. The prefix is as long as the number of keys asks for, and pairs
that are still too large are taken further down before they are walked. Below, a task walks all its pairs at once.

A walk returns a spanning forest of the links it finds, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import stored

#: keys under one pair of nodes that a task may hold
NODE_KEYS = 60_000
#: keys a task walks at once, node pairs it holds at once, pairs of keys below which it compares them directly
WALK_KEYS, FRONTIER, DIRECT = 50_000, 20_000, 48
#: pairs of keys it compares at once
PAIRS = 50_000
#: bytes of keys and payloads a task walks at once, and pairs whose ragged payloads it compares at once
WALK_BYTES, COSTLY = 16 << 20, 2_000
STEP = 6
#: rows that a row of a group is compared with before it is looked up which are still unconnected
COMPARED = 16

Accept = Callable[[np.ndarray, np.ndarray], np.ndarray]


def trie_links(keys: DataFrame, width: int, budget: int, accept: Accept | None = None,
               ragged: bool = False, node_keys: int | None = None) -> DataFrame:
    """Links (u, v) that connect all items whose keys differ in at most `budget` of `width` bits.

    keys: tab int, key long (the low `width` bits count), item long, payload binary or null. Only keys of one `tab`
    meet. `accept` gets the payloads of pairs as two arrays of bytes, of byte strings if they are `ragged`, and says which
    pairs count. `node_keys`: keys under one pair of nodes that a task may hold.
    """
    node_keys = node_keys or NODE_KEYS
    total = keys.groupBy("tab").count().agg(F.max("count")).first()[0] or 0
    depth = min(width, max(0, (4 * int(total) // node_keys).bit_length()))
    todo = keys.select("tab", "key", "item", "payload", *_pairs(F.col("key"), width, depth, budget))
    found = None
    while True:
        sizes = keys.select("tab", _prefix(F.col("key"), width, depth).alias("p")).groupBy("tab", "p").count()
        heavy = (sizes.agg(F.max("count")).first()[0] or 0) > node_keys and depth < width
        light = todo
        if heavy:
            todo = stored(todo, "nodes")
            pairs = todo.groupBy("tab", "a", "b").agg(F.count("*").alias("n"))
            large = pairs.where(F.col("n") > 2 * node_keys).select("tab", "a", "b")
            light = todo.join(large, ["tab", "a", "b"], "left_anti")
        links = _walk(light, width, depth, budget, accept, ragged)
        found = links if found is None else found.unionByName(links)
        if not heavy:
            return found
        more = min(STEP, width - depth)
        todo = todo.join(large, ["tab", "a", "b"], "left_semi")
        todo = todo.select("tab", "key", "item", "payload", *_below(width, depth, more, budget))
        depth += more


def _prefix(key: Column, width: int, depth: int) -> Column:
    return F.lit(0).cast("long") if depth == 0 else F.shiftrightunsigned(key, width - depth).bitwiseAND(2**depth - 1)


def _masks(bits: int, budget: int) -> list[int]:
    return [sum(1 << i for i in c) for n in range(min(bits, budget) + 1) for c in combinations(range(bits), n)]


def _sides(own: Column, other: Column) -> Column:
    return F.struct(F.least(own, other).alias("a"), F.greatest(own, other).alias("b"),
                    (own > other).cast("int").alias("side"))


def _pairs(key: Column, width: int, depth: int, budget: int) -> list[Column]:
    own = _prefix(key, width, depth)
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(depth, budget)])
    return [F.inline(F.transform(masks, lambda m: _sides(own, own.bitwiseXOR(m))))]


def _below(width: int, depth: int, more: int, budget: int) -> list[Column]:
    """The pairs of nodes `more` bits further down, under the pair (a, b) that a row is in."""
    own = _prefix(F.col("key"), width, depth + more)
    other = F.when(F.col("side") == 0, F.col("b")).otherwise(F.col("a"))
    left = budget - F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(more, budget)])
    masks = F.filter(masks, lambda m: F.bit_count(m) <= left)
    partner = F.shiftleft(other, more).bitwiseOR(own.bitwiseAND(2**more - 1))
    return [F.inline(F.transform(masks, lambda m: _sides(own, partner.bitwiseXOR(m))))]


def _walk(todo: DataFrame, width: int, depth: int, budget: int, accept: Accept | None, ragged: bool = False) -> DataFrame:
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(rows, ("tab", "a", "b")):
            u, v = walk(table, width, depth, budget, accept, ragged)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=schema)

    nodes = todo.repartition("tab", "a", "b").sortWithinPartitions("tab", "a", "b", "side")
    return nodes.mapInArrow(run, "u long, v long")


def whole_groups(rows: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.Table]:
    """Batches, sorted by the named columns, joined and cut where a group ends."""
    held: list[pa.RecordBatch] = []
    size = weight = 0
    for batch in rows:
        if not batch.num_rows:
            continue
        if size >= WALK_KEYS or weight >= WALK_BYTES:
            # only the batch is looked at, with the row before it: a group may have many batches
            seam = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch]).select(list(names))
            starts = _group_starts(seam, names)[1:] - 1
            if len(starts):
                cut = int(starts[0])
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held, size, weight, batch = [], 0, 0, batch.slice(cut)
        held.append(batch)
        size += batch.num_rows
        weight += batch.nbytes
    if size:
        yield pa.Table.from_batches(held)


def _group_starts(table: pa.Table, names: tuple[str, ...] = ("tab", "a", "b")) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for name in names:
        values = table.column(name).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def connect_groups(table: pa.Table, name: str, accept: Accept) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (items) of the pairs that `accept` takes in each group of a table sorted by that column.

    Each row is compared with all before it in its group that are not connected to it yet.
    """
    starts = _group_starts(table, (name,))
    item, payload = table.column("item").to_numpy(), np.array([*table.column("payload").to_pylist(), None], dtype=object)[:-1]
    label = np.arange(len(item))
    for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(item)]):
        for k in range(low + 1, high):
            others = np.arange(low, k)
            while len(others):
                others = others[label[others] != label[k]]
                part, others = others[:COMPARED], others[COMPARED:]
                good = part[accept(payload[np.full(len(part), k)], payload[part])] if len(part) else part
                _unite(label, np.full(len(good), k), good)
    linked = np.flatnonzero(label != np.arange(len(label)))
    return item[linked], item[label[linked]]


def walk(
    table: pa.Table, width: int, depth: int, budget: int, accept: Accept | None, ragged: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (items) of all node pairs in the table."""
    starts = _group_starts(table)
    side = table.column("side").to_numpy()
    keys = table.column("key").to_numpy().view(np.uint64)
    if width < 64:
        keys = keys & np.uint64(2**width - 1)
    group = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(keys)))
    order = np.lexsort((keys, side, group))
    keys, item = keys[order], table.column("item").to_numpy()[order]
    payload = None
    if accept is not None:
        if ragged:
            payload = np.array([*table.column("payload").to_pylist(), None], dtype=object)[:-1][order]
        else:
            payload = _fixed_bytes(table.column("payload"))[order]
    ends = np.append(starts[1:], len(keys))
    middle = starts + np.add.reduceat((side == 0).astype(np.int64), starts)
    a, b = table.column("a").to_numpy()[starts], table.column("b").to_numpy()[starts]
    left = budget - np.bitwise_count((a ^ b).astype(np.uint64)).astype(np.int64)
    own = a == b
    first = np.stack([starts, np.where(own, ends, middle), np.where(own, starts, middle), ends, left])
    label = np.arange(len(keys))
    for i, j in _meet(first, keys, width, depth):
        near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
        i, j = i[near], j[near]
        # dear comparisons come in small parts, so that most pairs of a family are connected before their turn
        part = COSTLY if ragged else max(1, len(i))
        for at in range(0, len(i), part):
            x, y = _open(label, i[at : at + part], j[at : at + part])
            if accept is not None and len(x):
                good = accept(payload[x], payload[y])
                x, y = x[good], y[good]
            _unite(label, x, y)
    linked = np.flatnonzero(label != np.arange(len(label)))
    return item[linked], item[label[linked]]


def _fixed_bytes(column: pa.ChunkedArray) -> np.ndarray:
    """The bytes of a column without nulls whose values are equally long, one row for each value."""
    parts = []
    for chunk in column.chunks:
        starts = np.frombuffer(chunk.buffers()[1], np.int32, len(chunk) + 1, chunk.offset * 4)
        data = np.frombuffer(chunk.buffers()[2], np.uint8)
        parts.append(data[starts[0] : starts[-1]])
    return np.concatenate(parts).reshape(len(column), -1)


def _open(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that are not connected yet."""
    new = label[i] != label[j]
    return i[new], j[new]


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Keep in label[k] the smallest index connected to k."""
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label[:] = jumped
        i, j = _open(label, i, j)


def _meet(first: np.ndarray, keys: np.ndarray, width: int, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of indices that the walk reaches; first: ranges [0, 1) and [2, 3) of each node pair and its budget."""
    stack = [(first[:, at : at + FRONTIER], depth) for at in range(0, first.shape[1], FRONTIER)]
    while stack:
        front, level = stack.pop()
        n_a, n_b = front[1] - front[0], front[3] - front[2]
        same = front[0] == front[2]
        alive = (n_a > 0) & (n_b > 0) & (front[4] >= 0) & ~(same & (n_a < 2))
        small = alive & ((n_a * n_b <= DIRECT) | (level >= width))
        for part in _bounded(front[:, small]):
            yield _all_pairs(part)
        front = front[:, alive & ~small]
        if not front.shape[1]:
            continue
        ones = np.append(0, np.cumsum((keys >> np.uint64(width - 1 - level)) & np.uint64(1)).astype(np.int64))
        a0, a1, b0, b1, left = front
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = a0 == b0
        unlike = np.stack([am, a1, b0, bm, left - 1])[:, ~same]  # of a node with itself the other cross pair is enough
        below = np.concatenate(
            [np.stack([a0, am, b0, bm, left]), np.stack([am, a1, bm, b1, left]), np.stack([a0, am, bm, b1, left - 1]), unlike],
            axis=1,
        )
        below = below[:, (below[4] >= 0) & (below[1] > below[0]) & (below[3] > below[2])]
        stack += [(below[:, at : at + FRONTIER], level + 1) for at in range(0, below.shape[1], FRONTIER)]


def _bounded(front: np.ndarray, most: int = PAIRS) -> Iterator[np.ndarray]:
    """Cut into parts of at most `most` pairs of keys; one pair of nodes is cut by its left side."""
    if not front.shape[1]:
        return
    n_b = front[3] - front[2]
    work = np.cumsum((front[1] - front[0]) * n_b)
    at = 0
    while at < front.shape[1]:
        before = work[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(work, before + most, side="right")))
        part = front[:, at:to]
        if to == at + 1 and work[at] - before > most:
            rows = max(1, most // int(n_b[at]))
            for lo in range(int(part[0, 0]), int(part[1, 0]), rows):
                piece = part.copy()
                piece[0, 0], piece[1, 0] = lo, min(lo + rows, int(part[1, 0]))
                yield piece
        else:
            yield part
        at = to


def _all_pairs(front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n_a, n_b = front[1] - front[0], front[3] - front[2]
    size = n_a * n_b
    node = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(node)) - np.repeat(np.cumsum(size) - size, size)
    i, j = front[0][node] + at // n_b[node], front[2][node] + at % n_b[node]
    other = i != j
    return i[other], j[other]
