"""Packed token ids for training: matrices of ids with segment lengths and position resets.

Pieces are dealt into blocks by a hash of their number. In a block, best-fit-decreasing places each piece, longest first, in the open
row with the least room that is enough; a segment tree over the amounts of room finds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import stored
from linkloom.llm.tokens import binary_column, token_pieces

CAPACITY = 4096
#: pieces of a block on average, however they are spread over rows; at most 16 KB of ids each
BLOCK = 6_000
PAD = 0

_ROWS = pa.schema([
    ("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
    ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())),
    ("starts", pa.list_(pa.int64())),
])
_DDL = ("sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, "
        "doc_ids array<long>, pieces array<int>, starts array<long>")


class RoomTree:
    """Counts of open rows by the room they have left; finds the least room that is enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.counts[node] += by
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove a row with the least room >= `least`; gives (room, row)."""
        counts, node = self.counts, least + self.size
        if not counts[node]:
            while node > 1 and (node & 1 or not counts[node + 1]):  # up until a right neighbour holds rows
                node >>= 1
            if node == 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if counts[2 * node] else 2 * node + 1
        room = node - self.size
        self._change(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of indices; lengths fall or not, ties go by index."""
    tree, rows = RoomTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        room, row = found if found else (capacity, len(rows))
        if not found:
            rows.append([])
        rows[row].append(i)
        if room > lengths[i]:
            tree.add(room - lengths[i], row)
    return rows


def packed_ids(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None) -> DataFrame:
    """One row per sequence: its padded ids and where its segments begin.

    ids: `capacity` little-endian unsigned 16-bit ids, padded by PAD; larger vocabularies are refused. cu_seqlens: 0, the end of each segment, so a segment's ids are between neighbours. position_resets:
    where positions start again at 0. doc_ids, pieces and starts tell which ids of which document a segment holds; cut
    documents come back whole by joining their pieces. Null and empty texts are one end id. No rows give none.
    """
    pieces = token_pieces(docs, capacity, tokenizer_path, with_ids=True)
    pieces = stored(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    n_blocks = max(1, -(-pieces.count() // BLOCK))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks))).drop("row")
    return dealt.groupBy("block").applyInArrow(lambda rows: _fill(rows, capacity), _DDL)


def _fill(table: pa.Table, capacity: int) -> pa.Table:
    table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
    block = table.column("block")[0].as_py() if table.num_rows else 0
    lengths, docs = table.column("length").to_pylist(), table.column("doc_id").to_pylist()
    pieces, starts = table.column("piece").to_pylist(), table.column("start").to_pylist()
    rows = best_fit_decreasing(lengths, capacity)
    ids = table.column("ids").combine_chunks()
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    flat = np.frombuffer(ids.buffers()[2] or b"", "<u2")
    at = (np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(lengths) + 1] // 2).tolist()
    filled = np.full((len(rows), capacity), PAD, "<u2")
    all_cuts = []
    for number, row in enumerate(rows):
        cuts, line = [0], filled[number]
        for i in row:
            cuts.append(cuts[-1] + lengths[i])
            line[cuts[-2] : cuts[-1]] = flat[at[i] : at[i + 1]]
        all_cuts.append(cuts)
    ends = capacity * np.arange(1, len(rows) + 1)
    columns = [
        (block << 20) + np.arange(len(rows)), [c[-1] for c in all_cuts], binary_column(filled.reshape(-1), ends), all_cuts,
        [c[:-1] for c in all_cuts], *([[held[i] for i in row] for row in rows] for held in (docs, pieces, starts)),
    ]
    return pa.table([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _ROWS)], schema=_ROWS)


def write_packed(docs: DataFrame, path: str, capacity: int = CAPACITY, tokenizer_path: str | None = None) -> None:
    packed_ids(docs, capacity, tokenizer_path).write.parquet(path)


def documents_of(packed: DataFrame) -> DataFrame:
    """(doc_id, ids) again from packed rows, ids as an array; the inverse of packed_ids for distinct ids of documents."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("part", pa.list_(pa.int32()))])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                ids, cuts = np.frombuffer(row["ids"], "<u2"), row["cu_seqlens"]
                parts = [ids[a:b].astype(np.int32) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["starts"], pa.int64()),
                     pa.array(parts, pa.list_(pa.int32()))], schema=schema)

    parts = packed.select("ids", "cu_seqlens", "doc_ids", "starts").mapInArrow(run, "doc_id long, start long, part array<int>")
    ordered = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "part"))).alias("parts"))
    return ordered.select("doc_id", F.flatten(F.transform("parts", lambda p: p["part"])).alias("ids"))
