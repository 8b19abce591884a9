"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Pieces are numbered once and dealt into blocks of about BLOCK by a hash of the number, so every block has the same mix of lengths whatever the
corpus. On each block several islands evolve a few packings. A packing is a list of bins; a crossover injects
whole well-filled bins of one parent into the other, removes the bins that hold the same pieces again, and
best-fits what that displaces. After each epoch an island's best packing moves to the next island. Bins of the
best packing that are well filled stay; the pieces of the others go up a level, where fewer blocks pack them again,
until one block holds the rest.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import stored
from linkloom.llm.tokens import token_pieces

CAPACITY = 4096
BLOCK = 4096
ISLANDS = 3
MEMBERS = 4
EPOCHS = 2
GENERATIONS = 4
#: a bin filled to this share is settled at once
WELL_FILLED = 0.995

_ITEM = "struct<length: bigint, doc_id: bigint, piece: int, start: bigint, ids_crc32: bigint, row: bigint>"
_STATE = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("lengths", pa.list_(pa.int32())),
                    ("members", pa.list_(pa.list_(pa.int32())))])


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None) -> DataFrame:
    """Every piece of every document with its sequence_id and offset.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are one piece of
    length 1. Repeated rows are packed each on its own. An empty table gives no rows. Equal lengths are told apart
    by doc_id, piece and start, then by the row.
    """
    return pack_pieces(token_pieces(docs, capacity, tokenizer_path), capacity)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Places for rows (doc_id, piece, start, length, ids_crc32) with 0 < length <= capacity."""
    # rows may be alike in all columns, so each gets a number that stays
    rest, level, done = stored(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces"), 0, []
    left = rest.count()
    while True:
        n_blocks = max(1, -(-left // BLOCK))
        placed = stored(_pack_level(rest, n_blocks, capacity, level), "packed")
        if n_blocks == 1:
            done.append(placed)
            break
        settled = F.col("fill") >= int(WELL_FILLED * capacity)
        weak = placed.where(~settled).select(rest.columns)
        again = weak.count()
        if again > left // 2:  # nearly all bins are poorly filled: long pieces that no partner fits
            done.append(placed)
            break
        done.append(placed.where(settled))
        rest, left, level = weak, again, level + 1
        if not left:
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _pack_level(pieces: DataFrame, n_blocks: int, capacity: int, level: int) -> DataFrame:
    deal = F.pmod(F.xxhash64("row", F.lit(level)), F.lit(n_blocks))
    items = stored(
        pieces.select(deal.alias("block"), F.struct("length", "doc_id", "piece", "start", "ids_crc32", "row").alias("item"))
        .groupBy("block")
        .agg(F.sort_array(F.collect_list("item"), asc=False).alias("items")),
        "blocks",
    )
    lengths = F.transform("items", lambda x: x["length"].cast("int"))
    island = F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island")
    state = items.select("block", island, lengths.alias("lengths"))
    state = state.select("*", F.lit(None).cast("array<array<int>>").alias("members")).repartition("block", "island")
    state = _evolve(state, capacity, level)
    for _ in range(EPOCHS - 1):
        state = stored(state, "islands")
        elite = state.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"),
                             F.col("members")[0].alias("elite"))
        state = state.join(elite, ["block", "island"]).select(
            "block", "island", "lengths",
            F.concat(F.slice("members", 1, MEMBERS - 1), F.array("elite")).alias("members"),
        )
        state = _evolve(state, capacity, level)
    best = state.select("block", "island", F.col("members")[0].alias("bins")).select(
        "block", "bins", F.struct(F.array_max("bins"), F.col("island")).alias("rank")
    )
    best = best.groupBy("block").agg(F.min_by("bins", "rank").alias("bins"))
    return _places(items.join(best, "block").select("block", "items", "bins"), level)


def _evolve(state: DataFrame, capacity: int, level: int) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                rng = random.Random(row["block"] * 1_000_003 + row["island"] * 101 + level)
                row["members"] = evolve(row["lengths"], row["members"], capacity, rng)
                yield pa.RecordBatch.from_pylist([row], schema=_STATE)

    return state.mapInArrow(run, "block long, island int, lengths array<int>, members array<array<int>>")


def _places(best: DataFrame, level: int) -> DataFrame:
    schema = pa.schema([(n, pa.int32() if n == "piece" else pa.int64()) for n in
                        ("doc_id", "piece", "start", "length", "ids_crc32", "row", "sequence_id", "offset", "fill")])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                fill: dict[int, int] = {}
                out = []
                for item, chosen in zip(row["items"], row["bins"]):
                    offset = fill.get(chosen, 0)
                    fill[chosen] = offset + item["length"]
                    out.append(item | {"offset": offset, "bin": chosen})
                for item in out:
                    chosen = item.pop("bin")
                    # a block has fewer than 2^20 bins, a level fewer than 2^38 blocks
                    item["sequence_id"] = (level << 58) + (row["block"] << 20) + chosen
                    item["fill"] = fill[chosen]
                for at in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_pylist(out[at : at + 10_000], schema=schema)

    return best.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, row long, "
                                "sequence_id long, offset long, fill long")


def evolve(lengths: list[int], members: list[list[int]] | None, capacity: int, rng: random.Random) -> list[list[int]]:
    """A few generations of one island; the best packing comes first. A packing gives each piece its bin."""
    least = -(-sum(lengths) // capacity)
    if members is None:
        pool = [_first(lengths, capacity, rng, shaken) for shaken in range(MEMBERS)]
    else:
        pool = [_bins_of(genes) for genes in members]
    pool.sort(key=lambda bins: _cost(bins, lengths))
    for _ in range(GENERATIONS):
        if len(pool[0]) <= least:
            break
        mother, father = pool[0], pool[rng.randrange(1, len(pool))]
        if rng.random() < 0.5:
            mother, father = father, mother
        child = _shake(_cross(mother, father, lengths, capacity, rng), lengths, capacity, rng)
        pool[-1] = child
        pool.sort(key=lambda bins: _cost(bins, lengths))
    return [_genes_of(bins, len(lengths)) for bins in pool]


def _cost(bins: list[list[int]], lengths: list[int]) -> tuple:
    return len(bins), -sum(sum(lengths[i] for i in b) ** 2 for b in bins)


def _bins_of(genes: list[int]) -> list[list[int]]:
    bins: list[list[int]] = [[] for _ in range(max(genes, default=-1) + 1)]
    for i, chosen in enumerate(genes):
        bins[chosen].append(i)
    return bins


def _genes_of(bins: list[list[int]], n: int) -> list[int]:
    genes = [0] * n
    for chosen, b in enumerate(bins):
        for i in b:
            genes[i] = chosen
    return genes


def _best_fit(bins: list[list[int]], items: list[int], lengths: list[int], capacity: int) -> list[list[int]]:
    """Put each item, in the given order, into the bin that it leaves with the least room."""
    room = sorted((capacity - sum(lengths[i] for i in b), k) for k, b in enumerate(bins))
    for i in items:
        size = lengths[i]
        at = bisect_left(room, (size, -1))
        if at == len(room):
            bins.append([i])
            insort(room, (capacity - size, len(bins) - 1))
        else:
            left, k = room.pop(at)
            bins[k].append(i)
            if left > size:
                insort(room, (left - size, k))
    return bins


def _first(lengths: list[int], capacity: int, rng: random.Random, shaken: int) -> list[list[int]]:
    order = list(range(len(lengths)))  # lengths fall
    if shaken:
        order.sort(key=lambda i: -lengths[i] * (1 + 0.1 * shaken * rng.random()))
    return _best_fit([], order, lengths, capacity)


def _cross(mother, father, lengths, capacity, rng) -> list[list[int]]:
    full = [b for b in father if sum(lengths[i] for i in b) >= WELL_FILLED * capacity]
    injected = [list(b) for b in full if rng.random() < 0.5]
    taken = {i for b in injected for i in b}
    kept, displaced = injected, []
    for b in mother:
        if taken.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    return _best_fit(kept, sorted(displaced, key=lambda i: -lengths[i]), lengths, capacity)


def _shake(bins, lengths, capacity, rng) -> list[list[int]]:
    """Take the emptiest bins and a few others apart and fit their pieces again."""
    bins = sorted(bins, key=lambda b: sum(lengths[i] for i in b))
    out, rest = bins[:2], bins[2:]
    for _ in range(min(3, len(rest))):
        out.append(rest.pop(rng.randrange(len(rest))))
    loose = sorted((i for b in out for i in b), key=lambda i: -lengths[i])
    return _best_fit(rest, loose, lengths, capacity)
