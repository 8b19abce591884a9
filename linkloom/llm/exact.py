"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Senders: rows are cut into chunks; each keeps the sorted fingerprints of its texts, each fingerprint once.
2. A chunk sends every owner of a fingerprint range one message: the range's fingerprints, Rice-coded.
3. Owners decode their messages and answer each with a bitmap: which of its fingerprints another chunk also sent.
4. Rows whose fingerprint was marked, or is twice in its own chunk, are suspects. Only their texts are grouped,
   byte by byte, which also clears the false alarms of the short fingerprints.

A fingerprint has about 10 bits more than the row count needs, so a message costs about 12 bits a text. A chunk
sends a hot text once, however often it holds it, so an owner never meets more copies than there are chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import one_space, same_key, stored

CHUNK = 65_536
SPARE_BITS = 10
OWNER_SIZE = 8_000_000
LEAST_OWNERS = 16

_CHUNKS = pa.schema([("chunk", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("prints", pa.list_(pa.int64()))])
_MESSAGES = pa.schema([("owner", pa.int64()), ("chunk", pa.string()), ("n", pa.int32()), ("code", pa.binary())])


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one space; null is the empty text. Of equal
    texts the row with the smallest doc_id stays; null ids come last. Rows that repeat a doc_id with the same text
    get the same verdict. An empty table gives no rows.
    """
    prints = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.xxhash64(one_space(F.col("text"))).alias("print"),
            F.unhex(digest(F.col("text"))).alias("sha"),
        ),
        "prints",
    )
    suspects = stored(suspected(prints.select("doc_id", "print")), "suspects")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), one_space(F.col("text")).alias("norm"))
    texts = texts.join(suspects, same_key(texts, suspects, "doc_id"), "left_semi")
    groups = texts.groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.where("group_size > 1").select(
        F.unhex(F.sha2(F.encode("norm", "UTF-8"), 256)).alias("sha"), "keep_id", "group_size"
    )
    joined = prints.join(groups, "sha", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def digest(text: Column) -> Column:
    return F.sha2(F.encode(one_space(text), "UTF-8"), 256)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The input's rows and columns without the copies of an equal text; a repeated row stays once."""
    verdicts = exact_groups(docs).where("kept").select("doc_id", F.col("text_sha256").alias("sha"))
    verdicts = verdicts.withColumnsRenamed({"doc_id": "__id", "sha": "__sha"}).distinct()
    rows = docs.withColumn("__own", digest(F.col("text")))
    match = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__sha"))
    return rows.join(verdicts, match, "left_semi").dropDuplicates(["doc_id", "__own"]).drop("__own")


def suspected(prints: DataFrame) -> DataFrame:
    """(doc_id) of the rows whose short fingerprint some other row shares; may hold ids that are no copies."""
    chunks = stored(prints.mapInArrow(_chunk, "chunk string, doc_ids array<long>, prints array<long>"), "chunks")
    n = chunks.select(F.sum(F.size("doc_ids"))).first()[0] or 0
    bits = min(62, max(8, int(n).bit_length() + SPARE_BITS))
    owners = max(LEAST_OWNERS, -(-n // OWNER_SIZE))
    messages = chunks.mapInArrow(lambda it: _send(it, bits, owners), "owner long, chunk string, n int, code binary")
    answers = messages.groupBy("owner").applyInArrow(
        lambda table: _answer(table, bits, owners), "owner long, chunk string, n int, code binary"
    )
    answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("owner", "n", "code")).alias("bitmaps"))
    back = chunks.join(answers, "chunk").select("doc_ids", "prints", "bitmaps")
    return back.mapInArrow(lambda it: _marked(it, bits), "doc_id long").distinct()


def short_prints(prints: np.ndarray, bits: int) -> np.ndarray:
    return (prints.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def rice_parameter(span: int, n: int) -> int:
    return max(0, (span // max(n, 1)).bit_length() - 1)


def encode_sorted(values: np.ndarray, k: int) -> bytes:
    """Rice code of rising values from 0 on: unary quotients of the gaps, then their low k bits."""
    gaps = np.diff(values, prepend=0)
    quotients = gaps >> k
    ends = np.cumsum(quotients + 1) - 1
    unary = np.ones(int(ends[-1]) + 1, dtype=np.uint8)
    unary[ends] = 0
    low = ((gaps[:, None] >> np.arange(k)) & 1).astype(np.uint8).ravel()
    return np.packbits(np.concatenate([unary, low])).tobytes()


def decode_sorted(code: bytes, n: int, k: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    ends = np.flatnonzero(bits == 0)[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    low = bits[ends[-1] + 1 : ends[-1] + 1 + n * k].reshape(n, k).astype(np.int64)
    return np.cumsum((quotients << k) + (low << np.arange(k)).sum(axis=1, dtype=np.int64))


def _chunk(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

    def out() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, prints = table.column(0).combine_chunks(), table.column(1).to_numpy()
        order = np.argsort(prints.view(np.uint64), kind="stable")
        return pa.RecordBatch.from_pydict(
            {"chunk": [f"{task}-{number}"], "doc_ids": [ids.take(pa.array(order))], "prints": [prints[order]]}, schema=_CHUNKS
        )

    for batch in rows:
        held.append(batch)
        size += batch.num_rows
        if size >= CHUNK:
            yield out()
            held, size, number = [], 0, number + 1
    if size:
        yield out()


def _owner_cuts(short: np.ndarray, bits: int, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each owner's range begins among the fingerprints, and among the sorted distinct ones."""
    starts = np.array([(o << bits) // owners for o in range(owners + 1)], dtype=np.int64)
    return starts, np.searchsorted(short, starts)


def _send(rows: Iterator[pa.RecordBatch], bits: int, owners: int) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for chunk, prints in zip(batch.column(0).to_pylist(), batch.column(2)):
            short = np.unique(short_prints(prints.values.to_numpy(), bits))
            starts, cuts = _owner_cuts(short, bits, owners)
            out: list[tuple] = []
            for o in np.flatnonzero(np.diff(cuts)).tolist():
                part = short[cuts[o] : cuts[o + 1]] - starts[o]
                k = rice_parameter(int(starts[o + 1] - starts[o]), len(part))
                out.append((o, chunk, len(part), encode_sorted(part, k)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _MESSAGES)], schema=_MESSAGES)


def _answer(table: pa.Table, bits: int, owners: int) -> pa.Table:
    """A bitmap for each message of one owner; the owner's fingerprints are spread evenly by their hash."""
    o = table.column(0)[0].as_py()
    span = ((o + 1) << bits) // owners - (o << bits) // owners
    counts = table.column(2).to_pylist()
    parts = [decode_sorted(c.as_py(), n, rice_parameter(span, n)) for c, n in zip(table.column(3), counts)]
    values, inverse, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    shared = (times > 1)[inverse]
    cuts = np.cumsum([0, *counts])
    bitmaps = [np.packbits(shared[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])]
    return table.set_column(3, "code", pa.array(bitmaps, pa.binary()))


def _marked(rows: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64())])
    for batch in rows:
        for ids, prints, bitmaps in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
            distinct, inverse, times = np.unique(
                short_prints(prints.values.to_numpy(), bits), return_inverse=True, return_counts=True
            )
            bitmaps.sort(key=lambda m: m["owner"])
            marks = [np.unpackbits(np.frombuffer(m["code"], np.uint8), count=m["n"]) for m in bitmaps]
            chosen = ((times > 1) | np.concatenate(marks).astype(bool))[inverse]
            yield pa.RecordBatch.from_arrays([ids.values.filter(pa.array(chosen))], schema=schema)
