"""Near duplicates by SimHash fingerprints and a binary trie self-join."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import doc_texts, stored
from linkloom.llm.components import components
from linkloom.llm.trie import connect_groups, trie_links, whole_groups

SEED = 42
#: for groups by similarity: bits of a fingerprint, and the share of pairs at the similarity itself that meet
WIDE_BITS, REACH = 512, 0.999
#: deviations beyond the expected differing bits at which a pair still is a candidate
MARGIN = 4
#: bytes of a fingerprint that go with a key, and keys under one pair of trie nodes when no more than these go along
PART_BYTES, PART_KEYS = 32, 800_000
#: a family of candidates of so many sets and bytes at most is compared in one task
FAMILY_ITEMS, FAMILY_BYTES = 2_000, 64 << 20
#: random bits that a key of the similarity join has beyond the logarithm of the number of fingerprints
KEY_BITS_LEAST, KEY_BUDGET = 16, 1
_BLOCK = 1 << 15


def simhash_groups(docs: DataFrame, shingle: int = 3, budget: int = 2) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link when they differ in at most `budget` bits; component_id is the smallest doc_id reachable. Texts
    without words, null ones too, have fingerprint zero and link like any other. Equal fingerprints are one class, so
    copies never make pairs. Null ids never become a component_id unless the whole component has none.
    """
    prints = stored(fingerprints(docs, shingle, 64).select("doc_id", _as_long("print").alias("bits")), "simhash")
    classes = stored(prints.groupBy("bits").agg(F.min("doc_id").alias("first")), "classes")
    keys = classes.select(F.lit(0).alias("tab"), F.col("bits").alias("key"), F.col("bits").alias("item"),
                          F.lit(None).cast("binary").alias("payload"))
    roots = components(trie_links(keys, 64, budget))
    member = classes.join(roots, classes["bits"] == roots["node"], "left").select(
        "bits", "first", F.coalesce("root", "bits").alias("root")
    )
    lowest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    member = member.join(lowest, "root").select("bits", "component_id")
    return prints.join(member, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """doc_id, text_key, component_id, kept of each row with words.

    Two texts link when the Jaccard similarity of their sets of shingles reaches `similarity`; texts without a near copy
    are alone in their component. text_key is the text's hash: it tells texts apart that share a doc_id or have none.
    component_id is the smallest doc_id of a component, null where all are null. The row with the smallest doc_id, nulls
    last, then text_key, is kept; rows alike in both are kept or not together. Rows without words are left out.

    Keys of a few sampled bits of wide SimHash fingerprints of the sets bring candidates together: `KEY_BUDGET` of the bits
    may differ, and there are as many keys as bring pairs at the similarity itself together with probability REACH. The
    walk over the keys carries part of the fingerprints alone and finds families of candidates. Then each family's sets
    are sent once to one task, which compares them. Families too large for a task go through the keys with their sets.
    """
    wide = stored(_wide_prints(docs, shingle), "wide")
    first = stored(wide.groupBy("item").agg(F.min("print").alias("print")), "wide-classes")
    width, tables = key_plan(first.count(), similarity)
    p = differing_share(similarity)

    def most(bits: int) -> int:
        return int(bits * p + MARGIN * math.sqrt(bits * p * (1 - p)))

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count((x ^ y).view(np.uint64)).sum(axis=1) <= most(8 * PART_BYTES)

    def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.fromiter((_alike(a, b, most(WIDE_BITS), similarity) for a, b in zip(x, y)), bool, len(x))

    part = F.substring("print", 1, PART_BYTES)
    found = trie_links(_sampled_keys(first.select("print", "item", part.alias("payload")), width, tables),
                       width, KEY_BUDGET, near, node_keys=PART_KEYS)
    family = stored(components(found), "families").withColumnsRenamed({"node": "item", "root": "family"})
    # one row of each set in a family gives its shingles
    one = wide.join(family, "item").groupBy("item", "family").agg(F.min(F.struct("doc_id", "text_key")).alias("one"))
    one = one.select("item", "family", "one.*").withColumnsRenamed({"doc_id": "__id", "text_key": "__key"})
    texts = _keyed(docs)
    texts = texts.join(one, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")), "left_semi")
    sets = _sets(texts, shingle).dropDuplicates(["item"]).join(family, "item")
    sets = stored(sets.select("family", "print", "item", F.concat("print", "hashes").alias("payload")), "sets")
    sizes = sets.groupBy("family").agg(F.count("*").alias("n"), F.sum(F.octet_length("payload")).alias("bytes"))
    small = (F.col("n") <= FAMILY_ITEMS) & (F.col("bytes") <= FAMILY_BYTES)
    sized = sets.join(sizes.select("family", small.alias("small")), "family")
    links = _family_links(sized.where("small"), alike)
    large = stored(sized.where("not small").drop("small"), "large-families")
    if not large.isEmpty():
        links = links.unionByName(trie_links(_sampled_keys(large, width, tables), width, KEY_BUDGET, alike, ragged=True))
    roots = components(links)
    member = wide.join(roots, wide["item"] == roots["node"], "left").select(
        "doc_id", "text_key", F.coalesce("root", "item").alias("root")
    )
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    lowest = member.groupBy("root").agg(F.min(rank).alias("first"))
    return member.join(lowest, "root").select(
        "doc_id", "text_key", F.col("first.id").alias("component_id"), (rank == F.col("first")).alias("kept")
    )


def _family_links(sets: DataFrame, alike) -> DataFrame:
    """Links (u, v) that connect the similar items of each family; a family is small enough for a task."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(rows, ("family",)):
            u, v = connect_groups(table, "family", alike)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=schema)

    rows = sets.select("family", "item", "payload").repartition("family").sortWithinPartitions("family", "item")
    return rows.mapInArrow(run, "u long, v long")


def _alike(a: bytes, b: bytes, most: int, similarity: float) -> bool:
    """Whether the sets behind the fingerprints of both reach the similarity."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    head = WIDE_BITS // 64
    n, m = len(x) - head, len(y) - head
    if min(n, m) < similarity * max(n, m) or np.bitwise_count(x[:head] ^ y[:head]).sum() > most:
        return False
    both = len(np.intersect1d(x[head:], y[head:], assume_unique=True))
    return both >= similarity * (n + m - both)


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The distinct hashes of the shingles of a text, in order; none without words."""
    parts = [hashes for hashes, _ in _hashes(text, shingle)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def set_print(hashes: np.ndarray) -> bytes:
    """A bit is set when it is set in over half the members' hashes, each counted once."""
    counts = np.zeros(WIDE_BITS, dtype=np.int64)
    for at in range(0, len(hashes), _BLOCK):
        counts += _bit_counts(hashes[at : at + _BLOCK], WIDE_BITS)
    return np.packbits(2 * counts > len(hashes)).tobytes()


def _set_id(hashes: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(hashes.astype("<u8").tobytes(), seed=SEED), "big", signed=True)


def _keyed(docs: DataFrame) -> DataFrame:
    return doc_texts(docs).select("doc_id", "text", F.xxhash64("text").alias("text_key"))


def _wide_prints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_key, item (equal for equal sets), print of the rows with words."""
    return _sets(_keyed(docs), shingle, with_hashes=False)


def _sets(texts: DataFrame, shingle: int, with_hashes: bool = True) -> DataFrame:
    fields = [("doc_id", pa.int64()), ("text_key", pa.int64()), ("item", pa.int64()), ("print", pa.binary())]
    schema = pa.schema(fields + [("hashes", pa.binary())] * with_hashes)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out: list[list] = [[] for _ in schema]
            for doc, text, key in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                hashes = shingle_set(text.as_py(), shingle)
                if len(hashes):
                    values = (doc, key, _set_id(hashes), set_print(hashes), hashes.astype("<u8").tobytes() if with_hashes else b"")
                    for column, value in zip(out, values):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return texts.mapInArrow(run, "doc_id long, text_key long, item long, print binary" + ", hashes binary" * with_hashes)


def differing_share(similarity: float) -> float:
    """The expected share of differing bits of two sets of equal size with this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def key_plan(n: int, similarity: float) -> tuple[int, int]:
    """Bits of a key and number of keys. Keys grow with log2(n), so a key meets as many others at any size."""
    width = min(62, max(KEY_BITS_LEAST, int(n).bit_length()))
    p = differing_share(similarity)
    hit = sum(math.comb(width, e) * p**e * (1 - p) ** (width - e) for e in range(KEY_BUDGET + 1))
    return width, math.ceil(math.log(1 - REACH) / math.log(1 - hit))


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The input's rows and columns without the near copies; of each group the row with the smallest doc_id stays.

    Rows go by id and text together: a text that shares its id with a near copy, or has none, stays unless it is one
    itself. Of near copies without any id one text stays. Rows alike in id and text stay or go together.
    """
    gone = similar_groups(docs, similarity, shingle).where("not kept").select(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")
    )
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__key"))
    return docs.join(gone.distinct(), same, "left_anti")


def _as_long(name: str):
    return F.conv(F.hex(name), 16, -10).cast("long")


def fingerprints(docs: DataFrame, shingle: int, bits: int) -> DataFrame:
    """doc_id, print (big-endian bytes), has_words."""
    schema = pa.schema([("doc_id", pa.int64()), ("print", pa.binary()), ("has_words", pa.bool_())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            made = [fingerprint(t.as_py(), shingle, bits) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made])], schema=schema
            )

    return doc_texts(docs).mapInArrow(run, "doc_id long, print binary, has_words boolean")


def fingerprint(text: str, shingle: int, bits: int) -> tuple[bytes, bool]:
    """A bit is set when it is set in over half the shingles' hashes; the first 64 are those of XXH64 itself."""
    counts, n = np.zeros(bits, dtype=np.int64), 0
    for hashes, n in _hashes(text, shingle):
        counts += _bit_counts(hashes, bits)
    return np.packbits(2 * counts > n).tobytes(), n > 0


def _hashes(text: str, shingle: int) -> Iterator[tuple[np.ndarray, int]]:
    """XXH64 of each shingle, a block at a time, and how many there are in all; none without words."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space parts words
    n = len(words)
    if not n:
        return
    joined, hash64 = b" ".join(words), partial(xxhash.xxh64_intdigest, seed=SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    if n < shingle:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: n - shingle + 1], ends[shingle - 1 :]
    for at in range(0, len(starts), _BLOCK):  # bounded memory for very long texts
        cuts = zip(starts[at : at + _BLOCK].tolist(), ends[at : at + _BLOCK].tolist())
        yield np.array([hash64(joined[a:b]) for a, b in cuts], dtype=np.uint64), len(starts)


def _bit_counts(hashes: np.ndarray, bits: int) -> np.ndarray:
    out = []
    for word in range(bits // 64):
        mixed = hashes if word == 0 else _mix(hashes, word)
        raw = mixed.astype(">u8").view(np.uint8).reshape(-1, 8)
        out.append(np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.uint32))
    return np.concatenate(out).astype(np.int64)


def _mix(h: np.ndarray, word: int) -> np.ndarray:
    """Another 64 random bits from a hash."""
    h = (h ^ np.uint64(word * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _sampled_keys(prints: DataFrame, width: int, tables: int) -> DataFrame:
    schema = pa.schema([("tab", pa.int32()), ("key", pa.int64()), ("item", pa.int64()), ("payload", pa.binary())])
    rng = np.random.default_rng(SEED)
    chosen = np.concatenate([rng.permutation(WIDE_BITS) for _ in range(-(-width * tables // WIDE_BITS))])
    chosen = chosen[: width * tables].reshape(tables, width)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.int64(1) << np.arange(width - 1, -1, -1)
        for batch in rows:
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            flags = np.unpackbits(raw, axis=1)
            for tab in range(tables):
                key = flags[:, chosen[tab]].astype(np.int64) @ weights
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(batch.num_rows, tab, np.int32)), pa.array(key), batch.column(1), batch.column(2)],
                    schema=schema,
                )

    return prints.select("print", "item", "payload").mapInArrow(run, "tab int, key long, item long, payload binary")
