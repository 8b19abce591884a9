"""Alignment of the tokens of two tokenizers over whole texts, and how usual each link is in the corpus.

The ends of both tokenizers' tokens are summed up in bytes and kept in dictionaries from end to index. The ends that are
keys of both, in order, slice both lists of ids into groups. In a group every pair of tokens whose bytes overlap is a
link. Tokens of neither tokenizer span the place before white space, so a text is aligned chunk by chunk and the chunks
met before are remembered; texts with other white space than blanks, tabs and line feeds are aligned whole.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate, count
from struct import Struct

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import doc_texts, stored

#: chunks one Python worker remembers, and their greatest length in characters
CHUNKS_HELD, CHUNK_CHARS = 150_000, 40
#: distinct links whose counts are sent to every executor (some 60 bytes each); more are joined by a shuffle
SENT_LINKS = 2_000_000

# fixed values: the byte-level tokenizer's word pattern, and how it writes bytes as characters
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]

_CHUNK = re.compile(r"[ \t\n]+[^ \t\n]*")
#: white space that does not part chunks
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \t\n"]

Entry = tuple[bytes, bytes, str]
_COUNTS = Struct("<3q")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_level(path: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    """A byte-level BPE file as an encoder without special tokens, and the bytes of each id."""
    with open(path, encoding="utf-8") as lines:
        model = json.load(lines)["model"]
    rest = [b for b in range(256) if b not in _PRINTED]
    byte_of = {chr(b): b for b in _PRINTED} | {chr(256 + k): b for k, b in enumerate(rest)}
    held = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items()}
    merged = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    ids = [model["vocab"][m.replace(" ", "")] for m in merged]
    if ids != sorted(ids) or len(held) != len(model["vocab"]):
        raise ValueError(f"the ids of {path} do not follow its merges")
    out = [b""] * (max(held.values()) + 1)
    for token, i in held.items():
        out[i] = token
    return tiktoken.Encoding("byte-level", pat_str=_PATTERN, mergeable_ranks=held, special_tokens={}), out


def pieces(path: str) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes]]:
    """A sentencepiece model, and the bytes of each id."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return model, out


def groups_of(a: list[int], b: list[int], sizes_a: list[int], sizes_b: list[int]) -> list[tuple[int, int, int]]:
    """Where groups end: the byte and the index behind it in both lists of ids. Both lists hold the same bytes."""
    ends_a = dict(zip(accumulate(map(sizes_a.__getitem__, a)), count(1)))
    ends_b = dict(zip(accumulate(map(sizes_b.__getitem__, b)), count(1)))
    return [(end, ends_a[end], ends_b[end]) for end in sorted(ends_a.keys() & ends_b.keys())]


def links_of(a: list[int], b: list[int], sizes_a: list[int], sizes_b: list[int]) -> list[tuple[int, int]]:
    """The pairs of ids in one group whose bytes overlap."""
    if len(a) == 1:
        return [(a[0], y) for y in b]
    if len(b) == 1:
        return [(x, b[0]) for x in a]
    out, i, j = [], 0, 0
    ahead = sizes_a[a[0]] - sizes_b[b[0]]  # how much further the token of a reaches
    while True:
        out.append((a[i], b[j]))
        step_a, step_b = ahead <= 0, ahead >= 0
        i += step_a
        j += step_b
        if i == len(a) or j == len(b):
            return out
        ahead += (sizes_a[a[i]] if step_a else 0) - (sizes_b[b[j]] if step_b else 0)


class Aligner:
    """Aligns texts; one per Python worker."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.bytes_a = byte_level(path_a)
        self.b, self.bytes_b = pieces(path_b)
        self.sizes_a, self.sizes_b = list(map(len, self.bytes_a)), list(map(len, self.bytes_b))
        self.name_a, self.name_b = [f"{i}|" for i in range(len(self.bytes_a))], list(map(str, range(len(self.bytes_b))))
        self.space = self.b.piece_to_id("▁")
        spaced = [p for i, p in enumerate(self.bytes_b) if not self.b.is_byte(i)]
        # a piece with white space behind its first sign would span chunks
        self.chunked = not any(c in p.lstrip(b" ") for p in spaced for c in (b" ", b"\t", b"\n"))
        self.held: dict[str, Entry] = {}

    def tokens(self, text: str) -> tuple[list[int], list[int]] | None:
        """Both ids of a text that begins with white space; None where the bytes of one tokenizer differ from it."""
        spaced = text[0] == " "  # the second model puts a space in front by itself
        b = [self.space] if text == " " else self.b.encode(text[1:] if spaced else text)
        if not spaced and b[:1] != [self.space]:
            return None
        b = b if spaced else b[1:]
        a = self.a.encode_ordinary(text)
        raw, bytes_a, bytes_b = text.encode(), self.bytes_a, self.bytes_b
        if b"".join([bytes_a[i] for i in a]) != raw or b"".join([bytes_b[i] for i in b]) != raw:
            return None
        return a, b

    def entries(self, texts: list[str]) -> list[Entry] | None:
        """For each text the links as 64-bit numbers, the counts of both ids and of groups, and the groups in writing.

        The texts are aligned as one: where one of them ends, tokens of both end. If not, there are fewer entries.
        """
        found = self.tokens("".join(texts))
        if found is None:
            return None
        a, b = found
        name_a, name_b, sizes_a, sizes_b = self.name_a, self.name_b, self.sizes_a, self.sizes_b
        cuts = accumulate([len(t) if t.isascii() else len(t.encode()) for t in texts])
        out, links, names, i, j, n_a, n_b, cut = [], [], [], 0, 0, 0, 0, next(cuts)
        for end, to_i, to_j in groups_of(a, b, sizes_a, sizes_b):
            if to_i - i == 1 and to_j - j == 1:
                x, y = a[i], b[j]
                links.append(x << 32 | y)
                names.append(name_a[x] + name_b[y])
            else:
                xs, ys = a[i:to_i], b[j:to_j]
                links += [x << 32 | y for x, y in links_of(xs, ys, sizes_a, sizes_b)]
                names.append(f"{','.join(map(str, xs))}|{','.join(map(str, ys))}")
            i, j = to_i, to_j
            if end == cut:
                out.append((array("q", links).tobytes(), _COUNTS.pack(i - n_a, j - n_b, len(names)), ";".join(names)))
                links, names, cut, n_a, n_b = [], [], next(cuts, 0), i, j
        return out

    def aligned(self, text: str) -> list[Entry] | None:
        """The entries of a text without its leading space, in order; None where it has no tokens."""
        if not text:
            return None
        whole = " " + text
        if not self.chunked or any(c in text for c in _OTHER_SPACE):
            return self.entries([whole])
        chunks, held = _CHUNK.findall(whole), self.held
        new = list(set(chunks).difference(held))
        if not new:
            return list(map(held.__getitem__, chunks))
        if chunks[-1].isspace() and chunks[-1] not in held:  # white space alone would go to the next chunk
            new.remove(chunks[-1])
            new.append(chunks[-1])
        entries = self.entries(new)
        if entries is None:
            return None
        if len(entries) < len(new):
            return self.entries([whole])
        held.update(zip(new, entries))
        out = list(map(held.__getitem__, chunks))
        for chunk in new if len(held) > CHUNKS_HELD else [c for c in new if len(c) > CHUNK_CHARS]:
            del held[chunk]
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def alignments(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, groups, links, times.

    groups: `a1,a2|b1;a3|b2,b3`, the ids of each group in order. links: the distinct linked id pairs, the first
    tokenizer's id in the upper 32 bits; times: how often each is linked. Texts that are null or empty, or that one of the
    tokenizers does not give back byte for byte, have no tokens: zeros, an empty string, empty lists.
    """
    paths = [given or default for given, default in zip((path_a, path_b), default_paths())]
    fields = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
              ("groups", pa.string()), ("links", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]
    schema = pa.schema(fields)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(*paths).aligned
        for batch in rows:
            counts, texts, links, times = [], [], [], []
            for text in batch.column(1):
                entries = align(text.as_py()) or []
                pairs, n = np.unique(np.frombuffer(b"".join([e[0] for e in entries]), "<i8"), return_counts=True)
                counts.append(np.frombuffer(b"".join([e[1] for e in entries]), "<i8").reshape(-1, 3).sum(axis=0))
                texts.append(";".join([e[2] for e in entries]))
                links.append(pairs)
                times.append(n.astype(np.int32))
            sums = np.array(counts, np.int64).reshape(-1, 3)
            columns = [batch.column(0), *(pa.array(sums[:, k]) for k in range(3)), pa.array(texts, pa.string()),
                       pa.array(links, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return doc_texts(docs).mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, groups string, links array<long>, times array<int>")


def scored(aligned: DataFrame, sent: int = SENT_LINKS) -> DataFrame:
    """The rows of `alignments`, with n_links, n_best and count_sum in place of links and times; other columns stay.

    A link's count is the number of rows that hold it. n_links: all linked occurrences; n_best: those whose count is the
    highest of any link of their first id, ties included; count_sum: their counts summed up. Rows without links get zeros.
    """
    rows = stored(aligned.withColumn("__row", F.monotonically_increasing_id()), "aligned")
    counts = rows.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("n"))
    counts = stored(counts.withColumn("a", F.shiftright("link", 32)), "link-counts")
    highest = counts.groupBy("a").agg(F.max("n").alias("top"))
    counts = stored(counts.join(highest, "a").select("link", "n", (F.col("n") == F.col("top")).alias("best")), "link-ranks")
    each = rows.select("__row", F.inline(F.arrays_zip("links", "times")))
    few = counts.count() <= sent
    each = each.join(F.broadcast(counts) if few else counts, each["links"] == counts["link"])
    sums = each.groupBy("__row").agg(
        F.sum(F.col("times").cast("long")).alias("n_links"),
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0).cast("long")).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )
    names = ("n_links", "n_best", "count_sum")
    out = rows.drop("links", "times", *names).join(sums, "__row", "left").drop("__row")
    return out.withColumns({name: F.coalesce(name, F.lit(0).cast("long")) for name in names})
