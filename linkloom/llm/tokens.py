"""Token ids of whole texts by a public tokenizer whose tokens never span white space."""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from linkloom.llm.common import doc_texts

END_ID = 1
#: how many chunks and how many words one Python worker remembers
CHUNKS_HELD = 200_000
WORDS_HELD = 200_000

#: fixed value: the word pattern of the tokenizer file, for texts all of whose characters are known to be plain
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|[_\x1c-\x1f])+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Remembers the ids of lower-case chunks between white space, as little-endian 32-bit bytes.

    New words are encoded together, joined by spaces; their ids are told apart by the mark of a word's last token.
    Texts that Python might lower-case or split in another way than the tokenizer are left to the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path)
        if self.model.normalizer is None or self.model.normalizer.normalize_str("A\u0301\tB  C") != "\u00e1 b c":
            raise ValueError(f"{path} must compose and lower-case its texts and part words at white space")
        vocab = self.model.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.last[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.plain_chars: set[str] = {chr(c) for c in range(128)}
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):  # such a token ends words early and has an id of its own
            return self.plain(text)
        normal = text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        if not (normal.isascii() or self._all_plain(normal)):
            return self.plain(text)
        chunks = normal.lower().encode().split()
        held = self.chunks
        new = set(chunks).difference(held)
        if not new:
            return b"".join(map(held.__getitem__, chunks))
        found = self._new_chunks(new)
        if len(held) + len(found) <= CHUNKS_HELD:
            held.update(found)
            return b"".join(map(held.__getitem__, chunks))
        return b"".join([found[c] if c in found else held[c] for c in chunks])

    def _new_chunks(self, new: set[bytes]) -> dict[bytes, bytes]:
        parts = {c: _WORDS.findall(c.decode()) for c in new}
        words = self.words
        missing = list({w for ws in parts.values() for w in ws}.difference(words))
        found = dict(zip(missing, self._new_words(missing), strict=True)) if missing else {}
        if len(words) + len(found) <= WORDS_HELD:
            words.update(found)
            found = {}
        return {c: b"".join([found[w] if w in found else words[w] for w in ws]) for c, ws in parts.items()}

    def _all_plain(self, text: str) -> bool:
        """Whether Python and the tokenizer agree on each character's lower case and kind."""
        for c in set(text).difference(self.plain_chars):
            if c == "\u03a3" or self.model.normalizer.normalize_str(c) != c.lower():  # sigma: lower case by place
                return False
            if unicodedata.category(c) == "Cn" or c.isspace() or (c.isnumeric() and not c.isalpha()):
                return False
            self.plain_chars.add(c)
        return True

    def _new_words(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.model.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):  # a word that the pattern here splits in another way
            return [self.plain(w) for w in words]
        raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per Python worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def check_vocabulary(path: str, most: int) -> None:
    """Refuse a tokenizer with ids of `most` or more."""
    held = max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())
    if held >= most:
        raise ValueError(f"{path} has ids up to {held}; they must stay below {most}")


def token_pieces(docs: DataFrame, capacity: int, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece of at most `capacity` ids: doc_id, piece, start, length, and ids_crc32 or the ids.

    A text's ids end with END_ID, so an empty or null text has one piece of length 1. Only longer ones are cut. The ids
    are little-endian and of 16 bits, so they are given for vocabularies of up to 65,536 only; their crc32 is of 32-bit ids.
    """
    path = path or default_tokenizer()
    if with_ids:
        check_vocabulary(path, 1 << 16)
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
              ("ids", pa.binary()) if with_ids else ("ids_crc32", pa.int64())]
    schema = pa.schema(fields)
    end = np.array([END_ID], "<u4").tobytes()

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode
        for batch in rows:
            raws = [encode(text.as_py()) + end for text in batch.column(1)]
            sizes = np.fromiter(map(len, raws), np.int64, len(raws)) // 4
            n_pieces = -(-sizes // capacity)
            row = np.repeat(np.arange(len(raws)), n_pieces)
            piece = np.arange(len(row)) - (np.cumsum(n_pieces) - n_pieces)[row]
            length = np.minimum(capacity, sizes[row] - piece * capacity)
            ends, data = np.cumsum(length), b"".join(raws)
            if with_ids:
                last = binary_column(np.frombuffer(data, "<u4").astype("<u2"), ends)
            else:
                view = memoryview(data)
                last = pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip((ends - length).tolist(), ends.tolist())], pa.int64())
            columns = [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity),
                       pa.array(length), last]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return doc_texts(docs).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, " + ("ids binary" if with_ids else "ids_crc32 long"))


def binary_column(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Neighbouring stretches of one array, by their ends, as a column of bytes."""
    offsets = np.concatenate([[0], ends * values.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])
