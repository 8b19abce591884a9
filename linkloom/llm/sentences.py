"""Repeated passages: sliding spans of sentences, hashed and joined over all documents.

Long sentences are cut into clauses at words that the words around them choose, so texts that share a passage cut it
alike but for less than CLAUSE words at an end that stands inside a sentence. From every clause on and up to every
clause, the shortest run of at least MIN_SENTENCES clauses and MIN_WORDS words is hashed, so every clause of a shared
stretch of that size is in a run that lies wholly inside it. Of equal runs the first by (doc_id, place) stays; the
clauses that any other one covers are repeated.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import doc_texts, same_key, stored

MIN_SENTENCES, MIN_WORDS = 2, 20
#: a sentence of this many words or more has a cut among each so many neighbouring words. Two ends of 15 words that are
#: cut unlike leave 20 of 50 shared words, in two clauses or more.
CLAUSE = 16
#: fixed values: marks that end a sentence in other scripts, and scripts that write no space between words
_ENDS = ".!?\u3002\uff01\uff1f\uff61\uff0e\u0964\u0965\u061f\u06d4\u0589\u1362\u1367\u104b\u17d4\u17d5"
_SPACELESS = ("\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
              "\uff66-\uff9f\U00020000-\U0003ffff")
_SENTENCE = re.compile(rf"[^{_ENDS}\n]*(?:[{_ENDS}]+|\n|$)")
_WORD = re.compile(r"[^\x20\x09-\x0d]+")
_WORD_OR_SIGN = re.compile(rf"[{_SPACELESS}]|[^\x20\x09-\x0d{_SPACELESS}]+")
_SIGN = re.compile(f"[{_SPACELESS}]")


def sentences(text: str) -> list[tuple[int, int, bytes, int]]:
    """(start, end, normalised bytes, words) of each clause with a word. A sign of a script without spaces is a word."""
    word = _WORD if text.isascii() or not _SIGN.search(text) else _WORD_OR_SIGN
    out = []
    for m in _SENTENCE.finditer(text):
        if word is _WORD:
            words = m.group().encode().lower().split()
        else:
            words = [w.encode().lower() for w in word.findall(m.group())]
        if not words:
            continue
        start, done = m.start(), 0
        if len(words) >= CLAUSE:
            ends = [w.end() for w in word.finditer(text, m.start(), m.end())]
            for k in clause_ends(words):
                out.append((start, ends[k], b" ".join(words[done : k + 1]), k + 1 - done))
                start, done = ends[k], k + 1
        out.append((start, m.end(), b" ".join(words[done:]), len(words) - done))
    return out


def clause_ends(words: list[bytes]) -> list[int]:
    """The word with the least hash, the last of equals, of each CLAUSE neighbours; without the last word of all."""
    hashes, out, best = [zlib.crc32(w) for w in words], [], -1
    for at in range(len(words) - CLAUSE + 1):
        end, was = at + CLAUSE - 1, best
        if best < at:
            least = min(hashes[at : end + 1])
            best = next(k for k in range(end, at - 1, -1) if hashes[k] == least)
        elif hashes[end] <= hashes[best]:
            best = end
        if best != was and best < len(words) - 1:
            out.append(best)
    return out


def runs(text: str) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(first, last, start, end, 128-bit hash) of the shortest run that begins and the one that ends at each clause."""
    found = sentences(text)
    first, words = 0, 0
    bounds = set()
    for last, clause in enumerate(found):  # the latest begin for each end
        words += clause[3]
        while last - first >= MIN_SENTENCES and words - found[first][3] >= MIN_WORDS:
            words -= found[first][3]
            first += 1
        if last - first + 1 >= MIN_SENTENCES and words >= MIN_WORDS:
            bounds.add((first, last))
    last, words = -1, 0
    for first, clause in enumerate(found):  # the earliest end for each begin
        while last + 1 < len(found) and (last - first + 1 < MIN_SENTENCES or words < MIN_WORDS):
            last += 1
            words += found[last][3]
        if last - first + 1 < MIN_SENTENCES or words < MIN_WORDS:
            break
        bounds.add((first, last))
        words -= clause[3]
    for first, last in sorted(bounds):
        joined = b"\n".join([s[2] for s in found[first : last + 1]])
        yield first, last, found[first][0], found[last][1], xxhash.xxh3_128_digest(joined)


def _told_apart(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The texts, and the columns that name a row: doc_id, with a number of its own where rows share an id or have none."""
    rows = doc_texts(docs)
    if rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return rows, ["doc_id"]
    return stored(rows.withColumn("copy", F.monotonically_increasing_id()), "numbered"), ["doc_id", "copy"]


def repeated_spans(docs: DataFrame) -> DataFrame:
    """One row per removed span: doc_id, first_sentence, last_sentence, start, end, first_doc_id.

    first_sentence and last_sentence count clauses. start and end are code points of the whole text; overlapping and
    touching spans of a row are one. first_doc_id is the smallest doc_id that keeps a passage of the span, null when only
    rows without an id do. Texts that are null, empty or too short have no runs. Rows that share a doc_id or have none are
    told apart by a number, each with spans of its own; rows without an id come first.
    """
    rows, who = _told_apart(docs)
    return _spans(rows, who).select("doc_id", "first_sentence", "last_sentence", "start", "end", "first_doc_id")


def _spans(rows: DataFrame, who: list[str]) -> DataFrame:
    own = [(name, pa.int64()) for name in who]
    places = ("first", "last", "start", "end")
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), *own, *((p, pa.int32()) for p in places)])

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            counts, found = [], []
            for text in batch.column(0):
                n = len(found)
                found += runs(text.as_py())
                counts.append(len(found) - n)
            *at, keys = zip(*found) if found else [()] * 5
            halves = np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2)
            row = pa.array(np.repeat(np.arange(len(counts)), counts))
            names = [batch.column(1 + k).take(row) for k in range(len(who))]
            columns = [pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), *names]
            columns += [pa.array(p, pa.int32()) for p in at]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    spans = rows.select("text", *who).mapInArrow(cut, ", ".join(f"{f.name} {'int' if f.name in places else 'long'}" for f in schema))
    spans = stored(spans, "runs")
    place = F.struct(*who, "first")
    keepers = spans.groupBy("h1", "h2").agg(F.min(place).alias("keeper"), F.count("*").alias("n")).where("n > 1")
    keepers = stored(keepers, "keepers")  # both sides then come by an exchange, so a hot passage's side can be split

    def pair(a: str, b: str) -> Column:  # shorter rows for the exchange
        return F.shiftleft(F.col(a).cast("long"), 32).bitwiseOR(F.col(b))

    narrow = spans.select("h1", "h2", *who, pair("first", "last").alias("clauses"), pair("start", "end").alias("chars"))
    # Spark filters the large side before its exchange by a Bloom filter of the keepers, of at most 8 MB
    for name, value in (("creationSideThreshold", "1TB"), ("applicationSideScanSizeThreshold", "0")):
        rows.sparkSession.conf.set(f"spark.sql.optimizer.runtime.bloomFilter.{name}", value)
    whole = narrow.join(keepers.where("n > 1").drop("n"), ["h1", "h2"]).select(
        *who, "keeper",
        F.shiftright("clauses", 32).cast("int").alias("first"), F.col("clauses").bitwiseAND(0xFFFFFFFF).cast("int").alias("last"),
        F.shiftright("chars", 32).cast("int").alias("start"), F.col("chars").bitwiseAND(0xFFFFFFFF).cast("int").alias("end"),
    )
    again = whole.where(~place.eqNullSafe(F.col("keeper")))
    return merged(again.select(*who, *places, F.col("keeper.doc_id").alias("by")), who)


def merged(spans: DataFrame, who: list[str]) -> DataFrame:
    """Spans of a row that overlap or touch, as one."""
    order = Window.partitionBy(*who).orderBy("first", "last")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("first") > before + 1, F.lit(True)).cast("int")
    numbered = spans.withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*who, "island").agg(
        F.min("first").alias("first_sentence"), F.max("last").alias("last_sentence"),
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("by").alias("first_doc_id"),
    ).drop("island")


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and the text without its own repeated spans, for every row; rows that share an id are cut each by its own."""
    texts, who = _told_apart(docs)
    spans = _spans(texts, who).groupBy(*who).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    rows = texts.join(spans, same_key(texts, spans, *who), "left").select(texts["doc_id"], "text", "spans")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc, span):
        piece = F.substring("text", acc["at"] + 1, span["start"] - acc["at"])
        return F.struct(span["end"].alias("at"), F.concat(acc["out"], piece).alias("out"))

    kept = F.aggregate("spans", begin, add, lambda acc: F.concat(acc["out"], F.substring("text", acc["at"] + 1, F.length("text"))))
    return rows.select("doc_id", F.coalesce(kept, "text").alias("text"))
