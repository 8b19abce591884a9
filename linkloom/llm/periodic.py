"""Periodic runs of words in whole texts: Lyndon arrays by Baier's grouping, roots extended to runs.

Phase one of Baier's suffix sorter groups the suffixes by their longest Lyndon prefix, so the size of a suffix's group
is its Lyndon array entry. It is taken under the order of the words and under the reverse order. Each pair of a place
and its entry is a Lyndon root; the longest common extensions of both its ends make it a run, and by the runs theorem
every run comes from such a root under one of the two orders. Extensions are looked up in names of blocks of 1, 2, 4, ...
words, which are equal where the blocks are.

A sieve goes first: every window of a few words inside a run also stands one period further on or back. So runs lie
within stretches of windows that a text holds more than once, and only those stretches are grouped. It loses no run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import SPACE, doc_texts

#: a run has at least LEAST words and at least POWER periods
LEAST, POWER = 24, 3
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_UNSET = -2


def lyndon_lengths(ids: list[int]) -> list[int]:
    """The length of the longest Lyndon word that starts at each place.

    Groups of places are taken from the highest down. `back` of a place in the current group is the nearest place before
    it in a lower group. Places of one lower group that are pointed at equally often share one more piece of their Lyndon
    prefix: they become a group of their own right above the one they leave, the more often the higher.
    """
    members: dict[int, list[int]] = {}
    for at, word in enumerate(ids):
        members.setdefault(word, []).append(at)
    ranks = sorted(members)
    groups = [members[r] for r in ranks]
    size = [1] * len(groups)
    below = list(range(-1, len(groups) - 1))
    above = list(range(1, len(groups) + 1))
    above[-1:] = [-1] * bool(groups)
    group_of = [0] * len(ids)
    for number, places in enumerate(groups):
        for at in places:
            group_of[at] = number
    back = [_UNSET] * len(ids)
    current = len(groups) - 1
    while current >= 0:
        pointed: list[int] = []
        times: list[int] = []
        for at in groups[current]:
            if group_of[at] != current:  # it has left for a higher group
                continue
            lower = at - 1
            while lower >= 0 and back[lower] != _UNSET:
                lower = back[lower]
            back[at] = lower
            if lower < 0:
                continue
            if pointed and pointed[-1] == lower:
                times[-1] += 1
            else:
                pointed.append(lower)
                times.append(1)
        moved: dict[tuple[int, int], list[int]] = {}
        for lower, n in zip(pointed, times):
            moved.setdefault((n, group_of[lower]), []).append(lower)
        for n, left in sorted(moved, reverse=True):
            new, places = len(groups), moved[n, left]
            groups.append(places)
            size.append(size[left] + n * size[current])
            below.append(left)
            above.append(above[left])
            below[above[left]] = new
            above[left] = new
            for at in places:
                group_of[at] = new
        current = below[current]
    return [size[g] for g in group_of]


class Extensions:
    """Longest common extensions of pairs of places, to the right and to the left."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.names = [ids.astype(np.int64)]
        width = 1
        while 2 * width <= self.n:
            low = self.names[-1]
            pairs = low[:-width] * (int(low.max()) + 1) + low[width:]
            self.names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
            width *= 2

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on, for i < j <= n."""
        i, j, length = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            width, names = 1 << level, self.names[level]
            fits = np.flatnonzero(j + width <= self.n)
            hit = fits[names[i[fits]] == names[j[fits]]]
            for moved in (i, j, length):
                moved[hit] += width
        return length

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j, for i < j <= n."""
        i, j, length = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            width, names = 1 << level, self.names[level]
            fits = np.flatnonzero(i >= width)
            hit = fits[names[i[fits] - width] == names[j[fits] - width]]
            i[hit] -= width
            j[hit] -= width
            length[hit] += width
        return length


def _runs_within(ids: np.ndarray, least: int, power: int) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of one stretch."""
    places = np.arange(len(ids))
    extensions = Extensions(ids)
    found = set()
    for order in (ids, int(ids.max()) - ids):
        period = np.array(lyndon_lengths(order.tolist()), np.int64)
        start = places - extensions.left(places, places + period)
        length = places + period + extensions.right(places, places + period) - start
        good = (length >= least) & (length >= power * period)
        found |= set(zip(start[good].tolist(), length[good].tolist(), period[good].tolist()))
    return found


def _stretches(ids: np.ndarray, least: int, power: int) -> Iterator[tuple[int, int]]:
    """The parts of a text that runs can lie in: windows found twice or more, one beside the other."""
    window = least * (power - 2) // power + 1
    n = len(ids) - window + 1
    if n < max(1, least - window + 1):
        return
    mixed = np.zeros(n, np.uint64)  # equal windows have equal sums; further windows that do only make stretches longer
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64)
    order = np.argsort(mixed)
    alike = mixed[order[1:]] == mixed[order[:-1]]
    again = np.zeros(n + 2, np.int8)
    again[order[1:][alike] + 1] = 1
    again[order[:-1][alike] + 1] = 1
    steps = np.diff(again)
    for begin, end in zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist()):
        if end - begin >= least - window + 1:
            yield begin, end + window - 1


def runs_of(words: list, least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least `least` words and `power` (2 or more) periods, in order."""
    if len(words) < max(2, least):
        return []
    known = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    found = []
    for begin, end in _stretches(ids, least, power):
        part = np.unique(ids[begin:end], return_inverse=True)[1]
        found += [(begin + start, length, period) for start, length, period in _runs_within(part, least, power)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([words[k] for k in np.flatnonzero(kept).tolist()])


def periodic_runs(docs: DataFrame, least: int = LEAST, power: int = POWER) -> DataFrame:
    """One row per input row: doc_id, runs, collapsed.

    runs: (start, length, period), counted in words of the whole text, by start, then period. A run keeps its smallest
    period as far as it can on both sides. collapsed: the text with one period left of each run. Null and empty texts
    have no runs and an empty collapsed text. Rows are judged each on its own, whatever their ids.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            runs, texts = [], []
            for text in batch.column(1):
                words = text.as_py().encode().split()  # bytes: only ASCII white space parts words
                found = runs_of(words, least, power)
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                texts.append(collapsed(words, found).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(runs, pa.list_(_RUN)), pa.array(texts, pa.string())], schema=schema
            )

    made = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return doc_texts(docs).mapInArrow(run, made)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: the texts of a fixed tenth of the ids repeat a stretch of their words up to their end.

    With h the crc32 of the decimal id and g = floor(h / 10), texts with h % 10 = 0 repeat the p words from word a on,
    a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Rows without an id or without words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    rows = doc_texts(docs).select("doc_id", "text", h.alias("h"), g.alias("g"))

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = F.col("g") % n
        p = 1 + F.floor((n - a) / (3 + F.col("g") % 8))
        place = F.sequence(F.lit(0), n - 1)
        word = F.transform(place, lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.array_join(word, " ")

    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    made = F.transform(F.filter(F.array(words), lambda ws: F.size(ws) > 0), repeated)  # the words are made once
    return rows.select("doc_id", F.when(F.col("h") % 10 == 0, F.coalesce(F.get(made, F.lit(0)), "text")).otherwise(F.col("text")).alias("text"))


def longest_power(runs: Column) -> Column:
    """The run with the greatest exact length / period; ties: the smallest start, then period. Null without runs."""

    def order(x: Column, y: Column) -> Column:
        more, less = x["length"] * y["period"], y["length"] * x["period"]
        return (
            F.when(more != less, F.when(more > less, -1).otherwise(1))
            .when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1))
            .when(x["period"] != y["period"], F.when(x["period"] < y["period"], -1).otherwise(1))
            .otherwise(0)
        )

    return F.get(F.array_sort(runs, order), F.lit(0))
