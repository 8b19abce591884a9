"""Quality rules: a decision list learned from labelled statistics by sequential covering.

Each rule is a conjunction of thresholds on ratios of a text's statistics. Rules are grown on two thirds of the
labelled rows by information gain, pruned on the other third, and the rows a rule covers are taken away before the next
is grown. The list becomes one ordered Spark conditional expression: the first rule that holds rejects a document.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.common import stored

#: labelled rows that the list is fitted on at most, the ones with the smallest hash of their id
LABELLED = 20_000
MIN_WORDS, REPEAT_SHARE, WINDOW = 20, 30, 8
#: a rule is taken when it is right in this share of the held-back rows it covers, and covers this many of them
PRECISION, LEAST_COVER = 0.97, 5
MAX_CONDITIONS, MAX_RULES, CUTS = 4, 12, 48

#: fixed values: characters counted as symbols, and the white space of the contract
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\r\x0b\x0c"

STATS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks",
    "n_distinct", "top_words",
)

#: what rules compare: each a statistic per unit of another
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
    "repeats_per_word": ("n_repeat_words", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "upper_per_char": ("n_upper", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "distinct_per_word": ("n_distinct", "n_words"),
    "top_per_word": ("top_words", "n_words"),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.feature] >= self.cut if self.above else values[self.feature] <= self.cut

    def column(self) -> Column:
        value = feature(self.feature)
        return value >= self.cut if self.above else value <= self.cut


def feature(name: str) -> Column:
    part, whole = FEATURES[name]
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def text_stats(text: str | None) -> tuple[int, ...]:
    """The values of STATS for one whole text; null has no words."""
    if not text:
        return (0,) * len(STATS)
    words = text.encode().split()
    n = len(words)
    if not n:
        return (0,) * len(STATS)
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    counts = Counter(words)
    return (
        n,
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words, WINDOW) if len(counts) < n else 0,
        len(lines),
        sum(map(str.isupper, text)) if not text.islower() else 0,
        text.count("!") + text.count("?"),
        len(counts),
        counts.most_common(1)[0][1],
    )


def repeated_words(words: list[bytes], window: int) -> int:
    """Words inside windows that occur at least twice; `window` is a power of two.

    Windows are numbered exactly: pairs of equal halves get equal numbers, from single words up to the full window.
    """
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    size = 1
    while size < window:
        pairs = rank[:-size] * (n + 1) + rank[size:]
        values, rank = np.unique(pairs, return_inverse=True)
        if len(values) == len(pairs):
            return 0
        size *= 2
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(n + 1, dtype=np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge) > 0).sum())


@F.pandas_udf(T.StructType([T.StructField(name, T.LongType()) for name in STATS]))
def stats_of(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_stats(t) for t in texts], columns=list(STATS), dtype="int64")


def with_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, statistics) for each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), stats_of("text").alias("s"))
    return rows.select("doc_id", "s.*")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))


def learn_rules(docs: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """A decision list for quality 0, from at most LABELLED labelled documents that pass the base rules.

    Labels without an id or a quality are left out; no labels give an empty list, which keeps everything.
    """
    picked = labels.where("doc_id is not null and quality is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")
    )
    picked = stored(picked.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(LABELLED), "labelled")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.join(F.broadcast(picked.select("doc_id").distinct()), "doc_id", "left_semi")  # at most LABELLED ids
    rows = with_stats(stored(rows, "sample")).where(~base_failed()).join(F.broadcast(picked), "doc_id")
    return covering(rows.select("doc_id", "quality", *STATS).orderBy("doc_id", *STATS).limit(2 * LABELLED).toPandas())


def covering(rows: pd.DataFrame) -> list[list[Condition]]:
    values = {
        name: (rows[part] / rows[whole].clip(lower=1)).to_numpy(float) for name, (part, whole) in FEATURES.items()
    }
    bad = rows["quality"].to_numpy() == 0
    pruning = np.arange(len(rows)) % 3 == 2
    left, rules = np.ones(len(rows), dtype=bool), []
    while len(rules) < MAX_RULES and (left & bad & ~pruning).any():
        rule = _grow(values, bad, left & ~pruning)
        rule = _prune(rule, values, bad, left & pruning)
        covered = left & _all_hold(rule, values)
        held = covered & pruning
        if not rule or held.sum() < LEAST_COVER or bad[held].mean() < PRECISION:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def _all_hold(rule: list[Condition], values: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(values.values()))), dtype=bool)
    for condition in rule:
        out &= condition.holds(values)
    return out


def _grow(values, bad, rows) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < MAX_CONDITIONS and (rows & ~bad).any():
        p, n = (rows & bad).sum(), (rows & ~bad).sum()
        best, gain = None, 0.0
        for name, value in values.items():
            cuts = np.unique(np.quantile(value[rows & bad], np.linspace(0, 1, CUTS)))
            for cut in cuts.tolist():
                for above in (True, False):
                    inside = rows & (value >= cut if above else value <= cut)
                    p1 = (inside & bad).sum()
                    if not p1:
                        continue
                    n1 = inside.sum() - p1
                    found = p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p / (p + n)))
                    if found > gain + 1e-9:
                        best, gain = Condition(name, above, cut), found
        if best is None:
            break
        rule.append(best)
        rows = rows & best.holds(values)
    return rule


def _prune(rule, values, bad, rows) -> list[Condition]:
    """The shortest start of the rule that is worth most on the held-back rows."""

    def worth(part: list[Condition]) -> float:
        inside = rows & _all_hold(part, values)
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        return (p - 4 * n) / max(1, (rows & bad).sum())

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth, default=[])


def keeps(rules: list[list[Condition]]) -> Column:
    """The verdict as one conditional expression over the statistics."""
    verdict = F.when(base_failed(), F.lit(False))
    for rule in rules:
        whole = F.lit(True)
        for condition in rule:
            whole = whole & condition.column()
        verdict = verdict.when(whole, F.lit(False))
    return verdict.otherwise(F.lit(True))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, STATS, base_failed, kept for each row of docs."""
    rules = learn_rules(docs, labels)
    return with_stats(docs).select("*", base_failed().alias("base_failed"), keeps(rules).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows and columns of docs that the rules keep."""
    rules = learn_rules(docs, labels)
    rows = docs.select(F.struct("*").alias("__row"), stats_of("text").alias("__stats"))
    good = rows.select("__row", "__stats.*").where(keeps(rules))
    return good.select("__row.*")
