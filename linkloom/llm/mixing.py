"""Temperature mixing of sources.

A source with share p of the tokens gets the weight p^a / sum of p^a. The exponent a is bisected to the first point,
from 1 down, where the entropy of the weights reaches its target or a source would repeat more often than the limit.
The budget lets every source's documents come at least once, so nothing is lost; small sources come again. The stream is
cut into blocks, each with every source's share of the block's budget, in a hashed order inside the block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import WORD, stored

ENTROPY, REPEATS = 0.98, 1.5
BLOCK_TOKENS = 1_000_000
#: documents that one task orders
BUCKET = 4_000
_SECTIONS, _ROUNDS = 32, 5


def tokens_of(text: Column) -> Column:
    """Words between white space; at least 1, so an empty or null text has a place too."""
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)), F.lit(1)).cast("long")


def exponent(sources: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS) -> float:
    """The exponent for rows (source, tokens): the largest in [0, 1] at which a target is met, else 0.

    entropy: target as a share of the entropy of equal weights. repeats: how often the smallest source may come when the
    largest comes once. Each round looks at many exponents in one aggregation and narrows to the section of the change.
    """
    total, n, most, least = sources.agg(F.sum("tokens"), F.count("*"), F.max("tokens"), F.min("tokens")).first()
    if not n or n == 1 or most == least:
        return 1.0
    floor = max(0.0, 1 - math.log(repeats) / math.log(most / least))
    low, high = floor, 1.0
    share = F.col("tokens") / F.lit(float(total))
    for _ in range(_ROUNDS):
        points = [low + (high - low) * k / _SECTIONS for k in range(_SECTIONS + 1)]
        sums = [f for a in points for f in (F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.log(share)))]
        row = sources.agg(*sums).first()
        met = [k for k, a in enumerate(points) if _entropy(a, row[2 * k], row[2 * k + 1]) >= entropy * math.log(n)]
        if not met:
            return floor
        last = max(met)
        if last == _SECTIONS:
            return high
        low, high = points[last], points[last + 1]
    return low


def _entropy(a: float, total: float, logs: float) -> float:
    return math.log(total) - a * logs / total


def mixed(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per place in the stream: doc_id, source, tokens, epoch, block, place, weight.

    Every row of docs has epoch 0; further epochs are those its source's budget reaches. A null source is one of its own.
    place orders the documents of a block. An empty table gives no rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        tokens_of(F.col("text")).alias("tokens"), F.xxhash64("text").alias("print"),
    )
    return _stream(stored(rows, "lengths"), entropy, repeats, block_tokens).drop("print")


def _stream(rows: DataFrame, entropy: float, repeats: float, block_tokens: int) -> DataFrame:
    key = F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")))
    rows = rows.withColumn("key", key)
    sources = stored(rows.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "sources")
    a = exponent(sources, entropy, repeats)
    total, most = sources.agg(F.sum("tokens"), F.max("tokens")).first()
    if not total:
        return rows.select("doc_id", "source", "tokens", F.lit(0).alias("epoch"), F.lit(0).cast("long").alias("block"),
                           F.lit(0).cast("long").alias("place"), F.lit(0.0).alias("weight"), "print").where("false")
    # the quota of source i is w_i * budget = tokens_i * (most / tokens_i) ^ (1 - a): the largest source comes once
    quota = F.col("tokens") * F.pow(F.lit(float(most)) / F.col("tokens"), F.lit(1 - a))
    budget = sources.agg(F.sum(quota)).first()[0]
    n_blocks = max(1, math.ceil(budget / block_tokens))
    plan = sources.select(
        "key", F.col("tokens").alias("all_tokens"), F.ceil(F.col("docs") / BUCKET).alias("buckets"), quota.alias("quota"),
        (quota / F.lit(budget)).alias("weight"),
    )
    epochs = F.sequence(F.lit(0), F.greatest(F.lit(0), (F.ceil(F.col("quota") / F.col("all_tokens") - 1e-9) - 1)).cast("int"))
    rows = rows.join(plan, "key").withColumn("epoch", F.explode(epochs))
    rows = rows.withColumn("order", F.xxhash64("doc_id", "print", "epoch"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("order"), F.col("buckets")))
    sums = rows.groupBy("key", "epoch", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    earlier = Window.partitionBy("key", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("key", "epoch", "bucket", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("key", "epoch", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    rows = rows.join(sums, ["key", "epoch", "bucket"])
    at = F.col("epoch") * F.col("all_tokens") + F.col("before") + F.col("within")
    rows = rows.withColumn("at", at).where((F.col("epoch") == 0) | (F.col("at") < F.col("quota")))
    block = F.least(F.floor(F.col("at") / F.col("quota") * n_blocks), F.lit(n_blocks - 1)).cast("long")
    return rows.select("doc_id", "source", "tokens", "epoch", block.alias("block"), F.col("order").alias("place"), "weight", "print")


def remix(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS) -> DataFrame:
    """The rows and columns of docs, each as often as the mixture asks, at least once.

    Rows that repeat both doc_id and text come equally often.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        tokens_of(F.col("text")).alias("tokens"), F.xxhash64("text").alias("print"),
    )
    places = _stream(stored(rows, "lengths"), entropy, repeats, BLOCK_TOKENS)
    times = places.where("epoch > 0").groupBy("doc_id", "print").agg(F.max("epoch").alias("__more"))
    times = times.withColumnsRenamed({"doc_id": "__id", "print": "__print"})
    match = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__print"))
    again = F.explode(F.sequence(F.lit(0), F.coalesce("__more", F.lit(0))))
    return docs.join(times, match, "left").withColumn("__epoch", again).select(*[docs[c] for c in docs.columns])
