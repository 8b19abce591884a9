"""URL verdicts: a fixed list of (host, path) rules, and association rules mined from labelled URLs by FP-growth.

Each labelled URL is a transaction of tokens of its host, path and query and of its label. Rules whose consequent is a
label, with enough confidence and support, are kept. A rule is filed in an inverted index under its rarest token, so a
URL meets only the rules filed under its own tokens, and those are checked whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import stored

#: MIN_COUNT: labelled URLs that a rule must hold for, whatever the size of the table
MIN_COUNT, MIN_CONFIDENCE, MOST_TOKENS = 10, 0.9, 3
_LABEL = "label "


@dataclass(frozen=True)
class ListRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: fixed values: the given rules
LIST = (
    ListRule("com", "/", "allow"),
    ListRule("example.com", "/en/", "block"),
    ListRule("www.example.com", "/en/", "allow"),
    ListRule("net", "/es/", "block"),
    ListRule("net", "/fr/", "block"),
)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z in lower case; empty without one."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(rules: tuple[ListRule, ...] = LIST) -> Column:
    """The name of the longest rule that fits columns host and path, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = (F.col("host") == rule.host) | F.endswith(F.col("host"), F.lit("." + rule.host))
        found = F.when(fits & F.startswith(F.col("path"), F.lit(rule.path)), F.lit(rule.name)).otherwise(found)
    return found


def url_tokens() -> Column:
    """Distinct tokens of columns url, host and path; numbers are one token, so transactions stay few."""
    labels = F.split("host", r"\.")
    parts = F.filter(F.split(F.regexp_replace("path", r"\d+", "0"), "/"), lambda p: p != "")
    keys = F.transform(F.split(F.regexp_extract("url", r"\?([^#]*)", 1), "&"), lambda kv: F.regexp_extract(kv, r"^[^=]*", 0))
    tokens = F.concat(
        F.array(F.concat(F.lit("host "), F.col("host"))),
        F.array(F.concat(F.lit("top "), F.element_at(labels, -1))),
        F.when(F.size(labels) > 2, F.array(F.concat(F.lit("sub "), labels[0]))).otherwise(F.array().cast("array<string>")),
        F.transform(parts, lambda p: F.concat(F.lit("part "), p)),
        F.transform(F.filter(keys, lambda k: k != ""), lambda k: F.concat(F.lit("key "), k)),
    )
    return F.array_sort(F.array_distinct(tokens))


def mine(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules (tokens, label, confidence, support) and token counts from rows (tokens, label).

    A rule needs MIN_COUNT rows. It names a label other than `other`; rows given that label count against a rule.
    """
    baskets = labelled.select(F.array_append("tokens", F.concat(F.lit(_LABEL), "label")).alias("items"))
    baskets = stored(baskets, "baskets")
    # half a count less, so that rounding up the product never asks for one more
    support = min(1.0, (MIN_COUNT - 0.5) / max(1, baskets.count()))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=MIN_CONFIDENCE).fit(baskets)
    sets = stored(model.freqItemsets, "itemsets")
    label = F.filter("items", lambda t: F.startswith(t, F.lit(_LABEL)))
    rest = F.array_sort(F.filter("items", lambda t: ~F.startswith(t, F.lit(_LABEL))))
    split = sets.select(rest.alias("tokens"), label.alias("label"), "freq").where(F.size("tokens") <= MOST_TOKENS)
    whole = split.where("size(label) = 0").select("tokens", F.col("freq").alias("covers"))
    both = split.where("size(label) = 1 and size(tokens) > 0").join(whole, "tokens")
    rules = both.select(
        "tokens", F.substring(F.col("label")[0], len(_LABEL) + 1, 1000).alias("label"),
        (F.col("freq") / F.col("covers")).alias("confidence"), F.col("freq").alias("support"),
    )
    counts = whole.where("size(tokens) = 1").select(F.col("tokens")[0].alias("token"), F.col("covers").alias("n"))
    return rules.where((F.col("confidence") >= MIN_CONFIDENCE) & (F.col("label") != "other")), counts


def matched(token_sets: DataFrame, rules: DataFrame, counts: DataFrame) -> DataFrame:
    """(tokens, label) of the best rule of each token set that one matches: most confident, then most supported."""
    numbered = stored(rules.withColumn("rule_id", F.xxhash64("tokens", "label")), "rules")
    filed = numbered.select("rule_id", F.explode("tokens").alias("token")).join(counts, "token")
    filed = filed.groupBy("rule_id").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    filed = numbered.withColumnRenamed("tokens", "needs").join(filed, "rule_id")
    met = token_sets.select("tokens", F.explode("tokens").alias("token")).join(filed, "token")
    met = met.where(F.size(F.array_except("needs", "tokens")) == 0)
    order = F.struct("confidence", "support", F.size("needs").alias("size"), F.col("label"), F.col("rule_id"))
    return met.groupBy("tokens").agg(F.max_by("label", order).alias("mined"))


def judged_urls(pages: DataFrame, rules: tuple[ListRule, ...] = LIST, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, mined for each row of (page_id, url).

    A fitting list rule decides. Other URLs get the label of the best mined rule, else `default`. The list's verdicts
    are the labels to mine from; URLs that it does not reach are held out. Null and odd URLs have empty host and path.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rows = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.select("page_id", "host", "path", listed_rule(rules).alias("rule"), url_tokens().alias("tokens"))
    rows = stored(rows, "urls")
    verdicts = F.lit(None).cast("string")
    for rule in rules:
        verdicts = F.when(F.col("rule") == rule.name, F.lit(rule.verdict)).otherwise(verdicts)
    open_sets = rows.where("rule is null").select("tokens").distinct()
    best = matched(open_sets, *mine(rows.where("rule is not null").select("tokens", verdicts.alias("label"))))
    return rows.join(best, "tokens", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce(verdicts, "mined", F.lit(default)).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("mined")).alias("mined"),
    )
