"""Secrets in texts, found with a trigram inverted index; DataFrame functions only.

From each pattern a Boolean query over trigrams is derived: alternatives, each a set of trigrams that a match must
hold. The index has a posting (trigram, doc_id) for the trigrams of all queries. Postings are intersected by counting,
and only documents that meet an alternative are checked with the pattern itself. A pattern that no trigram must be in
is checked on every document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import doc_texts, same_key, stored

_PARSER, _CODES = re._parser, re._constants  # the standard library's reading of a pattern
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0  # characters of that group


# fixed values: the base rules, in the order that breaks ties, then the added ones
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{24,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of lower-case trigrams, one of which every match holds whole; empty when there is none.

    Some short alternative without a trigram makes the whole query empty: such a pattern has to scan.
    """
    wholes = _required(_PARSER.parse(pattern))
    return sorted((c for c in wholes if not any(d < c for d in wholes)), key=sorted) if frozenset() not in wholes else []


def _required(parts) -> set[frozenset[str]]:
    """Trigram sets of a sequence: every run of parts with few strings asks for the trigrams of one of them."""
    found: set[frozenset[str]] = {frozenset()}
    run = {""}

    def meet(more: set[frozenset[str]]) -> None:
        nonlocal found
        both = {a | b for a in found for b in more}
        found = both if len(both) <= MOST_STRINGS else found

    for part in parts:
        few = _strings(part)
        if few is not None and len(run) * len(few) <= MOST_STRINGS:
            run = {a + b for a in run for b in few}
            continue
        meet({_trigrams(s) for s in run})
        run = {""} if few is None else few
        if few is None and part[0] is _CODES.SUBPATTERN:
            meet(_required(part[1][3]))
    meet({_trigrams(s) for s in run})
    return found


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _strings(part) -> set[str] | None:
    """All strings a part of a pattern can match, in lower case, or None when they are many."""
    code, value = part
    if code is _CODES.LITERAL:
        return {chr(value).lower()}
    if code is _CODES.IN:
        letters = {chr(v).lower() for c, v in value if c is _CODES.LITERAL}
        return letters if all(c is _CODES.LITERAL for c, _ in value) and len(letters) <= 8 else None
    if code is _CODES.SUBPATTERN:
        return _joined(value[3])
    if code is _CODES.BRANCH:
        arms = [_joined(arm) for arm in value[1]]
        return None if any(a is None for a in arms) else set().union(*arms)
    if code is _CODES.MAX_REPEAT and value[1] <= 3:
        inner = _joined(value[2])
        if inner is not None and len(inner) ** value[1] <= MOST_STRINGS:
            return {"".join(p) for n in range(value[0], value[1] + 1) for p in product(inner, repeat=n)}
    return None


def _joined(parts) -> set[str] | None:
    out = {""}
    for part in parts:
        few = _strings(part)
        if few is None or len(out) * len(few) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in few}
    return out


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id) for each of the trigrams that a text holds in either case."""
    low = F.lower("text")
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(low, t))
    return doc_texts(docs).select("doc_id", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, kinds): the indexed rules whose query the document's postings meet."""
    clauses = [(r.kind, k, t, len(c)) for r in rules for k, c in enumerate(trigram_query(r.pattern)) for t in sorted(c)]
    spark = docs.sparkSession
    asked = spark.createDataFrame(clauses, "kind string, clause int, trigram string, needed int")
    index = stored(postings(docs, sorted({c[2] for c in clauses})), "postings")
    met = index.join(F.broadcast(asked), "trigram")  # as many rows as the fixed rules have trigrams
    met = met.groupBy("doc_id", "kind", "clause").agg(F.count_distinct("trigram").alias("n"), F.first("needed").alias("needed"))
    return met.where("n = needed").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _spans(rule: Rule, order: int) -> Column:
    """The rule's matches as (start, kind, end) in code points: gaps between matches give the places."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    held = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    steps = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), matches.alias("match"), held.alias("held"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def add(acc: Column, step: Column) -> Column:
        begin = acc["at"] + F.length(step["gap"])
        end = begin + F.length(step["match"])
        one = F.array(F.struct(begin.alias("start"), F.lit(order).alias("kind"), end.alias("end")))
        good = F.length(step["held"]) >= rule.least
        return F.struct(F.coalesce(end, begin).alias("at"), F.when(good, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(steps, start, add, lambda acc: acc["out"])


def find_secrets(docs: DataFrame, base: tuple[Rule, ...] = BASE, added: tuple[Rule, ...] = ADDED) -> DataFrame:
    """doc_id, a list of spans for each kind, one row per input row.

    Spans are (start, kind number, end) in code points of the whole text, leftmost and not overlapping in a kind. Null
    and empty texts have none. Repeated rows each get their own.
    """
    rules = base + added
    texts = doc_texts(docs)
    found = candidates(docs, rules).withColumnRenamed("doc_id", "__id")
    rows = texts.join(found, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    none = F.array().cast(_SPAN)
    out = []
    for order, rule in enumerate(rules):
        asked = F.array_contains("kinds", rule.kind) if trigram_query(rule.pattern) else F.lit(True)
        out.append(F.when(asked & F.rlike("text", F.lit(rule.pattern)), _spans(rule, order)).otherwise(none).alias(rule.kind))
    return rows.select("doc_id", *out)


def listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of all spans by start, then kind as listed, joined by commas."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    one = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    return F.array_join(one, ",")
