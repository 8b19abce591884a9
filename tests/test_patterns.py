"""The analysis of submitted regular expressions against a count of the ways to match."""

from collections import Counter

import pytest

from linkloom.sources.lint import lint
from linkloom.sources.patterns import _Reader, pattern_report, report

BROKEN = {
    "(": "unclosed group", "a)": "unmatched )", "[z-a]": "range out of order", "[abc": "unclosed character class",
    "*a": "nothing to repeat", "a**": "nothing to repeat", "{2}": "nothing to repeat", "a{2}{3}": "nothing to repeat",
    "x{3,1}": "numbers of a repeat out of order", "a\\": "\\ at the end", "(?<n>a)(?<n>b)": "group name used twice",
    "(?P<n>a)": "invalid group", "(?<>a)": "invalid group", "(?": "invalid group", "(?<=a)*": "nothing to repeat",
    "^*": "nothing to repeat",
}
#: pattern → text before and after the repeated one
RISKY = {"(a|a)*": ("", ""), "(a+)+": ("", ""), "(a*)*": ("", ""), "(.*,)*": ("", ","), "(a?a?)*": ("", ""),
         "(a{2,5})+": ("aa", "aa"), "( *, *)+": (",", " ,"), "((a?|b?)c)*": ("", "c"), "(a|[a-z])*y": ("", "y"),
         "(a{1,50}){1,50}": ("", ""), "(ab|a|b)*": ("", ""), "([^]*x)*": ("", "x")}
SAFE = ["(a+,)*", "(a|ab)*", "(a?){3,}", "(a{2}){3}", "(ab|cd)*", "([a-z]+-)*[a-z]+", "a{,3}", "[]+", "", "[^]+", "a+?b*",
        "(a*b)*", "(aa|ab)*c"]


@pytest.mark.parametrize("pattern", BROKEN)
def test_does_not_compile(pattern):
    assert report(pattern) == (f"regex does not compile: {BROKEN[pattern]}", None, None)


def ends(tree, text, at) -> Counter:
    """Where a match from `at` may end, and in how many ways; a repeat takes no empty turn."""
    if tree[0] == "set":
        ok = at < len(text) and any(low <= ord(text[at]) <= high for low, high in tree[1])
        return Counter({at + 1: 1}) if ok else Counter()
    if tree[0] == "alt":
        return sum((ends(part, text, at) for part in tree[1]), Counter())
    if tree[0] == "cat":
        now = Counter({at: 1})
        for part in tree[1]:
            now = step(part, text, now)
        return now
    _, part, low, high = tree
    now = Counter({at: 1})
    for _ in range(low):
        now = step(part, text, now)
    total = Counter(now)
    for _ in range(min(len(text) + 1 if high is None else high - low, len(text) + 1)):
        now = sum((Counter({e: w * n for e, w in ends(part, text, s).items() if e > s}) for s, n in now.items()), Counter())
        total += now
    return total


def step(part, text, now):
    return sum((Counter({e: w * n for e, w in ends(part, text, s).items()}) for s, n in now.items()), Counter())


@pytest.mark.parametrize("pattern", RISKY)
def test_pump_doubles_the_ways(pattern):
    reason, _, pump = report(pattern)
    assert reason == "regex repeats in more ways than one"
    tree, (before, after) = _Reader(pattern).read(), RISKY[pattern]
    few, many = (max(ends(tree, before + pump * k + after, 0).values()) for k in (4, 10))
    assert many >= 2**6 * few


@pytest.mark.parametrize("pattern", SAFE)
def test_safe_patterns_match_in_few_ways(pattern):
    assert report(pattern)[0] is None
    tree = _Reader(pattern).read()
    for text in ("a" * 12, "ab" * 6, "a," * 6, "a-" * 6, "cdab" * 3):
        assert max(ends(tree, text, 0).values(), default=0) <= 100


def test_size_limits_and_look_around():
    assert report("(a{20}){20}b{20}")[0] == "regex is too large"
    assert report("(" * 60 + ")" * 60)[0] == "regex is too large"
    assert report("(?=(a+)+)b")[0] == "regex repeats in more ways than one"
    assert report("(?:[a-z]+-)*[a-z]+") == (None, 2, None)
    assert report("[\\ud800-\\udfff]+(\\ud800|\\ud800)*")[2] == "??"


def test_reports_in_tables(spark):
    df = spark.createDataFrame([(1, "(a+)+", "x"), (2, "(", None), (3, None, None), (4, "#(\\w+)", None)], "id int, pattern string, report string")
    got = {r["id"]: r["found"] for r in pattern_report(df, out="found").collect()}
    assert got[1]["reason"].startswith("regex repeats") and got[1]["star_height"] == 2 and got[1]["pump"] == "a"
    assert got[2]["reason"] == "regex does not compile: unclosed group"
    assert got[3] == (None, None, None) and got[4] == (None, 1, None)
    assert pattern_report(df.limit(0), out="found").count() == 0


def test_lint_names_the_pattern(spark):
    rule = '{"title": "t", "schema": {"s": {"o": [{"selector": "a"}, {"selector": "b", "postProcess": {"method": "%s", "params": "%s"}}]}}}'
    sets = [("regex", "(a|a)*"), ("regex", "["), ("regex", "#([a-z]+)"), ("split", "(")]
    df = spark.createDataFrame([(k, rule % s) for k, s in enumerate(sets)] + [(9, None)], "id int, rule_set string")
    got = {r["id"]: r["reason"] for r in lint(df).collect()}
    assert got == {0: "regex repeats in more ways than one", 1: "regex does not compile: unclosed character class", 2: None, 3: None, 9: "not a JSON object"}
