import itertools

import pytest

from linkloom.functions.dates import DateRange, parse_range
from linkloom.functions.safety import clean_inputs
from linkloom.functions.tags import fuzzy_tags
from linkloom.functions.urls import tidy_url
from linkloom.plans.spec import QuerySpec, params_from_url, spec_error

INSTANCE = "https://lg.example/"


def build(what="pages", by="thorped", **options):
    return QuerySpec.build(what, by, instance=INSTANCE, **options)


EXTRAS = [{}, {"when": "recent"}, {"when": "before-2025-01-01"}, {"when": "after-2024-01-01"}, {"match": "all"},
          {"limit": "1000"}, {"rt": "demo"}]
BYS = ["thorped", "linked", "backlinked", "cited", "bookmarked", "posted"]


@pytest.mark.parametrize("what,by", itertools.product(["everything", "pages", "thorpes", "domains"], BYS))
def test_matrix_builds_and_round_trips(what, by):
    for extra in EXTRAS:
        spec = build(what, by, s="https://a.example", o="demo", **extra)
        again = QuerySpec.from_json(spec.to_json())
        assert again == spec
        assert spec_error(spec.to_dict()) is None


def test_auto_modes():
    assert build(o="demo").objects.mode == "exact"
    assert build(by="linked", o="demo").objects.mode == "fuzzy"
    assert build(by="linked", o="https://x.example/").objects.mode == "exact"
    assert build(s="a.example").subjects.mode == "fuzzy"
    assert build(s="https://a.example/").subjects == build(s="https://a.example").subjects
    assert build(by="in-webring", s="https://ring.example").subjects.mode == "byParent"
    assert build(what="pages", by="members", s="https://r.example").objects.type == "pagesOnly"


@pytest.mark.parametrize(
    "match,modes",
    [("exact", ("exact", "exact")), ("fuzzy", ("fuzzy", "fuzzy")), ("fuzzy-s", ("fuzzy", "exact")),
     ("fuzzy-object", ("exact", "fuzzy")), ("very-fuzzy", ("fuzzy", "very-fuzzy")), ("all", ("exact", "all")),
     ("very-fuzzy-o", ("exact", "very-fuzzy"))],
)
def test_match_modes(match, modes):
    spec = build(s="https://a.example", o="x", match=match)
    assert (spec.subjects.mode, spec.objects.mode) == modes


def test_exclusions_are_kept_in_every_mode():
    for match in (None, "exact", "all", "fuzzy"):
        spec = build(s="https://a.example", o="x", not_s="https://b.example", not_o="y", match=match)
        assert spec.subjects.exclude and spec.objects.exclude == ("y",)


def test_errors():
    with pytest.raises(ValueError, match="by: expected"):
        build(by="nothing")
    with pytest.raises(ValueError, match="match: expected"):
        build(o="x", match="loose")
    with pytest.raises(ValueError, match="time range"):
        build(o="x", when="sometime")
    with pytest.raises(ValueError, match="time range"):
        build(o="x", when="between-2024-01-01")
    with pytest.raises(ValueError):
        build().require_bounded()
    with pytest.raises(ValueError):
        build(by="in-webring").require_bounded()
    with pytest.raises(ValueError, match="dangerous"):
        build(o='x"}')
    with pytest.raises(ValueError, match="maximum input count"):
        clean_inputs(["x"] * 51)


def test_rt_only_for_link_types():
    assert build(by="linked", o="x", rt=" a , b").filters.relation_terms == ("a", "b")
    assert build(by="thorped", o="x", rt="a").filters.relation_terms == ()


def test_ranges_and_limits():
    assert parse_range("recent", now_ms=1_209_600_005) == DateRange(after=5)
    assert parse_range("between-1970-01-02-and-1970-01-03") == DateRange(86_400_000, 172_800_000)
    assert parse_range("after-1000") == DateRange(after=1000)
    assert build(o="x", limit="0").filters.limit is None
    assert build(o="x", limit="no-limit").filters.limit is None
    assert build(o="x").filters.limit == 100


def test_inverse_and_titles():
    spec = build("everything", "cited", s="https://a.example", o="b.example", when="after-1970-01-02")
    assert spec.what_by() == ("everything", "cited")
    params = spec.to_params()
    assert params["when"] == "after-1970-01-02" and params["match"] == "fuzzy-o"
    assert spec.meta.title == "Get blobjects cited from https://a.example to b.example"
    assert build(o="x", not_o="y", title="T").meta.title == "T"
    assert params_from_url({"not-s": "q", "feedtitle": "T", "o": ""}) == {"not_s": "q", "title": "T"}


@pytest.mark.parametrize("path,value", [("meta", None), ("subjects", {"mode": "exact"}), ("filters", {})])
def test_saved_spec_is_checked(path, value):
    data = build(o="x").to_dict()
    data[path] = value
    with pytest.raises(ValueError):
        QuerySpec.from_dict(data)


def test_tags_and_urls():
    found = fuzzy_tags("#Two Words")
    assert {"two_words", "Two-Words", "twoWords", "TwoWords", "twowords", "#twowords"} <= set(found)
    assert fuzzy_tags(["", 3]) == []
    assert tidy_url("Example.COM//a//") == "https://example.com/a"
    assert tidy_url("http://example.com:80/") == "http://example.com"
