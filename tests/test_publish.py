import pytest

from linkloom.functions.text import grapheme_count, truncate_graphemes
from linkloom.sinks.projection import load_resolver, project, resolver_error
from linkloom.sinks.records import short_posts
from linkloom.sinks.registry import Publishers

ITEM = "url string, title string, description string, tags array<string>, createdAt string"


def post(spark, *item):
    return short_posts(spark.createDataFrame([item], ITEM)).first()


def test_short_post_with_facets(spark):
    got = post(spark, "https://x.example/é", "Títle", "Words", ["ok", "not ok", "über_1"], "now")
    assert got.text == "Títle\n\nWords\n\nhttps://x.example/é\n\n#ok #über_1"
    assert got.tags == ["ok", "über_1"]
    data = got.text.encode()
    cut = [data[f["index"].byteStart : f["index"].byteEnd].decode() for f in got.facets]
    assert cut == ["https://x.example/é", "#ok", "#über_1"]


def test_long_posts_lose_description_then_tags_then_title(spark):
    n = lambda g: len(g.text)
    long = post(spark, "https://x.example", "T", "d" * 500, ["a"], "now")
    assert n(long) == 300 and "…" in long.text and long.text.endswith("#a")
    tagged = post(spark, "https://x.example", "t" * 270, "d" * 500, ["a" * 30], "now")
    assert "#" not in tagged.text and tagged.text == "t" * 270 + "\n\nhttps://x.example" and len(tagged.facets) == 1
    titled = post(spark, "https://x.example", "t" * 400, None, None, "now")
    assert n(titled) == 300 and titled.tags is None
    same = post(spark, "https://x.example", "https://x.example", None, [], "now")
    assert same.text == "https://x.example"


def test_graphemes(spark):
    family = "👨‍👩‍👧"
    df = spark.createDataFrame([(family + "ab",)], "t string")
    got = df.select(grapheme_count("t").alias("n"), truncate_graphemes("t", 2).alias("c")).first()
    assert (got.n, got.c) == (3, family + "…")


def test_projection_rules(spark):
    df = spark.createDataFrame([("u1", "", 0), ("u2", "t", None)], "id string, title string, date long")
    schema = {
        "title": {"from": ["title", "id"], "required": True},
        "when": {"from": "date", "postProcess": [{"method": "date", "params": "iso8601"}, {"method": "default", "params": "now"}]},
        "gone": {"from": "nowhere.at.all"},
    }
    got = [tuple(r) for r in project(df, schema).collect()]
    # the chain stops at a missing date, so the default never applies
    assert got == [("u1", "1970-01-01T00:00:00.000Z", None), ("t", None, None)]
    schema["when"]["required"] = True
    assert project(df, schema).count() == 1


def test_resolver_checks():
    good = {"@context": "https://c.example/", "@id": "https://i.example/", "schema": {"a": {"from": "b"}}}
    assert resolver_error(good) is None
    assert "@context" in resolver_error({**good, "@context": ""})
    assert "schema" in resolver_error({**good, "schema": None})
    assert "Meta exceeds" in resolver_error({**good, "meta": {"x": "y" * 5000}})
    assert "meta.x" in resolver_error({**good, "meta": {"x": "<b>"}})
    with pytest.raises(ValueError, match="Invalid JSON"):
        load_resolver("{")


def test_publisher_registry(spark):
    known = Publishers("https://lg.example/")
    with pytest.raises(ValueError, match="built-in"):
        known.register("rss", {})
    with pytest.raises(ValueError, match="are needed"):
        known.register("mine", {"schema": {}})
    known.register("mine", {"schema": {"u": {"from": "id"}}, "contentType": "text/plain", "render": lambda d, c: d})
    df = spark.createDataFrame([("u1", "t", 0)], "id string, title string, date long")
    assert known.get("mine").publish(df).first().u == "u1"
    with pytest.raises(ValueError, match="lexicon"):
        known.prepare(df, "mine", "atproto")
    assert known.prepare(df, "siteDocument", "atproto").first().collection == "site.standard.document"
