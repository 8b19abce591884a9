import time

import pytest

from linkloom import vocabulary as V
from linkloom.operators.page_objects import assemble  # noqa: F401  (import check)
from linkloom.sources import html
from linkloom.sources.handlers import Handlers
from linkloom.sources.json_docs import harvest_json
from linkloom.sources.lint import lint
from linkloom.sources.rules import RuleSets, merge, rule
from linkloom.sources.selectors import PageReader, RuleIndex, parse_selector

INSTANCE = "https://lg.example/"
PAGE = f"""<html><head><title>Hi &amp; bye</title><meta property="og:image" content="">
<link rel="{V.REL_IMAGE}" href="https://x.example/i.png/"><meta name="octo-policy" content="index">
<meta name="keywords" content="one, two,,three"><link rel="{V.REL_TERM}" href="{INSTANCE}~/linked">
<link rel="canonical" href="https://x.example/c"><time datetime="2024-05-01">May</time></head>
<body><!-- <{V.TERM_ELEMENT}>no</{V.TERM_ELEMENT}> --><script>var a = "<{V.TERM_ELEMENT}>no</{V.TERM_ELEMENT}>"</script>
<article><{V.TERM_ELEMENT}>Cats</{V.TERM_ELEMENT}><p><b>un<br>closed
<a rel="nofollow {V.REL_TERM}" href="{INSTANCE}~/dogs">d</a>
<a rel="{V.REL_TERM}" href="https://y.example/p/">y</a>
<a rel="{V.REL_BOOKMARK}" href="https://z.example/" {V.ATTR_TERMS}=" a, ,b ">z</a>
<a rel="{V.REL_CITE}">no address</a><img {V.ATTR_IMAGE}>
<a class="x gh-article-tag y" href="/t">Tag</a></article></body></html>"""


def harvest(spark, schema, page=PAGE):
    df = spark.createDataFrame([("https://x.example/p", page)], "url string, html string")
    return html.harvest_html(df, schema).first()


def test_default_rules(spark):
    got = harvest(spark, RuleSets(INSTANCE).schema())
    assert got.id == "https://x.example/p" and got.title == "Hi & bye"
    # first non-empty fallback; an element lacking the attribute is skipped
    assert got.image == "https://x.example/i.png" and got.postDate == "2024-05-01"
    assert got.indexPolicy == "index"
    assert got.tags == ["Cats", "dogs", "linked"]
    links = [(x.type, x.uri, x.terms) for x in got.links]
    assert links == [("link", "https://y.example/p", None), ("bookmark", "https://z.example", ["a", "b"])]


def test_other_rule_sets(spark):
    sets = RuleSets(INSTANCE)
    assert harvest(spark, sets.schema("keywords")).tags == ["one", "two", "three"]
    assert harvest(spark, sets.schema("ghost")).tags == ["Tag"]
    record = harvest(spark, sets.schema("standardSite")).document_record
    assert record["site"] == ["https://x.example/c"] and "closed" in record["textContent"][0]
    assert "var a" not in record["textContent"][-1]


@pytest.mark.parametrize(
    "selector,found",
    [("div p", ["1", "2"]), ("div > p", ["1"]), ("p.k", ["2"]), ("p:not([id])", ["2", "3"]), ("[id^='a']", ["1"]),
     ("p[id$=b], span", ["s"]), ("*[title]", []), ("section div p", [])],
)
def test_selectors(spark, selector, found):
    page = '<div><p id="ab1">1</p><ul><li><p class="j k">2</p></li></ul></div><p>3</p><span>s</span>'
    hits = html.read_pages(
        spark.createDataFrame([("u", page)], "url string, html string"), [rule(selector)]
    ).first().hits
    assert [h.value for h in hits] == found


def test_nested_fields_and_filters(spark):
    schema = {
        "subject": {"s": "source", "meta.kind": [rule("h1", postProcess={"method": "substring", "params": [0, 2]})]},
        "link": {"s": "source", "o": [rule("a", "href", filterResults={"method": "startsWith", "params": "https"})]},
    }
    got = harvest(spark, schema, "<h1>Heading</h1><a href='https://q.example//'>x</a><a href='/r'>y</a>")
    assert got.meta.kind == "He" and [x.uri for x in got.links] == ["https://q.example"]


def test_registries():
    sets = RuleSets(INSTANCE)
    assert merge({"a": 1, "b": 2}, {"a": {}, "b": 3}) == {"a": 1, "b": 3}
    with pytest.raises(ValueError, match="is known"):
        sets.register("default", {"mode": "html"})
    with pytest.raises(ValueError, match="mode"):
        sets.register("mine", {})
    sets.register("mine", {"mode": "json", "schema": {}})
    assert sets.for_mode("json") == ["mine"]
    with pytest.raises(KeyError):
        sets.get("nope")
    handlers = Handlers()
    with pytest.raises(ValueError, match="built-in"):
        handlers.register("html", ["x/y"], lambda d, r: d)
    handlers.register("csv", ["text/csv"], lambda d, r: d)
    assert handlers.list() == ["html", "json", "csv"]


def test_json_fallbacks(spark):
    body = '{"a": {"b": ["x", "y"]}, "n": 3, "none": null}'
    df = spark.createDataFrame([("u", body), ("v", "not json")], "url string, body string")
    schema = {"subject": {"s": "missing", "title": ["none", "n"], "list": "a.b"}, "link": "a.b"}
    got = {r.url: r for r in harvest_json(df, schema).collect()}
    assert got["u"].title == "3" and got["u"].list == "x, y" and got["u"].id == "source"
    assert [x.uri for x in got["u"].links] == ["x", "y"]
    assert got["v"].title is None and got["v"].links == []


def test_lint(spark):
    sets = {
        "ok": '{"title": "t", "schema": {"hashtag": {"o": ["source", {"selector": "a b"}]}}}',
        "selector too deep": '{"title": "t", "schema": {"x": {"o": [{"selector": "a b c d e f g h i j k l m"}]}}}',
        "regex has nested quantifiers": '{"title": "t", "schema": {"x": {"o": [{"selector": "a", "postProcess": {"method": "regex", "params": "(a+)+(b*)*"}}]}}}',
        "no schema": '{"title": "t"}',
    }
    df = spark.createDataFrame(list(sets.items()), "name string, rule_set string")
    for r in lint(df).collect():
        assert r.reason == (None if r.name == "ok" else r.name)


def texts(html, *selectors):
    index = RuleIndex([(parse_selector(s), "textContent", None) for s in selectors])
    return [h[2] for h in PageReader(index).read(html)]


@pytest.mark.parametrize("html, selectors, want", [
    ("<ul><li class=a>one<li class=b>two</ul>end", ["li.a", "li.b"], ["one", "two"]),
    ("<p class=x>first<p class=y>second<div>third</div>", ["p.x", "p.y"], ["first", "second"]),
    ("<table><tr><td>1<td>2<tr><td>3</table>x", ["td", "tbody > tr"], ["12", "1", "2", "3", "3"]),
    ("<ul><li>a<ul><li>b</ul>c<li>d</ul>", ["ul > li", "li li"], ["abc", "b", "b", "d"]),
    ("<dl><dt>a<dd>b<dt>c</dl>", ["dt", "dd"], ["a", "b", "c"]),
    ("<select><option>1<option>2</select>", ["option"], ["1", "2"]),
    ("<b><p>x</b>y</p>z", ["b", "p"], ["x", "xy"]),
    ("<table><tr><td></div>q</td></table></div>", ["td"], ["q"]),
    ("<div/>in", ["div"], ["in"]),
    ("<a href=1>one<a href=2>two", ["a"], ["one", "two"]),
])
def test_end_tags_may_be_left_out(html, selectors, want):
    assert texts(html, *selectors) == want


def test_long_unclosed_lists_take_linear_time():
    begin = time.perf_counter()
    found = texts("<nav><ul>" + "<li><a href=/x>i" * 20_000, "nav a", "nav > ul > li a", "li")
    assert len(found) == 60_000 and time.perf_counter() - begin < 10
