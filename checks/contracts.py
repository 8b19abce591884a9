"""Parts a user plugs in or builds on the driver, each applied to whole tables."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import functions as F

from checks.harvest import _TITLE, _filled, pages, shown
from checks.ingest import NOW, harvested
from checks.registry import check
from linkloom.client import LinkGraph
from linkloom.functions.dates import ms, parse_range
from linkloom.functions.safety import clean_inputs
from linkloom.operators.store import GraphStore
from linkloom.plans.saved import with_options
from linkloom.plans.spec import QuerySpec, spec_error
from linkloom.session import shared_dir
from linkloom.sinks.projection import load_resolver, project
from linkloom.sinks.registry import Publishers
from linkloom.sources import html
from linkloom.sources.handlers import Handlers
from linkloom.sources.rules import RuleSets, rule
from linkloom.sources.shop_graph import INSTANCE, read, requests, shop_graph
from linkloom.streaming import admission

_BRAND_PAGES = "SELECT DISTINCT src FROM lg_edges WHERE dst = 'https://lg.example/~/Brand12'"


def brand_spec(**options):
    return QuerySpec.build("pages", "thorped", instance=INSTANCE, o="Brand12", limit="no-limit", **options)


def page_ids(rows):
    return rows.filter("role = 'subject'").select(F.col("uri").alias("src")) if "role" in rows.columns else rows


# --- rule sets and handlers ----------------------------------------------------------


def _own_rules():
    sets = RuleSets(INSTANCE)
    tags = {"s": "source", "o": [rule("a.gh-article-tag")]}
    sets.register("own", {"mode": "html", "schema": {"hashtag": tags, "link": {}}})
    return sets


@check(
    "harvest_h07_merged_rule_set",
    f"""SELECT url AS id, {_TITLE} AS title, 'g' || page_id AS tags, 'link,cite' AS links FROM pages""",
)
def _(spark, d):
    """Own tags in place of the default ones; an empty section keeps the default's."""
    found = html.harvest_html(_filled(pages(spark, d)), _own_rules().schema("own"))
    kinds = F.transform("links", lambda x: x["type"])
    return found.select("id", "title", F.array_join("tags", ",").alias("tags"), F.array_join(kinds, ",").alias("links"))


@check("rules_x01_registered", "SELECT url AS id, 'g' || page_id AS tag FROM pages")
def _(spark, d):
    sets = _own_rules()
    found = html.harvest_html(_filled(pages(spark, d)), sets.get("own")["schema"])
    return found.select("id", F.explode("tags").alias("tag"))


@check(
    "harvest_h08_dotted_fields",
    f"""SELECT url, {_TITLE} AS title, {shown("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")} AS heading FROM pages""",
)
def _(spark, d):
    schema = {"subject": {"s": "source", "page.title": [rule("title")], "page.head.first": [rule("article h1")]}}
    found = html.harvest_html(pages(spark, d), schema)
    return found.select("url", F.col("page.title").alias("title"), F.rtrim("page.head.first", F.lit("/")).alias("heading"))


@check(
    "harvest_h16_rule_set_registry",
    """SELECT name, count(*) AS n FROM pages,
       (VALUES ('default'), ('openGraph'), ('keywords'), ('ghost'), ('standardSite')) v(name) GROUP BY name""",
)
def _(spark, d):
    sets, parts = RuleSets(INSTANCE), []
    for name in sets.for_mode("html"):
        found = html.harvest_html(_filled(pages(spark, d)), sets.schema(name))
        parts.append(found.filter("title IS NOT NULL").select(F.lit(name).alias("name")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("name").agg(F.count("*").alias("n"))


@check(
    "handler_x02_registered",
    "SELECT 'https://doc.example/' || doc_id AS url, upper(lang) AS title FROM documents",
)
def _(spark, d):
    handlers = Handlers()
    handlers.register("plain", ["text/plain"], lambda docs, rules: docs.select("url", F.upper(rules["take"]).alias("title")))
    docs = read(spark, d, "documents").select(
        F.concat(F.lit("https://doc.example/"), F.col("doc_id").cast("string")).alias("url"),
        F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("lang").alias("body"),
    )
    return handlers.harvest(docs, {"plain": {"take": "body"}})


# --- query specs -----------------------------------------------------------------------


@check(
    "fn_f10_date_ranges",
    """SELECT o_orderpriority, count(*) FILTER (WHERE epoch_ms(o_orderdate) BETWEEN 788918400000 AND 851990400000) AS inside,
       count(*) FILTER (WHERE epoch_ms(o_orderdate) >= 788918400000) AS later,
       count(*) FILTER (WHERE epoch_ms(o_orderdate) <= 851990400000) AS earlier FROM orders GROUP BY o_orderpriority""",
)
def _(spark, d):
    at = ms("o_orderdate")
    texts = {"inside": "between-1995-01-01-and-1996-12-31", "later": "after-1995-01-01", "earlier": "before-851990400000"}
    return read(spark, d, "orders").groupBy("o_orderpriority").agg(
        *[F.count_if(parse_range(text).holds(at)).alias(name) for name, text in texts.items()]
    )


@check(
    "fn_f12_clean_inputs",
    "SELECT uri, title FROM lg_pages WHERE uri IN ('https://ring.example/n/3', 'https://ring.example/n/4')",
)
def _(spark, d):
    wanted = clean_inputs(["https://ring.example/n/3/", "https://ring.example/n/4"], exact=True)
    return shop_graph(spark, d).pages.filter(F.col("uri").isin(*wanted)).select("uri", "title")


@check("fn_f29_query_title", f"SELECT src, 'Get links thorped to Brand12' AS query FROM ({_BRAND_PAGES})")
def _(spark, d):
    graph, spec = LinkGraph(shop_graph(spark, d)), brand_spec()
    return page_ids(graph.run(spec)).distinct().select("src", F.lit(spec.meta.title).alias("query"))


@check("pred_p25_bounded_query", f"SELECT src, true AS refused FROM ({_BRAND_PAGES})")
def _(spark, d):
    """A query without subjects and objects is refused, the same one with an object runs."""
    graph, refused = shop_graph(spark, d), False
    try:
        LinkGraph(graph).get("pages", "thorped", limit="no-limit")
    except ValueError:
        refused = True
    return page_ids(LinkGraph(graph).run(brand_spec())).distinct().select("src", F.lit(refused).alias("refused"))


@check("spec_build", f"SELECT src, 'termsOnly' AS kind, 'exact' AS mode FROM ({_BRAND_PAGES})")
def _(spark, d):
    saved = brand_spec().to_json()
    built = json.loads(saved)["objects"]
    rows = page_ids(LinkGraph(shop_graph(spark, d)).run(saved)).distinct()
    return rows.select("src", F.lit(built["type"]).alias("kind"), F.lit(built["mode"]).alias("mode"))


@check("spec_validation", f"SELECT src, true AS good, true AS bad FROM ({_BRAND_PAGES})")
def _(spark, d):
    saved = brand_spec().to_dict()
    broken = {**saved, "subjects": {**saved["subjects"], "include": "not a list"}}
    bad = (spec_error(broken) or "").startswith("subjects.include")
    rows = page_ids(LinkGraph(shop_graph(spark, d)).run(saved)).distinct()
    return rows.select("src", F.lit(spec_error(saved) is None).alias("good"), F.lit(bad).alias("bad"))


@check("spec_inverse", f"SELECT src, true AS same FROM ({_BRAND_PAGES})")
def _(spark, d):
    """Spec → options → spec gives the same query."""
    spec = brand_spec()
    what, by = spec.what_by()
    options = {k: v for k, v in spec.to_params().items() if k not in ("server", "subtype") and v != ""}
    again = QuerySpec.build(what, by, instance=INSTANCE, **options)
    rows = page_ids(LinkGraph(shop_graph(spark, d)).run(again)).distinct()
    return rows.select("src", F.lit(again == spec).alias("same"))


@check("get_g05_debug", f"SELECT src, true AS explained FROM ({_BRAND_PAGES})")
def _(spark, d):
    found = LinkGraph(shop_graph(spark, d)).get("pages", "thorped", o="Brand12", limit="no-limit", as_="debug")
    explained = "Scan" in found["query"] and found["spec"]["objects"]["include"] == ["Brand12"]
    return page_ids(found["results"]).distinct().select("src", F.lit(explained).alias("explained"))


def _part_spec(key: int, brand: str, kind: str, day: str) -> str:
    """The spec that a part saves: by its brand, exact, with relationship terms, or broken."""
    site = f"https://s{key}.example"
    asked = (
        ("thorped", {"o": brand, "created": f"after-{day}"}),
        ("linked", {"s": site, "o": kind, "match": "exact"}),
        ("cited", {"s": site, "rt": kind, "indexed": f"before-{day}"}),
        ("posted", {"s": site, "when": f"between-{day}-and-2024-01-01", "limit": str(key % 7 + 1)}),
    )
    by, options = asked[key % 5 % 4]
    saved = QuerySpec.build("pages", by, instance=INSTANCE, **options).to_dict()
    return json.dumps({**saved, "subjects": {**saved["subjects"], "include": site}} if key % 5 == 4 else saved)


_PART_SPECS = """SELECT p_partkey, p_partkey % 5 AS k, replace(p_brand, '#', '') AS brand, lower(p_type) AS kind,
    'https://s' || p_partkey || '.example' AS site, CAST(DATE '2001-01-01' + CAST(p_partkey % 300 AS INTEGER) AS VARCHAR) AS day FROM part"""


@check(
    "spec_table",
    f"""SELECT p_partkey, CASE WHEN k = 4 THEN 'subjects.include: expected a list' END AS error,
        CASE k WHEN 0 THEN 'Get links thorped to ' || brand WHEN 1 THEN 'Get links linked from ' || site || ' to ' || kind
          WHEN 2 THEN 'Get links cited from ' || site WHEN 3 THEN 'Get links posted from ' || site END AS title,
        CASE k WHEN 0 THEN 'thorped' WHEN 1 THEN 'linked' WHEN 2 THEN 'cited' WHEN 3 THEN 'posted' END AS asked_by,
        CASE WHEN k IN (1, 2, 3) THEN site END AS s, CASE k WHEN 0 THEN brand WHEN 1 THEN kind END AS o,
        CASE k WHEN 1 THEN 'exact' END AS how, CASE k WHEN 2 THEN kind END AS rt,
        CASE k WHEN 0 THEN 'after-' || day END AS created, CASE k WHEN 2 THEN 'before-' || day END AS indexed,
        CASE k WHEN 3 THEN 'between-' || day || '-and-2024-01-01' END AS posted,
        CASE WHEN k = 3 THEN CAST(p_partkey % 7 + 1 AS VARCHAR) WHEN k < 3 THEN '100' END AS row_limit FROM ({_PART_SPECS})""",
)
def _(spark, d):
    """One saved spec per part, checked and turned back into its options, field by field."""

    @F.pandas_udf("string")
    def save(key: pd.Series, brand: pd.Series, kind: pd.Series, day: pd.Series) -> pd.Series:
        return pd.Series([_part_spec(*row) for row in zip(key, brand, kind, day)], dtype=object)

    day = F.date_add(F.lit("2001-01-01").cast("date"), (F.col("p_partkey") % 300).cast("int")).cast("string")
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    saved = read(spark, d, "part").select("p_partkey", save("p_partkey", brand, F.lower("p_type"), day).alias("spec"))
    names = {"s": "s", "o": "o", "how": "match", "rt": "rt", "created": "created", "indexed": "indexed", "posted": "when", "row_limit": "limit"}
    options = [F.col("asked.options")[theirs].alias(ours) for ours, theirs in names.items()]
    return with_options(saved).select("p_partkey", "asked.error", "asked.title", F.col("asked.by").alias("asked_by"), *options)


# --- publishers and clients --------------------------------------------------------------

_CARD = {"label": {"from": ["title", "uri"], "required": True}, "link": {"from": "uri", "required": True}}
_CARDS = "SELECT title AS label, uri AS link FROM lg_pages"


def _with_cards():
    publishers = Publishers(INSTANCE)
    publishers.register("cards", {"schema": _CARD, "contentType": "application/json", "render": lambda items, _: items})
    return publishers


@check("sink_x03_registered_publisher", _CARDS)
def _(spark, d):
    return _with_cards().get("cards").publish(shop_graph(spark, d).pages)


@check("client_x05_own_parts", _CARDS)
def _(spark, d):
    graph = shop_graph(spark, d)
    client = LinkGraph(graph, rules=_own_rules(), handlers=Handlers(), publishers=_with_cards())
    return client.publish(graph.pages, "cards")


@check("sink_k02_resolver", _CARDS)
def _(spark, d):
    resolver = {"@context": "https://lg.example/context", "@id": "https://lg.example/cards", "schema": _CARD}
    return project(shop_graph(spark, d).pages, load_resolver(json.dumps(resolver))["schema"])


# --- requests and ingest -------------------------------------------------------------------


def _failed(name, policy, asked, reason, sql):
    @check(name, f"SELECT request_id, {sql} AS refused FROM lg_requests")
    def _(spark, d):
        rows = requests(spark, d)
        rows = rows if asked else rows.withColumn("requesting_origin", F.lit(None).cast("string"))
        found = admission.admit(rows, shop_graph(spark, d), policy)
        return found.select("request_id", F.coalesce(F.col("failed") == reason, F.lit(False)).alias("refused"))


_failed("stream_x04_pull_policy", "pull", False, "policy", "NOT opted_in")
_failed("stream_x04_active_policy", "active", True, "origin", "request_id % 11 = 0")


@check(
    "stream_t07_two_batches",
    """SELECT DISTINCT 'https://c' || o_custkey || '.example/o/' || o_orderkey AS src,
         'https://new.example/' || (l_partkey % 500) AS dst, true AS replay_ignored
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def _(spark, d):
    """Two batches that overlap and a replay keep each link once."""
    store = GraphStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", INSTANCE)
    rows = harvested(spark, d)
    store.ingest(0, rows.filter("title <> '  title P'"), NOW)
    store.ingest(1, rows, NOW + 1)
    ignored = not store.ingest(1, rows, NOW + 2)
    return store.graph().edges.filter("kind = 'page'").select("src", "dst", F.lit(ignored).alias("replay_ignored"))
