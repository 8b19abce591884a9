"""Projections, feeds and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.functions import xml_sql
from checks.registry import check
from linkloom.operators import terms
from linkloom.operators.page_objects import assemble, get_objects
from linkloom.plans.spec import QuerySpec
from linkloom.sinks import feeds
from linkloom.sinks.projection import project
from linkloom.sinks.results import json_results
from linkloom.sinks.registry import DOCUMENT, RSS_ITEM, SHORT_POST, SITE_DOCUMENT, Publishers
from linkloom.sources.shop_graph import INSTANCE, shop_graph

NOW = 1_700_000_000_000


def page_items(spark, d):
    """Pages as feed rows; the date is the post date."""
    return shop_graph(spark, d).pages.select(
        F.col("uri").alias("id"), "title", "description", "image", F.col("post_date").alias("date")
    )


def brand_objects(spark, d):
    spec = QuerySpec.build("everything", "thorped", instance=INSTANCE, o="Brand12", limit="no-limit")
    return assemble(get_objects(shop_graph(spark, d), spec))


_RFC = "strftime(epoch_ms({}), '%a, %d %b %Y %H:%M:%S GMT')"
_ISO = "strftime(epoch_ms({}), '%Y-%m-%dT%H:%M:%S.%gZ')"


@check(
    "sink_k01_projection",
    f"""SELECT coalesce(description, title) AS label, uri AS link, {_RFC.format('post_date')} AS day, 'x' AS mark
        FROM lg_pages WHERE post_date IS NOT NULL""",
)
def _(spark, d):
    schema = {
        "label": {"from": ["description", "title"]},
        "link": {"from": "id", "required": True},
        "day": {"from": "date", "postProcess": {"method": "date", "params": "rfc822"}, "required": True},
        "mark": {"value": "x"},
    }
    return project(page_items(spark, d), schema)


@check(
    "sink_k03_rss_items",
    f"""SELECT title, uri AS link, uri AS guid, {_RFC.format('post_date')} AS "pubDate", description, image
        FROM lg_pages WHERE post_date IS NOT NULL""",
)
def _(spark, d):
    return project(page_items(spark, d), RSS_ITEM).drop("time")


_ITEM = f"""'<item><title>' || {xml_sql('title')} || '</title>' ||
    coalesce('<description>' || {xml_sql('description')} || '</description>', '') ||
    '<guid isPermaLink="true">' || uri || '</guid><pubDate>' || {{}} || '</pubDate><link>' || uri || '</link></item>'"""


@check(
    "sink_k04_rss_text",
    f"SELECT uri AS guid, {_ITEM.format(_RFC.format('post_date'))} AS value FROM lg_pages WHERE post_date IS NOT NULL",
)
def _(spark, d):
    items = project(page_items(spark, d), RSS_ITEM)
    return items.select("guid", feeds.item_xml(items).alias("value"))


@check(
    "sink_k05_site_rss",
    f"""SELECT uri AS guid, {_ITEM.format(_RFC.format(f'coalesce(post_date, {NOW})'))} AS value FROM lg_pages""",
)
def _(spark, d):
    items = feeds.feed_items(page_items(spark, d), NOW)
    return items.select("guid", feeds.item_xml(items).alias("value"))


_USE = f"""SELECT '<item><title>' || src || '</title><guid isPermaLink="true">' || src || '</guid><pubDate>' ||
    {_RFC.format('ts')} || '</pubDate><link>' || src || '</link><category>' || dst || '</category></item>' AS value
    FROM lg_edges WHERE kind = 'term'"""


@check("sink_k06_usage_feed", _USE)
def _(spark, d):
    items = feeds.term_feed_items(terms.usage_feed(shop_graph(spark, d)))
    return items.select(feeds.item_xml(items).alias("value"))


@check("sink_k06_feed_of_one_term", _USE + " AND dst = 'https://lg.example/~/Brand12'")
def _(spark, d):
    items = feeds.term_feed_items(terms.usage_feed(shop_graph(spark, d), "Brand12"))
    return items.select(feeds.item_xml(items).alias("value"))


_TAGS = """(SELECT id, string_agg(target, ',' ORDER BY target) AS tags FROM object_rows
           WHERE kind = 'tag' GROUP BY id)"""
_BRAND_HEADS = f"""linked_heads h LEFT JOIN {_TAGS} t USING (id) WHERE id IN
    (SELECT src FROM lg_edges WHERE dst = 'https://lg.example/~/Brand12')"""


@check(
    "sink_k07_document_records",
    f"""SELECT id AS site, CAST(NULL AS VARCHAR) AS path, title, description, CAST(NULL AS VARCHAR) AS "textContent",
        tags, {_ISO.format('date')} AS "publishedAt" FROM {_BRAND_HEADS}""",
)
def _(spark, d):
    return project(brand_objects(spark, d), DOCUMENT).withColumn("tags", F.array_join("tags", ","))


@check(
    "sink_k08_site_document_records",
    f"""SELECT id AS url, title, {_ISO.format('date')} AS "publishedAt", description, tags, image FROM {_BRAND_HEADS}""",
)
def _(spark, d):
    return project(brand_objects(spark, d), SITE_DOCUMENT).withColumn("tags", F.array_join("tags", ","))


@check(
    "sink_k09_short_posts",
    f"""SELECT concat_ws(chr(10) || chr(10), title, description, id, '#' || replace(tags, ',', ' #')) AS text, tags,
        octet_length(encode(concat_ws(chr(10) || chr(10), title, description))) + 2 AS link_at
        FROM (SELECT * REPLACE (array_to_string(string_split(tags, ',')[:8], ',') AS tags) FROM {_BRAND_HEADS})""",
)
def _(spark, d):
    posts = Publishers(INSTANCE).get("bluesky").publish(brand_objects(spark, d))
    return posts.select(
        "text", F.array_join("tags", ",").alias("tags"), F.col("facets")[0]["index"]["byteStart"].alias("link_at")
    )


@check(
    "sink_k10_prepared_records",
    """SELECT collection, 'application/json' AS content_type, count(*) AS n
       FROM (SELECT 'site.standard.document' AS collection FROM lg_pages WHERE post_date IS NOT NULL) GROUP BY ALL""",
)
def _(spark, d):
    found = Publishers(INSTANCE).prepare(
        page_items(spark, d).withColumn("tags", F.lit(None).cast("array<string>")), "siteDocument", "atproto"
    )
    return found.groupBy("collection", "content_type").agg(F.count("*").alias("n"))


@check(
    "sink_k11_json_results",
    """SELECT CAST(to_json({'uri': uri, 'description': description}) AS VARCHAR) AS value, false AS opens FROM lg_pages
       WHERE uri <> (SELECT min(uri) FROM lg_pages)
       UNION ALL SELECT CAST(to_json({'uri': uri, 'description': description}) AS VARCHAR), true FROM lg_pages
       WHERE uri = (SELECT min(uri) FROM lg_pages)
       UNION ALL SELECT ']}', false""",
)
def _(spark, d):
    """Each line of the document without the bracket or comma before it."""
    lines = json_results(shop_graph(spark, d).pages.select("uri", "description"), F.col("uri"))
    mark = r'^(\{"results":\[|,)'
    return lines.select(F.regexp_replace("value", mark, "").alias("value"), F.startswith("value", F.lit('{"results"')).alias("opens"))


@check(
    "sink_k12_published_query",
    f"""SELECT count(*) AS lines, sum(CAST(starts_with(value, '<item>') AS INT)) AS items FROM (
        SELECT {_ITEM.format(_RFC.format('ts'))} AS value FROM (
          SELECT DISTINCT uri, title, description, ts FROM lg_edges JOIN lg_pages ON src = uri
          WHERE dst = 'https://lg.example/~/Brand12')
        UNION ALL SELECT 'head' UNION ALL SELECT 'tail')""",
)
def _(spark, d):
    from linkloom.client import LinkGraph

    lines = LinkGraph(shop_graph(spark, d)).get("pages", "thorped", o="Brand12", limit="no-limit", as_="rss")
    return lines.agg(
        F.count("*").alias("lines"), F.sum(F.startswith("value", F.lit("<item>")).cast("int")).alias("items")
    )
