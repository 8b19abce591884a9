"""RSS: item text as a column, and feeds as ordered text lines."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.dates import format_date, parse_date_ms
from linkloom.functions.text import first_non_blank, non_blank, xml_encode


def _tag(name: str, value: Column, attributes: str = "", encode: bool = True) -> Column:
    body = xml_encode(value) if encode else value
    shown = F.concat(F.lit(f"<{name}{attributes}>"), body, F.lit(f"</{name}>"))
    return F.coalesce(F.when(non_blank(value).isNotNull(), shown), F.lit(""))


def _image(value: Column) -> Column:
    shown = F.concat(F.lit('<enclosure url="'), xml_encode(value), F.lit('" type="image/jpeg" />'))
    return F.coalesce(F.when(non_blank(value).isNotNull(), shown), F.lit(""))


def item_xml(df: DataFrame) -> Column:
    """The <item> of a feed row; tags without a value are left out."""

    def col(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    return F.concat(
        F.lit("<item>"),
        _tag("title", col("title")),
        _tag("description", col("description")),
        _tag("author", col("author")),
        _tag("guid", col("guid"), ' isPermaLink="true"'),
        _tag("pubDate", col("pubDate"), encode=False),
        _tag("link", col("link")),
        _tag("category", col("category"), encode=False),
        _image(col("image")),
        F.lit("</item>"),
    )


def feed_items(df: DataFrame, now_ms: int | None = None) -> DataFrame:
    """Page objects, page rows, term rows or ready items → feed rows.

    Rows whose date cannot be read, or with neither title nor description, are skipped;
    a listing row without a date counts as published now.
    """
    names = df.columns
    now = F.unix_millis(F.current_timestamp()) if now_ms is None else F.lit(now_ms)

    def col(name: str) -> Column:
        return F.col(name).cast("string") if name in names else F.lit(None).cast("string")

    if "guid" in names:  # ready items: the date is epoch ms or text
        when = parse_date_ms(col("pubDate"))
        out = [col(c).alias(c) for c in ("title", "description", "author", "guid", "link", "category", "image")]
    else:
        when = F.coalesce("date", now)
        uri = F.coalesce(col("id"), col("uri"))
        out = [
            first_non_blank(col("title"), col("term"), uri).alias("title"),
            col("description").alias("description"),
            F.lit(None).cast("string").alias("author"),
            first_non_blank(uri, col("term")).alias("guid"),
            uri.alias("link"),
            F.lit(None).cast("string").alias("category"),
            col("image").alias("image"),
        ]
    rows = df.select(*out, when.alias("time"), format_date(when, "rfc822").alias("pubDate"))
    named = first_non_blank("title", "description").isNotNull()
    return rows.filter(F.col("pubDate").isNotNull() & named)


def feed_lines(items: DataFrame, channel: Mapping[str, str | None], built: str = "") -> DataFrame:
    """The feed as one text column in document order: head, items newest first, tail.

    Written with write.text, the parts put one after the other are the document.
    """
    spark = items.sparkSession

    def tag(name: str, value: str | None) -> str:
        if not value:
            return ""
        for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
            value = value.replace(plain, entity)
        return f"<{name}>{value}</{name}>"

    link = channel.get("link")
    own = tag("a", link)[3:-4]
    head = '<rss xmlns:atom="http://www.w3.org/2005/Atom" version="2.0"><channel>'
    head += tag("title", channel.get("title")) + tag("link", link)
    head += f'<atom:link href="{own}" rel="self" type="application/rss+xml" />' if link else ""
    head += tag("description", channel.get("description")) + tag("lastBuildDate", built)
    ends = spark.createDataFrame(
        [(0, head), (2, "</channel></rss>")], "place int, value string"
    ).withColumn("time", F.lit(None).cast("bigint")).withColumn("guid", F.lit(None).cast("string"))
    time = F.col("time") if "time" in items.columns else F.lit(None).cast("bigint")
    body = items.select(
        F.lit(1).alias("place"), item_xml(items).alias("value"), time.alias("time"), F.col("guid").cast("string")
    )
    ordered = ends.unionByName(body).orderBy("place", F.col("time").desc(), "guid")
    return ordered.select("value")


def term_feed_items(uses: DataFrame) -> DataFrame:
    """Term uses (page, term_uri, time) → feed rows."""
    page = F.col("page")
    ready = uses.select(
        page.alias("title"),
        page.alias("guid"),
        page.alias("link"),
        F.col("term_uri").alias("category"),
        F.col("time").alias("pubDate"),
    )
    return feed_items(ready)
