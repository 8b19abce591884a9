"""Short posts: text within a grapheme limit, with byte-offset facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.tags import is_valid_tag
from linkloom.functions.text import grapheme_count, non_blank, truncate_graphemes

# --- fixed values ----------------------------------------------------------------
POST_GRAPHEMES = 300
TAG_GRAPHEMES = 640
POST_TAGS = 8
POST_TYPE = "app.bsky.feed.post"
LINK_FACET = "app.bsky.richtext.facet#link"
TAG_FACET = "app.bsky.richtext.facet#tag"
# --- end of fixed values ---------------------------------------------------------

_GAP = "\n\n"


def _compose(*parts: Column) -> Column:
    return F.concat_ws(_GAP, *parts)


def _too_long(*parts: Column) -> Column:
    return grapheme_count(_compose(*parts)) > POST_GRAPHEMES


def _room(*others: Column) -> Column:
    return F.lit(POST_GRAPHEMES - len(_GAP)) - grapheme_count(_compose(*others))


def _utf8_at(text: Column, at: Column) -> Column:
    return F.octet_length(F.substring(text, F.lit(1), F.greatest(at - 1, F.lit(0))))


def _facet(start: Column, part: Column, kind: str, uri: Column, tag: Column) -> Column:
    feature = F.struct(F.lit(kind).alias("$type"), uri.alias("uri"), tag.alias("tag"))
    index = F.struct(start.alias("byteStart"), (start + F.octet_length(part)).alias("byteEnd"))
    return F.struct(index.alias("index"), F.array(feature).alias("features"))


def short_posts(items: DataFrame) -> DataFrame:
    """url, title, description, tags, createdAt → post records.

    A long text first loses part of its description, then its tags, then part of its title.
    """
    none = F.lit(None).cast("string")
    title, about, url, tagline = (F.col(c) for c in ("_title", "_about", "url", "_tagline"))
    listed = F.coalesce("tags", F.array().cast("array<string>"))
    valid = F.slice(
        F.filter(listed, lambda t: is_valid_tag(t) & (grapheme_count(t) <= TAG_GRAPHEMES)), 1, POST_TAGS
    )
    hashed = F.array_join(F.transform(F.col("_tags"), lambda t: F.concat(F.lit("#"), t)), " ")
    df = (
        items.withColumn("_tags", valid)
        .withColumn("_title", F.when(F.col("title") != F.col("url"), F.col("title")))
        .withColumn("_about", non_blank("description"))
        .withColumn("_tagline", F.when(F.size("_tags") > 0, hashed))
    )
    room = _room(title, url, tagline)
    cut = F.when(room > 3, truncate_graphemes(about, room))
    df = df.withColumn("_about", F.when(_too_long(title, about, url, tagline), cut).otherwise(about))
    df = df.withColumn("_tagline", F.when(_too_long(title, about, url, tagline), none).otherwise(tagline))
    room = _room(about, url, tagline)
    cut = F.when(room > 1, truncate_graphemes(title, room)).otherwise(title)
    df = df.withColumn("_title", F.when(_too_long(title, about, url, tagline), cut).otherwise(title))
    df = df.withColumn("text", _compose(title, about, url, tagline))

    text = F.col("text")
    at_url = F.position(url, text)
    at_tags = F.position(tagline, text)
    link = F.when(at_url > 0, F.array(_facet(_utf8_at(text, at_url), url, LINK_FACET, url, none)))

    def tag_facet(tag: Column) -> Column:
        mark = F.concat(F.lit("#"), tag)
        at = F.position(mark, text, at_tags)
        return F.when(at > 0, _facet(_utf8_at(text, at), mark, TAG_FACET, none, tag))

    tagged = F.when(tagline.isNotNull(), F.filter(F.transform("_tags", tag_facet), lambda f: f.isNotNull()))
    empty = F.filter(link, lambda f: F.lit(False))
    return df.select(
        F.lit(POST_TYPE).alias("$type"),
        "text",
        "createdAt",
        F.concat(F.coalesce(link, empty), F.coalesce(tagged, empty)).alias("facets"),
        F.when(F.size("_tags") > 0, F.col("_tags")).alias("tags"),
    )
