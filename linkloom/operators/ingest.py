"""Harvested rows → new graph rows. Everything is set based and safe to replay.

A harvested frame has: id, tags ARRAY<STRING>, links ARRAY<STRUCT<type, uri, terms>>
and, when known, type, title, description, image, postDate.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.dates import parse_date_ms
from linkloom.functions.tags import subtype, term_uri
from linkloom.functions.urls import deslash, origin
from linkloom.graph import KEYS, Graph
from linkloom.operators.rings import ring_side_handshakes
from linkloom.session import write_once

TEXT_FIELDS = ("title", "description", "image")


def present(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def new_rows(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet."""
    return rows.join(known.select(*keys), keys, "left_anti")


def existing(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is stored; one answer is ``not existing(...).isEmpty()``."""
    return df.join(known.select(*keys), keys, "left_semi")


def annotation_rows(harvested: DataFrame) -> DataFrame:
    """One row per annotation: src, kind (tag, endorse, mention), type, dst, terms, pos."""
    typed = "array<struct<type:string,uri:string,terms:array<string>>>"
    tags = F.transform(
        F.coalesce("tags", F.array().cast("array<string>")),
        lambda t: F.struct(F.lit("hashtag").alias("type"), t.alias("uri"), F.lit(None).cast("array<string>").alias("terms")),
    ).cast(typed)
    links = F.coalesce("links", F.array().cast(typed)).cast(typed)
    rows = harvested.select("id", F.posexplode(F.concat(tags, links)).alias("pos", "a"))
    kind = F.when(F.col("a.type") == "hashtag", "tag").when(F.col("a.type") == "endorse", "endorse")
    return rows.filter(F.coalesce("a.uri", F.lit("")) != "").select(
        F.col("id").alias("src"),
        F.coalesce(kind, F.lit("mention")).alias("kind"),
        F.col("a.type").alias("type"),
        F.when(F.col("a.type") == "hashtag", F.col("a.uri")).otherwise(deslash("a.uri")).alias("dst"),
        F.col("a.terms").alias("terms"),
        "pos",
    )


def exact_annotations(annotations: DataFrame) -> DataFrame:
    """Exact duplicates on a page removed; the first place is kept."""
    first = F.min_by(F.struct("terms", "pos"), "pos")
    kept = annotations.groupBy("src", "kind", "type", "dst").agg(first.alias("first"))
    return kept.select("src", "kind", "type", "dst", "first.terms", "first.pos")


def mentions(annotations: DataFrame) -> DataFrame:
    """One row per (page, target): first subtype, union of the terms of all repeats."""
    found = annotations.filter("kind = 'mention'").select(
        deslash("src").alias("src"),
        "dst",
        "pos",
        F.coalesce(subtype("type"), F.lit("Backlink")).alias("subtype"),
        F.explode_outer("terms").alias("term"),
    )
    return found.groupBy("src", "dst").agg(
        F.min_by("subtype", "pos").alias("subtype"),
        F.array_sort(F.collect_set(F.when(F.col("term") != "", F.col("term")))).alias("terms"),
    )


def tag_edges(annotations: DataFrame, instance: str, now: Column) -> DataFrame:
    tags = annotations.filter("kind = 'tag'").select("src", term_uri("dst", instance).alias("dst")).distinct()
    return tags.select("src", "dst", F.lit("term").alias("kind"), now.alias("ts"))


def harvested_edges(annotations: DataFrame, instance: str, now: Column) -> DataFrame:
    """The tag edges and the page edges of the mentions, found in one pass over the annotations."""
    tag = F.col("kind") == "tag"
    ends = annotations.filter("kind IN ('tag', 'mention')").select(
        F.when(tag, F.col("src")).otherwise(deslash("src")).alias("src"),
        F.when(tag, term_uri("dst", instance)).otherwise(F.col("dst")).alias("dst"),
        F.when(tag, "term").otherwise("page").alias("kind"),
    )
    return ends.distinct().select("src", "dst", "kind", now.alias("ts"))


def page_origins(sources: DataFrame) -> DataFrame:
    """(origin, page) of every different ``src`` that has an origin.

    The origin is exploded from an array of one: a filter of a plain column is pushed down, below the
    grouping, where Spark computes the origin several times for each annotation.
    """
    pages = sources.distinct().select(F.explode(F.array(origin("src"))).alias("origin"), F.col("src").alias("page"))
    return pages.filter("origin IS NOT NULL")


def property_rows(harvested: DataFrame, now: Column) -> DataFrame:
    """Scalars of each harvested page: trimmed, blank ignored, bad dates ignored."""

    def text(name: str) -> Column:
        value = F.trim(present(harvested, name))
        return F.when(value != "", value)

    return harvested.select(
        F.col("id").alias("uri"),
        now.alias("created"),
        now.alias("indexed"),
        parse_date_ms(present(harvested, "postDate")).alias("post_date"),
        *[text(n).alias(n) for n in TEXT_FIELDS],
        F.lit(True).alias("self_indexed"),
        now.alias("ts"),
    )


def latest_pages(log: DataFrame) -> DataFrame:
    """Page log → one row per page; the newest non-null value of a field wins."""

    def newest(name: str) -> Column:
        seen = F.when(F.col(name).isNotNull(), F.struct("ts", F.col(name).cast("string")))
        return F.max_by(name, seen).alias(name)

    return log.groupBy("uri").agg(
        F.min("created").alias("created"),
        F.max("indexed").alias("indexed"),
        newest("post_date"),
        *[newest(n) for n in TEXT_FIELDS],
        F.max("self_indexed").alias("self_indexed"),
    )


@dataclass(frozen=True)
class Harvest:
    """A harvested frame with its mentions, which six of the tables are made of, and how to keep what several read."""

    pages: DataFrame
    pairs: DataFrame
    keep: Callable[[str, DataFrame], DataFrame]


def found_once(harvested: DataFrame, keep: Callable[[str, DataFrame], DataFrame] | None = None) -> Harvest:
    """For a batch all of whose tables are written: mentions and the rows that other tables follow from are found once."""
    keep = keep or (lambda _, rows: write_once(rows))
    return Harvest(harvested, keep("pairs", mentions(annotation_rows(harvested))), keep)


def ingest(graph: Graph, harvested: DataFrame | Harvest, now_ms: int) -> dict[str, DataFrame]:
    """The rows each table gains from a harvested batch.

    ``pages`` rows are a log (with ``ts``) to be read through latest_pages; every other
    table gains only rows whose key it lacks, so a replay gains nothing.
    """
    now = F.lit(now_ms).cast("bigint")
    instance = graph.instance
    pairs = None

    def kept(name: str, found: DataFrame) -> DataFrame:
        return found

    if isinstance(harvested, Harvest):
        harvested, pairs, kept = harvested.pages, harvested.pairs, harvested.keep
    rows = annotation_rows(harvested)
    if pairs is None:
        pairs = mentions(rows)
        found = harvested_edges(rows, instance, now)
    else:
        page_edges = pairs.select("src", "dst", F.lit("page").alias("kind"), now.alias("ts"))
        found = tag_edges(rows, instance, now).unionByName(page_edges)
    no_text, no_date = F.lit(None).cast("string"), F.lit(None).cast("bigint")

    edges = kept("edges", new_rows(found, graph.edges, KEYS["edges"]))
    relations = kept("relations", new_rows(
        pairs.select("src", "dst", "subtype", "terms", now.alias("created")), graph.relations, KEYS["relations"]
    ))

    tagged = edges.filter("kind = 'term'").select("dst")
    related = relations.select(F.explode("terms").alias("term")).select(term_uri("term", instance).alias("dst"))
    used = tagged.unionByName(related).select(F.col("dst").alias("term_uri"), now.alias("used"))
    named = rows.filter("kind = 'tag'").select(F.col("dst").alias("term"))
    named = named.unionByName(pairs.select(F.explode("terms").alias("term"))).distinct()
    terms = new_rows(
        named.select(term_uri("term", instance).alias("term_uri"), "term", now.alias("created")),
        graph.terms,
        KEYS["terms"],
    )

    targets = pairs.select(F.col("dst").alias("uri")).distinct().select(
        "uri", now.alias("created"), no_date.alias("indexed"), no_date.alias("post_date"),
        *[no_text.alias(n) for n in TEXT_FIELDS], F.lit(False).alias("self_indexed"), now.alias("ts"),
    )
    pages = property_rows(harvested, now).unionByName(new_rows(targets, graph.pages, KEYS["pages"]))

    origin_pages = kept(
        "origin_pages", new_rows(page_origins(edges.select("src")), graph.origin_pages, KEYS["origin_pages"])
    )
    origins = new_rows(
        origin_pages.select("origin").distinct().select(
            "origin", F.lit(True).alias("verified"), F.lit(False).alias("banned")
        ),
        graph.origins,
        KEYS["origins"],
    )

    declared = harvested.filter(present(harvested, "type") == "Webring").select(F.col("id").alias("ring")).distinct()
    rings = new_rows(declared.select("ring", now.alias("created")), graph.rings, KEYS["rings"])
    all_edges = graph.edges.select("src", "dst").unionByName(edges.select("src", "dst"))
    all_rings = graph.rings.select("ring").unionByName(rings.select("ring"))
    joined = ring_joins(edges, all_edges, all_rings, graph.ring_members)

    endorsements = new_rows(
        rows.filter("kind = 'endorse'")
        .select(origin("src").alias("src_origin"), origin("dst").alias("dst_origin"))
        .filter("src_origin IS NOT NULL AND dst_origin IS NOT NULL")
        .distinct(),
        graph.endorsements,
        KEYS["endorsements"],
    )
    return {
        "pages": pages,
        "terms": terms,
        "term_usage": used,
        "edges": edges,
        "relations": relations,
        "origins": origins,
        "origin_pages": origin_pages,
        "rings": rings,
        "ring_members": joined,
        "endorsements": endorsements,
    }


def ring_joins(fresh: DataFrame, edges: DataFrame, rings: DataFrame, members: DataFrame) -> DataFrame:
    """Memberships a batch completes: its links into rings, or its rings' links out."""
    member_side = ring_side_handshakes(fresh, edges, rings, members)
    ring_side = ring_side_handshakes(edges, fresh, rings, members)
    return member_side.unionByName(ring_side).distinct()


def apply(graph: Graph, gained: dict[str, DataFrame]) -> Graph:
    """The graph with the gained rows, as a view."""
    tables = {n: graph.table(n).unionByName(df) for n, df in gained.items() if n != "pages"}
    old = graph.pages.withColumn("ts", F.coalesce("indexed", "created", F.lit(0)))
    tables["pages"] = latest_pages(old.unionByName(gained["pages"]))
    return graph.with_tables(**tables, edges_by_dst=None)


def page_owner(df: DataFrame, graph: Graph, col: str = "url") -> DataFrame:
    """Domain of each page: the stored owner, else the URL's origin, else the text itself."""
    owners = graph.origin_pages.groupBy("page").agg(F.min("origin").alias("_owner"))
    joined = df.join(owners, F.col(col) == F.col("page"), "left")
    return joined.select(*df.columns, F.coalesce("_owner", origin(col), F.col(col)).alias("domain"))


def assert_terms(graph: Graph, submitted: DataFrame, now_ms: int) -> dict[str, DataFrame]:
    """(source, uri, terms, title, description) → new assertions and terms.

    A source that already asserted the URI with all of the terms adds nothing.
    """
    now = F.lit(now_ms).cast("bigint")
    asked = submitted.withColumn("terms", F.array_sort(F.array_distinct("terms"))).filter(F.size("terms") > 0)
    once = asked.groupBy("source", "uri", "terms").agg(
        F.min("title").alias("title"), F.min("description").alias("description")
    )
    held = graph.assertions.select("source", "uri", F.col("terms").alias("held"))
    same = (once.source == held.source) & (once.uri == held.uri)
    covered = F.size(F.array_except(once.terms, held.held)) == 0
    fresh = once.join(held, same & covered, "left_anti")
    text = F.concat_ws("|", "source", "uri", F.array_join("terms", ","))
    rows = fresh.select(
        F.sha2(text, 256).alias("id"), "source", "uri", "title", "description", "terms", now.alias("created")
    )
    names = rows.select(F.explode("terms").alias("term")).distinct()
    terms = new_rows(
        names.select(term_uri("term", graph.instance).alias("term_uri"), "term", now.alias("created")),
        graph.terms,
        KEYS["terms"],
    )
    return {"assertions": rows, "terms": terms}
