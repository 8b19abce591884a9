"""Roll-ups and listings: bookmarks, backlinks, origins, domains, rings, totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.tags import term_name
from linkloom.functions.urls import strip_protocol
from linkloom.graph import Graph
from linkloom.operators.filters import not_banned, without_text
from linkloom.operators.page_objects import chunked, relation_details
from linkloom.operators.pages import paged
from linkloom.plans.spec import QuerySpec

# --- bookmarks -------------------------------------------------------------------


def bookmarks(graph: Graph) -> DataFrame:
    """One row per asserted URI and term."""
    return graph.assertions.select(
        "id", "uri", "title", "description", F.explode("terms").alias("term")
    )


def bookmark_rollup(graph: Graph) -> DataFrame:
    """One row per URI: first title and description, number of distinct tags."""
    tags = bookmark_tags(graph).groupBy("uri").agg(F.count("term").alias("tags"))
    first = F.min_by(F.struct("title", "description"), "id")
    heads = (
        graph.assertions.filter(F.size("terms") > 0)
        .groupBy("uri")
        .agg(first.alias("first"))
        .select("uri", "first.title", "first.description")
    )
    return heads.join(tags, "uri")


def bookmark_tags(graph: Graph) -> DataFrame:
    return bookmarks(graph).select("uri", "term").distinct()


def all_bookmark_tags(graph: Graph) -> DataFrame:
    return bookmarks(graph).select("term").distinct()


# --- backlinks -------------------------------------------------------------------


def backlinks(graph: Graph) -> DataFrame:
    """All page → page links with both titles and descriptions."""
    links = graph.edges.filter(F.col("kind") == "page").select("src", "dst")
    page = graph.pages.select("uri", "title", "description")
    source = page.toDF("src", "src_title", "src_description")
    target = page.toDF("dst", "dst_title", "dst_description")
    return links.join(target, "dst", "left").join(source, "src", "left")


def backlink_rollup(graph: Graph) -> DataFrame:
    """One row per source page: title and number of targets (the targets are backlinks)."""
    links = graph.edges.filter(F.col("kind") == "page")
    counted = links.groupBy("src").agg(F.count("dst").alias("targets"))
    titles = graph.pages.select(F.col("uri").alias("src"), "title", "description")
    return counted.join(titles, "src", "left")


def backlink_groups(graph: Graph) -> DataFrame:
    """Targets listed per source page, in parts for pages with very many."""
    links = graph.edges.filter(F.col("kind") == "page").select("src", "dst")
    return (
        chunked(links, "src", "dst")
        .groupBy("src", "part")
        .agg(F.sort_array(F.collect_list("dst")).alias("targets"))
    )


# --- origins and domains ---------------------------------------------------------


def verified_origins(graph: Graph) -> DataFrame:
    return not_banned(graph.origins.filter("verified")).select("origin")


def get_domains(graph: Graph, spec: QuerySpec) -> DataFrame:
    """Verified, not banned origins; under a ring, its members with their metadata."""
    if spec.subjects.mode == "byParent":
        members = graph.ring_members.filter(F.col("ring").isin(list(spec.subjects.include)))
        rows = members.select(F.col("origin").alias("uri")).distinct()
    else:
        rows = verified_origins(graph).select(F.col("origin").alias("uri"))
    if spec.filters.limit is not None or spec.filters.offset:
        rows = paged(rows.orderBy("uri"), spec.filters.limit, spec.filters.offset)
    pages = graph.pages.select("uri", "title", "description", "image")
    return rows.join(pages, "uri", "left")


def origin_links(graph: Graph, origin: str) -> DataFrame:
    """Everything the pages of one origin link to."""
    owned = graph.origin_pages.filter(F.col("origin") == origin.rstrip("/")).select(
        F.col("page").alias("src")
    )
    return graph.edges.join(owned, "src", "left_semi").select("src", "dst", "kind")


def origin_bookmarks(graph: Graph, origin: str) -> DataFrame:
    said = graph.assertions.filter(F.col("source") == origin.rstrip("/"))
    return said.select("uri", F.explode("terms").alias("term"))


def pages_in_domain(graph: Graph, domain: str) -> DataFrame:
    """Pages whose URI contains the domain text."""
    text = domain.replace("https://", "", 1).replace("http://", "", 1)
    return graph.pages.filter(F.col("uri").contains(text))


def domain_annotations(graph: Graph, domain: str) -> DataFrame:
    """Pages of a domain, linked or not, with one row per annotation and its type."""
    pages = pages_in_domain(graph, domain).select(
        F.col("uri").alias("id"), "title", "description", "image", F.col("indexed").alias("date"), "post_date"
    )
    keys = pages.select(F.col("id").alias("src"))
    edges = graph.edges.join(keys, "src", "left_semi")
    relations = relation_details(graph.relations.join(keys, "src", "left_semi"))
    is_term = F.col("kind") == "term"
    typed = edges.join(relations, ["src", "dst"], "left").select(
        F.col("src").alias("id"),
        F.when(is_term, term_name("dst")).otherwise(F.col("dst")).alias("target"),
        F.when(is_term, "Term").otherwise(F.coalesce("subtype", F.lit("Link"))).alias("type"),
        F.when(~is_term & (F.size("terms") > 0), F.col("terms")).alias("terms"),
    )
    return pages.join(typed, "id", "left")


def domain_summary(annotations: DataFrame) -> DataFrame:
    """Distinct annotation names of a domain, each with the type seen first."""
    place = F.struct((-F.col("date")).alias("age"), "id", "type")
    return (
        annotations.filter(F.col("target").isNotNull())
        .groupBy(F.col("target").alias("name"))
        .agg(F.min_by("type", place).alias("type"))
    )


def domain_pages_with(annotations: DataFrame, name: str) -> DataFrame:
    """Pages of a domain that carry a tag, target or relationship term."""
    hit = (F.col("target") == name) | F.coalesce(F.array_contains("terms", name), F.lit(False))
    return annotations.filter(hit).select("id", "title").distinct()


def domain_label(graph: Graph) -> DataFrame:
    return graph.origins.select("origin", strip_protocol("origin").alias("label"))


# --- rings -----------------------------------------------------------------------


def rings(graph: Graph, hidden: Sequence[str] = ()) -> DataFrame:
    """Rings with their page metadata, without internal ones."""
    shown = without_text(graph.rings.select(F.col("ring").alias("uri")), "uri", hidden)
    pages = graph.pages.select("uri", "title", "description", "image")
    return shown.join(pages, "uri", "left")


def ring_profile(graph: Graph, ring: str) -> DataFrame:
    """Members of a ring with the ring's and their own metadata; no row if unknown."""
    meta = graph.pages.select("uri", "title", "description", "image")
    known = graph.rings.filter(F.col("ring") == ring).select("ring")
    about = meta.toDF("ring", "ring_title", "ring_description", "ring_image")
    members = graph.ring_members.filter(F.col("ring") == ring)
    own = meta.toDF("origin", "title", "description", "image")
    return (
        known.join(about, "ring", "left").join(members, "ring", "left").join(own, "origin", "left")
    )


def ring_exists(graph: Graph, ring: str) -> DataFrame:
    found = graph.rings.filter(F.col("ring") == ring).agg(F.count("*").alias("n"))
    return found.select(F.lit(ring).alias("ring"), (F.col("n") > 0).alias("ring_exists"))


def ring_count(graph: Graph, hidden: Sequence[str] = ()) -> DataFrame:
    shown = without_text(graph.rings, "ring", hidden)
    return shown.agg(F.count("*").alias("rings"))


# --- totals ----------------------------------------------------------------------


def class_counts(graph: Graph) -> DataFrame:
    """Node counts by class; an absent class counts 0."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("class"), "n")

    return (
        counted(graph.terms, "Term")
        .unionByName(counted(graph.pages, "Page"))
        .unionByName(counted(graph.origins, "Origin"))
        .unionByName(counted(graph.assertions, "Assertion"))
    )


def totals(graph: Graph, hidden: Sequence[str] = ()) -> DataFrame:
    """Site totals as one row."""
    names = {
        "Term": "terms",
        "Page": "pages",
        "Origin": "domains",
        "Assertion": "assertions",
        "Ring": "rings",
    }
    ring_row = ring_count(graph, hidden).select(F.lit("Ring").alias("class"), F.col("rings").alias("n"))
    counts = class_counts(graph).unionByName(ring_row)
    return counts.agg(
        *[F.max(F.when(F.col("class") == k, F.col("n"))).alias(v) for k, v in names.items()]
    )


def result_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("results"))
