"""Term rows, term usage and what one term is used on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.tags import term_name
from linkloom.functions.urls import looks_like_url
from linkloom.graph import Graph
from linkloom.operators.filters import filter_objects, filter_subjects, without_own_pages
from linkloom.operators.pages import paged
from linkloom.plans.spec import QuerySpec
from linkloom.vocabulary import TERM_PATH


def get_terms(graph: Graph, spec: QuerySpec) -> DataFrame:
    """Distinct (term, date) of matching pages, newest first."""
    spec.require_bounded()
    subj, obj = spec.subjects, spec.objects
    edges = graph.edges.filter(F.col("kind") == "term")
    edges = filter_objects(edges, graph, obj.type, obj.mode, obj.include, obj.exclude)
    edges = filter_subjects(edges, graph, subj.mode, subj.include, subj.exclude)
    rows = edges.select("dst", F.col("ts").alias("date")).distinct()
    rows = rows.orderBy(F.col("date").desc_nulls_last(), "dst")
    return paged(rows, spec.filters.limit, spec.filters.offset).select(
        term_name("dst").alias("term"), "date"
    )


def term_usage(graph: Graph) -> DataFrame:
    """Every use of a term with its page and the origin that owns the page."""
    uses = graph.edges.filter(F.col("kind") == "term")
    owners = graph.origin_pages
    return uses.join(owners, uses.src == owners.page).select(
        F.col("dst").alias("term_uri"), F.col("ts").alias("time"), "page", "origin"
    )


def term_rollup(graph: Graph) -> DataFrame:
    """Latest use, distinct domains and number of uses per term.

    Counted per (term, domain) first, so a hot term is spread over its domains.
    The pages and domains behind the counts are term_usage and term_domains.
    """
    per_domain = (
        term_usage(graph)
        .groupBy("term_uri", "origin")
        .agg(F.max("time").alias("latest"), F.count("*").alias("uses"))
    )
    return per_domain.groupBy("term_uri").agg(
        F.max("latest").alias("latest"),
        F.count("origin").alias("domains"),
        F.sum("uses").alias("uses"),
    )


def term_domains(graph: Graph) -> DataFrame:
    return term_usage(graph).select("term_uri", "origin").distinct()


def popular_terms(graph: Graph) -> DataFrame:
    """Terms by number of distinct domains."""
    return term_rollup(graph).orderBy(F.col("domains").desc(), "term_uri")


def usage_feed(graph: Graph, term: str | None = None) -> DataFrame:
    """(page, term, time), newest first; one term or all of them."""
    uses = graph.edges.filter((F.col("kind") == "term") & F.col("ts").isNotNull())
    if term is not None:
        uses = uses.filter(F.col("dst") == term_reference(graph, term))
    return uses.select(
        F.col("src").alias("page"), F.col("dst").alias("term_uri"), F.col("ts").alias("time")
    ).orderBy(F.col("time").desc(), "page", "term_uri")


def term_reference(graph: Graph, term: str) -> str:
    return term if looks_like_url(term) else graph.instance + TERM_PATH + term


def term_pages(graph: Graph, term: str, own_pages: bool = False) -> DataFrame:
    """Pages tagged with a term, given by name or URI."""
    uses = graph.inbound.filter(F.col("dst") == term_reference(graph, term)).select("src").distinct()
    rows = uses.join(graph.pages, uses.src == graph.pages.uri, "left").select(
        F.col("src").alias("uri"), "title", "description", "post_date", F.col("indexed").alias("date")
    )
    return rows if own_pages else without_own_pages(rows, graph.instance)


def term_bookmarks(graph: Graph, term: str) -> DataFrame:
    """Assertions that carry a term, as bookmarks."""
    uri = term_reference(graph, term)
    name = uri.rsplit(TERM_PATH, 1)[-1]
    return (
        graph.assertions.filter(F.array_contains("terms", name))
        .select("uri", "title", "description")
        .distinct()
    )
