"""Edge rows with page attributes, and the role-tagged page listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.graph import Graph
from linkloom.operators.filters import (
    filter_object_class,
    filter_objects,
    filter_relations,
    filter_subjects,
    in_range,
    named_objects,
)
from linkloom.plans.spec import QuerySpec

# a row limit up to this many rows also bounds what may be broadcast
BROADCAST_ROWS = 10_000


def is_small(limit: int | None) -> bool:
    return limit is not None and limit <= BROADCAST_ROWS


def matching_edges(graph: Graph, spec: QuerySpec, rt_scope: str = "page") -> DataFrame:
    """Edges that meet the subject, object, class and relationship conditions."""
    subj, obj, filt = spec.subjects, spec.objects, spec.filters
    by_target = bool(obj.include) and obj.mode in ("exact", "all") and not subj.include
    edges = graph.inbound if by_target else graph.edges
    edges = filter_object_class(edges, obj.type)
    edges = filter_objects(edges, graph, obj.type, obj.mode, obj.include, obj.exclude)
    edges = filter_subjects(edges, graph, subj.mode, subj.include, subj.exclude)
    return filter_relations(edges, graph, filt.subtype, filt.relation_terms, rt_scope)


def _dated_filters(df: DataFrame, spec: QuerySpec) -> DataFrame:
    df = in_range(df, spec.filters.when, "post_date", "date")
    df = in_range(df, spec.filters.created, "created")
    return in_range(df, spec.filters.indexed, "indexed")


def dated_edges(graph: Graph, spec: QuerySpec, rt_scope: str = "page") -> DataFrame:
    edges = matching_edges(graph, spec, rt_scope)
    return edges.select("src", "dst", "kind", F.col("ts").alias("date"))


def linked_rows(graph: Graph, spec: QuerySpec, rt_scope: str = "page") -> DataFrame:
    """Matching edges joined to their source page; every source is a known page."""
    edges = dated_edges(graph, spec, rt_scope)
    rows = edges.join(graph.pages, edges.src == graph.pages.uri).drop("uri", "self_indexed")
    return _dated_filters(rows, spec)


def posted_rows(graph: Graph, spec: QuerySpec) -> DataFrame:
    """Pages themselves, dated by creation, without looking at links."""
    subj = spec.subjects
    pages = filter_subjects(graph.pages, graph, subj.mode, subj.include, subj.exclude, col="uri")
    rows = pages.filter(F.col("created").isNotNull()).select(
        F.col("uri").alias("src"),
        F.lit(None).cast("string").alias("dst"),
        F.lit(None).cast("string").alias("kind"),
        F.col("created").alias("date"),
        "created",
        "indexed",
        "post_date",
        "title",
        "description",
        "image",
    )
    return _dated_filters(rows, spec)


def dated_test(spec: QuerySpec, date: str = "date") -> Column:
    """What ``_dated_filters`` asks of a row, as a column."""
    filt = spec.filters
    test = F.lit(True)
    for bounds, *cols in ((filt.when, "post_date", date), (filt.created, "created"), (filt.indexed, "indexed")):
        if bounds:
            test = test & bounds.holds(F.coalesce(*[F.col(c) for c in cols]))
    return F.coalesce(test, F.lit(False))


def posted_test(spec: QuerySpec) -> Column:
    """Whether a row of the page table is one of ``posted_rows``, as far as its subject is not asked for."""
    return F.col("created").isNotNull() & dated_test(spec, "created")


def newest_first(df: DataFrame, *ties: str) -> DataFrame:
    dated = F.coalesce(F.col("post_date"), F.col("date"))
    return df.orderBy(dated.desc_nulls_last(), *[F.col(t).asc_nulls_first() for t in ties])


def paged(df: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def attach_target(rows: DataFrame, graph: Graph, limit: int | None, named: list[str] | None = None) -> DataFrame:
    """Left join of the target's title, description and image; ``named`` are the only targets of the rows, if known."""
    target = graph.pages.select(
        F.col("uri").alias("dst"),
        F.col("title").alias("o_title"),
        F.col("description").alias("o_description"),
        F.col("image").alias("o_image"),
    )
    if named is not None:
        # all rows of a named target share one join key: no exchange may bring them to one task
        target = F.broadcast(target.filter(F.col("dst").isin(named)))
    elif is_small(limit):
        # few rows were kept: reduce the page table by them instead of shuffling it
        target = target.join(F.broadcast(rows.select("dst").distinct()), "dst", "left_semi")
        target = F.broadcast(target)
    return rows.join(target, "dst", "left")


def edge_rows(graph: Graph, spec: QuerySpec, rt_scope: str = "page") -> DataFrame:
    """Edge rows, newest first, after LIMIT and OFFSET, with both ends' attributes."""
    spec.require_bounded()
    filt = spec.filters
    if spec.objects.type == "none":
        rows = newest_first(posted_rows(graph, spec), "src")
        empty = F.lit(None).cast("string")
        return paged(rows, filt.limit, filt.offset).select(
            "*", empty.alias("o_title"), empty.alias("o_description"), empty.alias("o_image")
        )
    rows = newest_first(linked_rows(graph, spec, rt_scope), "src", "dst")
    rows = paged(rows, filt.limit, filt.offset)
    obj = spec.objects
    return attach_target(rows, graph, filt.limit, named_objects(graph, obj.type, obj.mode, obj.include))


def page_listing(rows: DataFrame) -> DataFrame:
    """Each URI once, at its first place in the edge rows, source before target.

    A minimum per URI keeps the partial aggregation of hot targets, which a window
    over the URI would not.
    """
    place = F.struct(
        (-F.coalesce("post_date", "date")).alias("age"),
        F.col("src").alias("row_src"),
        F.col("dst").alias("row_dst"),
    )
    no_date = F.lit(None).cast("bigint")
    ends = F.array(
        F.struct(
            F.lit(0).alias("rank"),
            F.lit("subject").alias("role"),
            F.col("src").alias("uri"),
            F.col("title").alias("title"),
            F.col("description").alias("description"),
            F.col("date").alias("date"),
            F.col("image").alias("image"),
        ),
        F.struct(
            F.lit(1).alias("rank"),
            F.lit("object").alias("role"),
            F.col("dst").alias("uri"),
            F.col("o_title").alias("title"),
            F.col("o_description").alias("description"),
            no_date.alias("date"),
            F.col("o_image").alias("image"),
        ),
    )
    seen = rows.select(place.alias("place"), F.explode(ends).alias("end")).filter("end.uri IS NOT NULL")
    key = F.struct("place", "end.rank")
    first = seen.groupBy(F.col("end.uri").alias("uri")).agg(
        F.min(key).alias("key"), F.min_by("end", key).alias("end")
    )
    return first.orderBy("key").select(
        "end.role", "uri", "end.title", "end.description", "end.date", "end.image"
    )


def _place(rank: int) -> Column:
    """Where a row stands in the listing, then which of its ends is meant."""
    age = (-F.coalesce("post_date", "date")).alias("age")
    return F.struct(age, "src", "dst", F.lit(rank).alias("rank"))


def whole_listing(graph: Graph, spec: QuerySpec, rt_scope: str = "page") -> DataFrame:
    """``page_listing`` of all edge rows a spec selects, none of which a rank leaves out.

    Only the places of the targets are exchanged, as the texts of a URI lie with its page, be it listed as
    subject or as object. Both roles read the same rows, whose pages stay whole, so that Spark exchanges
    edges and pages once for both.
    """
    filt, texts = spec.filters, ["title", "description", "image"]
    scalars = ["post_date", *["created"] * bool(filt.created), *["indexed"] * bool(filt.indexed)]
    pages = graph.pages.select("uri", F.struct(*texts, *scalars).alias("page"))
    edges = dated_edges(graph, spec, rt_scope).select("src", "dst", "date").filter("src IS NOT NULL")
    own = pages.join(edges, F.col("uri") == F.col("src"), "left")

    def read(name: str) -> Column:
        # in a lambda, as Spark would else prune the page to these fields where its texts are not needed
        return F.transform(F.array("page"), lambda page: page[name])[0].alias(name)

    own = own.select("uri", "page", "src", "dst", "date", *map(read, scalars))
    listed = F.col("src").isNotNull() & dated_test(spec)
    subject, target = (F.when(listed, _place(rank)) for rank in (0, 1))
    end = F.struct(*[F.col("page")[t].alias(t) for t in texts], "date")
    subjects = own.groupBy("uri").agg(
        F.min(subject).alias("place"), F.min_by(end, subject).alias("end"), F.first("page").alias("page")
    )
    targets = own.groupBy(F.col("dst").alias("uri")).agg(F.min(target).alias("named"))
    both = subjects.join(targets, "uri", "full").withColumn("key", F.least("place", "named"))
    is_subject = F.col("key.rank") == 0
    shown = {t: F.when(is_subject, F.col("end")[t]).otherwise(F.col("page")[t]).alias(t) for t in texts}
    listing = both.filter("uri IS NOT NULL AND key IS NOT NULL").select(
        "key",
        F.when(is_subject, "subject").otherwise("object").alias("role"),
        "uri",
        shown["title"],
        shown["description"],
        F.when(is_subject, F.col("end.date")).alias("date"),
        shown["image"],
    )
    return listing.orderBy("key").drop("key")


def get_pages(graph: Graph, spec: QuerySpec, rt_scope: str = "page") -> DataFrame:
    spec.require_bounded()
    obj, filt = spec.objects, spec.filters
    ranked = filt.limit is not None or filt.offset
    if ranked or obj.type == "none" or named_objects(graph, obj.type, obj.mode, obj.include) is not None:
        return page_listing(edge_rows(graph, spec, rt_scope))
    return whole_listing(graph, spec, rt_scope)


def linkers(graph: Graph, url: str) -> DataFrame:
    """Distinct pages that link to a URL."""
    return graph.inbound.filter(F.col("dst") == url).select("src").distinct()
