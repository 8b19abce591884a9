"""Page objects: a page's scalars with all of its tags and typed links.

The working form is long, one row per annotation, so that a page with very many
annotations is never gathered into one row. ``assemble`` nests it for export.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.dates import DateRange
from linkloom.functions.tags import term_name
from linkloom.graph import Graph
from linkloom.operators.filters import (
    filter_relations,
    filter_subjects,
    in_range,
    relation_test,
    relations_by_page,
)
from linkloom.operators.pages import (
    is_small,
    linked_rows,
    matching_edges,
    newest_first,
    paged,
    posted_rows,
    posted_test,
)
from linkloom.plans.spec import QuerySpec
from linkloom.session import stored, write_once

CHUNK = 1000
HEAD = ("title", "description", "image", "date", "post_date")


def _named_first() -> Column:
    """The order of the relationships of one link: a named subtype beats Backlink."""
    return F.struct((F.col("subtype") == "Backlink").alias("plain"), "created", "subtype")


def relation_details(relations: DataFrame) -> DataFrame:
    """One row per (src, dst): a named subtype beats Backlink, terms are united."""
    return (
        relations.select("src", "dst", "subtype", "created", F.explode_outer("terms").alias("term"))
        .groupBy("src", "dst")
        .agg(
            F.min_by("subtype", _named_first()).alias("subtype"),
            F.sort_array(F.collect_set("term")).alias("terms"),
        )
    )


def heads_of_linked(graph: Graph, detail: DataFrame) -> DataFrame:
    """Scalars per page; the date is the newest edge time."""
    newest = detail.groupBy("src").agg(F.max("ts").alias("date"))
    pages = graph.pages.select("uri", "title", "description", "image", "post_date")
    return newest.join(pages, newest.src == pages.uri).select(F.col("src").alias("id"), *HEAD)


def heads_of_unlinked(graph: Graph, pages: DataFrame) -> DataFrame:
    """Selected pages that carry no link; dated by creation."""
    bare = pages.join(graph.edges.select("src"), "src", "left_anti")
    return bare.select(F.col("src").alias("id"), *HEAD)


def annotations(graph: Graph, heads: DataFrame, detail: DataFrame, limit: int | None) -> DataFrame:
    """Long page objects: heads with one row per tag or typed link."""
    keys = heads.select(F.col("id").alias("src"))
    keys = F.broadcast(keys) if is_small(limit) else keys
    edges = detail.join(keys, "src", "left_semi")
    relations = relation_details(graph.relations.join(keys, "src", "left_semi"))
    typed = edges.join(relations, ["src", "dst"], "left").select(F.col("src").alias("id"), *_shown())
    return heads.join(typed, "id", "left")


def _shown() -> list[Column]:
    """A tag or typed link, from an edge with the details of its relationship."""
    is_term = F.col("kind") == "term"
    return [
        F.when(is_term, "tag").otherwise("link").alias("kind"),
        F.when(is_term, term_name("dst")).otherwise(F.col("dst")).alias("target"),
        F.when(~is_term, F.coalesce("subtype", F.lit("link"))).alias("type"),
        F.when(~is_term & (F.size("terms") > 0), F.col("terms")).alias("terms"),
    ]


def object_heads(
    graph: Graph, spec: QuerySpec, rt_scope: str = "page"
) -> tuple[DataFrame, DataFrame]:
    """The chosen pages, newest first after LIMIT and OFFSET, and their edges."""
    filt = spec.filters
    unlinked = spec.objects.type == "none"
    if unlinked:
        chosen = posted_rows(graph, spec)
    elif filt.when or filt.created or filt.indexed:
        chosen = linked_rows(graph, spec, rt_scope)
    else:  # the page table is joined to the heads below, so not here
        chosen = matching_edges(graph, spec, rt_scope)
    detail = graph.edges.join(chosen.select("src"), "src", "left_semi")
    detail = filter_relations(detail, graph, filt.subtype, filt.relation_terms, rt_scope)
    heads = heads_of_linked(graph, detail)
    if unlinked:
        heads = heads.unionByName(heads_of_unlinked(graph, chosen))
    heads = in_range(heads, filt.when, "post_date", "date")
    if filt.limit is not None or filt.offset:
        heads = paged(newest_first(heads, "id"), filt.limit, filt.offset)
    return heads, detail


def _by_text(df: DataFrame, graph: Graph, spec: QuerySpec, col: str) -> DataFrame:
    """Rows of the pages whose text meets the subject conditions, which then hold for all rows of a page."""
    subj = spec.subjects
    if subj.mode == "byParent":
        return df
    return filter_subjects(df, graph, subj.mode, subj.include, subj.exclude, col)


def _edges_and_relations(graph: Graph, spec: QuerySpec) -> DataFrame:
    """Edges, and relationships in between (``of_link``), in one exchange by page."""
    edges = graph.edges.select("src", "dst", "kind", "ts", F.lit(False).alias("of_link"))
    relations = graph.relations.select("src", "dst", "subtype", "terms", "created", F.lit(True).alias("of_link"))
    both = edges.unionByName(relations, allowMissingColumns=True).filter("src IS NOT NULL")
    return _by_text(both, graph, spec, "src").repartition("src")


def _with_details(both: DataFrame, test: Column, by_page: bool) -> DataFrame:
    """The edges, with the details of their relationships and whether one of these meets a test.

    The relationships lie beside their edges, so no join by both ends exchanges them again.
    """
    link, page = Window.partitionBy("src", "dst"), Window.partitionBy("src")
    known = F.col("of_link") & F.col("dst").isNotNull()
    terms = F.array_compact(F.flatten(F.collect_list(F.when(known, F.col("terms"))).over(link)))
    meets = F.max(F.when(F.col("of_link"), test)).over(page) if by_page else F.max(F.when(known, test)).over(link)
    return both.select(
        "src", "dst", "kind", "ts", "of_link",
        F.min_by("subtype", F.when(known, _named_first())).over(link).alias("subtype"),
        F.sort_array(F.array_distinct(terms)).alias("terms"),
        F.coalesce(meets, F.lit(False)).alias("wanted"),
    ).filter("NOT of_link").drop("of_link")


def whole_objects(graph: Graph, spec: QuerySpec, rt_scope: str = "page") -> DataFrame:
    """Long page objects of all pages a spec selects, none of which a rank leaves out.

    Edges, relationships and pages are exchanged by page once: the date of a page, the details of
    its links and its scalars are found where its rows lie.
    """
    subj, filt = spec.subjects, spec.filters
    unlinked = spec.objects.type == "none"
    both = _edges_and_relations(graph, spec)
    if unlinked:
        pages = filter_subjects(graph.pages, graph, subj.mode, subj.include, subj.exclude, "uri")
        pages = pages.withColumn("posted", posted_test(spec))
        pages = pages.withColumn("chosen", F.max("posted").over(Window.partitionBy("uri"))).filter("chosen")
    else:
        dated = filt.when or filt.created or filt.indexed
        chosen = linked_rows(graph, spec, rt_scope) if dated else matching_edges(graph, spec, rt_scope)
        # found once and written, so that Spark knows their size: few are sent to the rows, which then need no shuffle
        keys = stored(chosen.select("src").distinct(), "chosen")
        both = both.join(keys, "src", "left_semi")
        pages = graph.pages.join(keys, F.col("uri") == F.col("src"), "left_semi")
    test = relation_test(filt.subtype, filt.relation_terms)
    rows = _with_details(both, test, relations_by_page(filt.subtype, filt.relation_terms, rt_scope))
    if not filt.subtype and not filt.relation_terms:
        rows = rows.withColumn("wanted", F.lit(True))
    if not unlinked:
        rows = rows.filter("wanted")
    newest = F.max(F.when(F.col("wanted"), F.col("ts"))).over(Window.partitionBy("src"))
    rows = rows.withColumn("date", newest)
    heads = pages.select("uri", "title", "description", "image", "post_date", *(["created", "posted"] if unlinked else []))
    found = heads.join(rows, F.col("uri") == F.col("src"), "left" if unlinked else "inner")
    if unlinked:  # pages that carry no link are dated by creation
        bare = F.col("src").isNull()
        found = found.filter((bare & F.col("posted")) | F.col("wanted"))
        found = found.withColumn("date", F.when(bare, F.col("created")).otherwise(F.col("date")))
    found = in_range(found, filt.when, "post_date", "date")
    kind, *others = _shown()
    kind = F.when(F.col("src").isNotNull(), kind).alias("kind")
    return found.select(F.col("uri").alias("id"), *HEAD, kind, *others)


def get_objects(graph: Graph, spec: QuerySpec, rt_scope: str = "page") -> DataFrame:
    """Long page objects of the pages a spec selects."""
    spec.require_bounded()
    filt = spec.filters
    if filt.limit is None and not filt.offset:
        return whole_objects(graph, spec, rt_scope)
    heads, detail = object_heads(graph, spec, rt_scope)
    if is_small(filt.limit):  # the heads alone select the edges to show; one broadcast serves both uses
        detail = filter_relations(graph.edges, graph, filt.subtype, filt.relation_terms, rt_scope)
    return annotations(graph, heads, detail, filt.limit)


def discover(
    graph: Graph,
    limit: int = 50,
    offset: int = 0,
    when: DateRange = DateRange(),
    created: DateRange = DateRange(),
    indexed: DateRange = DateRange(),
) -> DataFrame:
    """Newest pages of verified origins with their annotations, 50 by default."""
    verified = graph.origins.filter("verified").select("origin")
    owned = graph.origin_pages.join(verified, "origin", "left_semi").select(F.col("page").alias("uri"))
    pages = graph.pages.join(owned, "uri", "left_semi")
    pages = in_range(pages, when, "post_date", "indexed")
    pages = in_range(in_range(pages, created, "created"), indexed, "indexed")
    dated = F.coalesce("post_date", "indexed")
    top = paged(pages.orderBy(dated.desc_nulls_last(), "uri"), limit, offset).select(
        F.col("uri").alias("id"), "title", "description", "image", F.col("created").alias("date"), "post_date"
    )
    # the pages are found once, not again for each table that they are looked up in
    return annotations(graph, write_once(top) if is_small(limit) else top, graph.edges, limit)


def chunked(df: DataFrame, key: str, value: str, chunk: int = CHUNK) -> DataFrame:
    """Add ``part``: 0 for ordinary keys, a hash of the value for keys beyond ``chunk`` rows."""
    large = df.groupBy(key).agg(F.count(value).alias("rows")).filter(F.col("rows") > chunk)
    parts = large.select(key, F.ceil(F.col("rows") / chunk).alias("parts"))
    spread = F.pmod(F.xxhash64(value), F.coalesce("parts", F.lit(1)))
    return df.join(parts, key, "left").withColumn("part", spread.cast("int")).drop("parts")


def assemble(rows: DataFrame) -> DataFrame:
    """Nest long page objects, one row for each page, as a published item is one record.

    The row holds all of the page's own annotations; the long form has no such bound.
    """
    link = F.struct(F.col("target").alias("uri"), "type", "terms")
    return (
        rows.groupBy("id")
        .agg(
            *[F.first(c).alias(c) for c in HEAD],
            F.array_sort(F.collect_list(F.when(F.col("kind") == "tag", F.col("target")))).alias("tags"),
            F.array_sort(F.collect_list(F.when(F.col("kind") == "link", link))).alias("links"),
        )
    )
