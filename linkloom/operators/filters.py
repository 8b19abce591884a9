"""Subject, object, relationship and date conditions on edges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.dates import DateRange
from linkloom.functions.tags import fuzzy_tags
from linkloom.graph import Graph
from linkloom.operators.needles import with_needles, without_needles
from linkloom.vocabulary import TERM_PATH


def contains_any(col: Column, texts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [col.contains(t) for t in texts])


def ring_pages(graph: Graph, rings: Sequence[str]) -> DataFrame:
    """Pages of the member sites of some rings, as one ``page`` column."""
    members = graph.ring_members.filter(F.col("ring").isin(list(rings)))
    return graph.origin_pages.join(members, "origin", "left_semi").select("page")


def filter_by_needles(edges: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None, col="dst") -> DataFrame:
    """Fuzzy subjects (`col="src"`) or objects from tables of one text column, of any size."""
    if include is not None:
        edges = with_needles(edges, col, include)
    return edges if exclude is None else without_needles(edges, col, exclude)


def filter_subjects(df: DataFrame, graph: Graph, mode: str, include, exclude, col="src") -> DataFrame:
    subject = F.col(col)
    if include:
        if mode == "fuzzy":
            df = df.filter(contains_any(subject, include))
        elif mode == "byParent":
            inside = ring_pages(graph, include)
            df = df.join(inside, subject == inside.page, "left_semi")
        else:
            df = df.filter(subject.isin(list(include)))
    if exclude:
        if mode == "fuzzy":
            df = df.filter(~contains_any(subject, exclude))
        elif mode == "byParent":
            inside = ring_pages(graph, exclude)
            df = df.join(inside, subject == inside.page, "left_anti")
        else:
            df = df.filter(~subject.isin(list(exclude)))
    return df


def term_uris(instance: str, names: Sequence[str]) -> list[str]:
    return [instance + TERM_PATH + n for n in names]


def _object_test(graph: Graph, kind: str, mode: str, values: Sequence[str]) -> Column:
    dst = F.col("dst")
    if mode == "very-fuzzy":
        return contains_any(dst, fuzzy_tags(values))
    if kind == "termsOnly":
        names = fuzzy_tags(values) if mode == "fuzzy" else values
        return dst.isin(term_uris(graph.instance, names))
    if mode == "fuzzy":
        return contains_any(dst, values)
    return dst.isin(list(values))


def named_objects(graph: Graph, kind: str, mode: str, values: Sequence[str]) -> list[str] | None:
    """The only objects that edges chosen by these can have; None where they are matched by a part of their text."""
    if not values or mode == "very-fuzzy" or (mode == "fuzzy" and kind != "termsOnly"):
        return None
    if kind == "termsOnly":
        return term_uris(graph.instance, fuzzy_tags(values) if mode == "fuzzy" else values)
    return list(values)


def filter_object_class(edges: DataFrame, kind: str) -> DataFrame:
    """The kind column tells terms from pages, so no class join is needed."""
    if kind == "termsOnly":
        return edges.filter(F.col("kind") == "term")
    if kind == "pagesOnly":
        return edges.filter(F.col("kind") == "page")
    if kind == "notTerms":
        return edges.filter(F.col("kind") != "term")
    return edges


def with_every_object(edges: DataFrame, uris: Sequence[str]) -> DataFrame:
    """Sources that carry each of the objects (at most 50, so the sets stay small)."""
    wanted = sorted(set(uris))
    return (
        edges.filter(F.col("dst").isin(wanted))
        .select("src", "dst")
        .distinct()
        .groupBy("src")
        .agg(F.count("dst").alias("hits"))
        .filter(F.col("hits") == len(wanted))
        .select("src")
    )


def filter_objects(edges: DataFrame, graph: Graph, kind: str, mode: str, include, exclude) -> DataFrame:
    if include:
        if mode == "all":
            uris = term_uris(graph.instance, include) if kind == "termsOnly" else list(include)
            complete = with_every_object(graph.edges, uris)
            edges = edges.filter(F.col("dst").isin(uris)).join(complete, "src", "left_semi")
        else:
            edges = edges.filter(_object_test(graph, kind, mode, include))
    if exclude:
        if mode == "fuzzy" and kind == "termsOnly":
            # exclusion matches any term that contains a variation
            edges = edges.filter(~contains_any(F.col("dst"), fuzzy_tags(exclude)))
        else:
            how = "exact" if mode == "all" else mode
            edges = edges.filter(~_object_test(graph, kind, how, exclude))
    return edges


def relation_test(subtype: str = "", relation_terms: Sequence[str] = ()) -> Column:
    """Whether a relationship has the subtype and one of the terms, as far as they are named."""
    test = F.lit(True)
    if subtype:
        test = test & (F.col("subtype") == subtype)
    if relation_terms:
        test = test & F.arrays_overlap("terms", F.array(*[F.lit(t) for t in relation_terms]))
    return F.coalesce(test, F.lit(False))


def filter_relations(
    edges: DataFrame,
    graph: Graph,
    subtype: str = "",
    relation_terms: Sequence[str] = (),
    rt_scope: str = "page",
) -> DataFrame:
    """Subtype and terms of the relationship behind an edge.

    Terms without a subtype hold for every link of the page; ``rt_scope='link'``
    ties them to the link that carries them.
    """
    if not subtype and not relation_terms:
        return edges
    wanted = graph.relations
    if subtype:
        wanted = wanted.filter(F.col("subtype") == subtype)
    if relation_terms:
        named = F.array(*[F.lit(t) for t in relation_terms])
        wanted = wanted.filter(F.arrays_overlap("terms", named))
    keys = ["src"] if relations_by_page(subtype, relation_terms, rt_scope) else ["src", "dst"]
    return edges.join(wanted.select(*keys), keys, "left_semi")


def relations_by_page(subtype: str, relation_terms: Sequence[str], rt_scope: str) -> bool:
    """Whether one relationship with the terms lets all links of its page through."""
    return bool(relation_terms) and not subtype and rt_scope == "page"


def in_range(df: DataFrame, bounds: DateRange, *cols: str) -> DataFrame:
    """Keep rows whose first non-null date lies in the range; undated rows drop out."""
    if not bounds:
        return df
    return df.filter(bounds.holds(F.coalesce(*[F.col(c) for c in cols])))


def not_banned(origins: DataFrame) -> DataFrame:
    return origins.filter(~F.coalesce(F.col("banned"), F.lit(False)))


def without_text(df: DataFrame, col: str, texts: Sequence[str]) -> DataFrame:
    """Drop rows whose column contains one of the texts, such as internal test rings."""
    return df.filter(~contains_any(F.col(col), texts)) if texts else df


def without_own_pages(df: DataFrame, instance: str, col: str = "uri") -> DataFrame:
    return df.filter(~F.startswith(F.col(col), F.lit(instance)))


def search(df: DataFrame, text: str, *cols: str, ignore_case: bool = True) -> DataFrame:
    """Search box: rows where one of the columns contains the text."""
    if not text:
        return df
    tests = []
    for name in cols:
        col = F.coalesce(F.col(name).cast("string"), F.lit(""))
        tests.append(F.lower(col).contains(text.lower()) if ignore_case else col.contains(text))
    return df.filter(reduce(lambda a, b: a | b, tests))
