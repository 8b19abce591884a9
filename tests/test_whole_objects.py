"""Page objects and listings without a limit: the same rows as with one, from one exchange of each table."""

import pytest
from pyspark.sql import functions as F

from core_helpers import INSTANCE
from linkloom.graph import SCHEMAS, Graph
from linkloom.operators.page_objects import get_objects
from linkloom.operators.pages import edge_rows, get_pages, page_listing
from linkloom.plans.spec import QuerySpec

A, B, T = "https://a.example/", "https://b.example/", INSTANCE + "~/"
#: pages and links that come twice, ends and dates that are missing, relationships noted several times
ODD = {
    "pages": [
        (A + "1", 10, 100, 50, "one", None, None, True), (A + "1", 10, 100, 50, "one", None, None, True),
        (A + "2", None, 200, None, "two", "later", None, True), (A + "2", 900, 210, 70, "two again", None, None, True),
        (A + "3", 30, None, None, "bare", None, None, True), (A + "4", None, 5, None, "no date", None, None, True),
        (B + "1", 40, 400, 400, None, None, B + "i.png", False), (None, 5, 5, 5, "nowhere", None, None, True),
    ],
    "edges": [
        (A + "1", T + "red", "term", 11), (A + "1", B + "1", "page", 13), (A + "1", B + "1", "page", 13), (A + "1", None, "page", 14),
        (A + "2", B + "1", "page", None), (A + "2", B + "2", "page", 23), (A + "2", T + "red", "term", 24), (A + "4", B + "2", "page", 40),
        (None, B + "1", "page", 50), ("https://gone.example/", B + "1", "page", 60), (B + "1", T + "blue", None, 70),
    ],
    "relations": [
        (A + "1", B + "1", "Backlink", ["red", None], 1), (A + "1", B + "1", "Cite", ["blue", "red"], 13), (A + "1", None, "Cite", ["blue"], 14),
        (A + "2", B + "1", "Link", None, 22), (A + "2", B + "2", None, [], None), (A + "2", B + "2", "Bookmark", ["blue"], 23),
        (A + "4", B + "2", "Cite", [], 9), (None, B + "1", "Cite", ["red"], 2), (A + "3", B + "9", "Cite", ["blue"], 3),
    ],
}
SPECS = [
    ("posted", {"s": "a.example", "match": "fuzzy-s"}), ("posted", {"s": "example", "not_s": A + "1", "match": "fuzzy-s"}),
    ("posted", {"s": "example", "match": "fuzzy", "created": "before-1970-01-02"}), ("posted", {"s": "example", "rt": "blue", "match": "fuzzy-s"}),
    ("linked", {"s": "example"}), ("linked", {"o": B + "1", "match": "exact"}),
    ("linked", {"s": A + "2", "match": "exact"}), ("thorped", {"o": "red"}), ("cited", {"o": "b.example"}), ("cited", {"s": "a.example"}),
    ("linked", {"rt": "blue"}), ("linked", {"rt": "blue", "rt_scope": "link"}), ("linked", {"s": "example", "when": "before-1970-01-02"}),
    ("linked", {"s": "example", "indexed": "before-1970-01-02"}), ("in-webring", {"s": "https://ring.example"}), ("bookmarked", {"rt": "blue"}),
    ("thorped", {"o": "red,blue", "match": "all"}), ("linked", {"s": "a.example", "not_o": B + "1"}),
]


@pytest.fixture(scope="module")
def odd(spark, small):
    return small.with_tables(**{n: spark.createDataFrame(ODD[n], SCHEMAS[n]) for n in ODD})


def found(graph, by, limit, rt_scope="page", **options):
    spec = QuerySpec.build("everything", by, instance=INSTANCE, limit=limit, **options)
    return get_objects(graph, spec, rt_scope).withColumn("terms", F.array_join("terms", ","))


@pytest.mark.parametrize("by,options", SPECS, ids=[f"{b} {o}" for b, o in SPECS])
def test_rows_are_those_of_a_large_limit(odd, by, options):
    every = sorted(map(tuple, found(odd, by, 0, **options).collect()), key=repr)
    ranked = sorted(map(tuple, found(odd, by, 1_000_000, **options).collect()), key=repr)
    assert every == ranked


def test_values(odd):
    got = {(r.id, r.kind, r.target, r.type, r.terms, r.date) for r in found(odd, "posted", 0, s="example", match="fuzzy-s").collect()}
    assert (A + "1", "link", B + "1", "Cite", "blue,red", 14) in got and (A + "1", "link", None, "link", None, 14) in got
    assert (A + "3", None, None, None, None, 30) in got
    assert {r[0] for r in got} == {A + "1", A + "2", A + "3", B + "1"}


def test_each_table_is_exchanged_once(spark, small):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = found(small, "posted", 0, s="a.example", match="fuzzy-s")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 2


def test_edges_of_few_pages_need_no_exchange(small):
    plan = found(small, "cited", 0, o="b.example")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("LeftSemi") >= 2 and "SortMergeJoin [src" not in plan


def listing_spec(by, **options):
    options.pop("rt_scope", None)
    return QuerySpec.build("pages", by, instance=INSTANCE, limit=0, **options)


LISTED = [x for x in SPECS if x[0] != "posted"] + [
    ("linked", {"s": "example", "created": "after-1970-01-01"}), ("linked", {"s": "example", "when": "after-1970-01-01", "indexed": "recent"})]


@pytest.mark.parametrize("by,options", LISTED, ids=[f"{b} {o}" for b, o in LISTED])
def test_listing_is_that_of_the_edge_rows(odd, by, options):
    spec, scope = listing_spec(by, **options), options.get("rt_scope", "page")
    got = [tuple(r) for r in get_pages(odd, spec, scope).collect()]
    assert got == [tuple(r) for r in page_listing(edge_rows(odd, spec, scope)).collect()]


def test_listing_exchanges_edges_and_pages_once(spark, small):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = get_pages(small, listing_spec("linked", s="a.example"))
        plan = rows._jdf.queryExecution().executedPlan().toString().split("\n")
        rows.collect()
        final = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # edges and pages, planned for both roles and shared when run, and the places of the targets
    assert sum("Exchange hashpartitioning" in line for line in plan) == 5
    assert final.count("ReusedExchange") == 2
