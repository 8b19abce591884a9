"""The origin of a page is found once per page: no filter of it runs for each annotation."""

from pyspark.sql import functions as F

from core_helpers import INSTANCE, rows
from linkloom.functions.tags import term_uri
from linkloom.functions.urls import origin
from linkloom.graph import Graph
from linkloom.operators import ingest

SCHEMA = "id string, tags array<string>, links array<struct<type:string,uri:string,terms:array<string>>>"
PAGES = [
    ("https://A.example:443/1/", ["x", "x", ""], [("cite", "https://b.example/", ["t"]), ("link", "https://b.example", None)]),
    ("https://A.example:443/1/", ["y"], [("endorse", "https://c.example", None)]),
    ("http://u@a.example/2", None, [(None, "https://lg.example/~/x", [])]),
    ("http://u@a.example/2", ["x"], None),
    ("no scheme", ["x"], [("link", "https://b.example/", None)]),
    ("https:///", ["x"], None),
    (None, ["x", None], [("link", "https://b.example/", None)]),
    ("https://alone.example", None, None),
]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def test_a_uri_stands_few_times_in_its_origin(spark):
    """Each place becomes a copy of what the URI is made of, wherever Spark pushes a filter of the origin."""
    text = spark.createDataFrame([], "the_uri string").select(origin("the_uri"))._jdf.queryExecution().analyzed().toString()
    assert text.splitlines()[0].count("the_uri#") <= 25


def test_no_filter_finds_origins_below_the_grouping(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    found = ingest.ingest(Graph.empty(spark, INSTANCE), pages, 1)["origin_pages"]
    assert not [line for line in plan(found) if "Filter" in line and "StartsWith" in line]
    assert rows(found, "origin", "page") == [
        ("http://a.example", "http://u@a.example/2"),
        ("https://a.example", "https://A.example:443/1"),
        ("https://a.example", "https://A.example:443/1/"),
    ]


def test_edges_in_one_pass_are_those_of_tags_and_mentions(spark):
    found = ingest.annotation_rows(spark.createDataFrame(PAGES, SCHEMA))
    now = F.lit(7).cast("bigint")
    pairs = ingest.mentions(found).select("src", "dst", F.lit("page").alias("kind"), now.alias("ts"))
    want = ingest.tag_edges(found, INSTANCE, now).unionByName(pairs)
    got = ingest.harvested_edges(found, INSTANCE, now)
    assert got.columns == want.columns and got.count() == want.count() == 10
    assert got.exceptAll(want).count() == 0
    assert got.filter(F.col("dst") == term_uri(F.lit("x"), INSTANCE)).filter("kind = 'page'").count() == 1


def test_a_batch_found_once_gains_the_same(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    graph = Graph.empty(spark, INSTANCE)
    one, two = ingest.ingest(graph, pages, 1), ingest.ingest(graph, ingest.found_once(pages), 1)
    for name in one:
        assert one[name].exceptAll(two[name]).count() == two[name].exceptAll(one[name]).count() == 0, name
