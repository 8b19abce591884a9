"""What several tables of a batch follow from is found once; the scratch files of an ingest are deleted."""

import os

from core_helpers import INSTANCE, rows
from linkloom.operators import ingest
from linkloom.operators.store import GraphStore

SCHEMA = "id string, tags array<string>, links array<struct<type:string,uri:string,terms:array<string>>>"
LINK = ("cite", "https://b.example/1", ["t"])
OLD = [("https://a.example/1", ["x", "x"], [LINK]), (None, ["x"], [LINK])]
NEW = OLD + [("https://a.example/1", ["y"], [LINK, ("link", "https://b.example/2", None)]), ("https://c.example/1/", ["x"], None)]


def test_tables_do_not_find_the_new_edges_again(spark, small):
    gained = ingest.ingest(small, ingest.found_once(spark.createDataFrame(NEW, SCHEMA)), 7)
    for name in ("edges", "relations", "term_usage", "origin_pages"):
        assert "LeftAnti" not in gained[name]._jdf.queryExecution().optimizedPlan().toString(), name
    assert gained["origins"]._jdf.queryExecution().optimizedPlan().toString().count("LeftAnti") == 1


def test_a_batch_found_once_gains_the_same_on_a_graph_that_holds_rows(spark, small):
    pages = spark.createDataFrame(NEW, SCHEMA)
    graph = ingest.apply(small, ingest.ingest(small, spark.createDataFrame(OLD, SCHEMA), 5))
    one, two = ingest.ingest(graph, pages, 7), ingest.ingest(graph, ingest.found_once(pages), 7)
    for name in one:
        assert one[name].exceptAll(two[name]).count() == two[name].exceptAll(one[name]).count() == 0, name
    assert rows(two["edges"].filter("kind = 'page'"), "src", "dst") == [("https://a.example/1", "https://b.example/2")]


def test_scratch_files_are_deleted(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path), INSTANCE)
    assert store.ingest(0, spark.createDataFrame(OLD, SCHEMA), 1) and store.ingest(1, spark.createDataFrame(NEW, SCHEMA), 2)
    assert not [name for name in os.listdir(tmp_path) if name.startswith("scratch")]
    assert rows(store.graph().edges.filter("kind = 'page'"), "src", "dst") == [
        ("", "https://b.example/1"), ("https://a.example/1", "https://b.example/1"), ("https://a.example/1", "https://b.example/2")]
