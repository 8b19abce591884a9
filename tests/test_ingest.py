import tempfile

from pyspark.sql import functions as F

from linkloom.graph import Graph
from linkloom.operators import ingest
from linkloom.operators.store import GraphStore
from linkloom.sources.html import harvest_html
from linkloom.streaming.ingest import ingest_stream

from core_helpers import INSTANCE, rows

SCHEMA = (
    "id string, type string, title string, description string, image string, postDate string, "
    "tags array<string>, links array<struct<type:string,uri:string,terms:array<string>>>"
)


def page(uri, tags=(), links=(), title=None, kind=None, date=None):
    return (uri, kind, title, None, None, date, list(tags), [(t, u, list(ts)) for t, u, ts in links])


def frame(spark, *pages):
    return spark.createDataFrame(list(pages), SCHEMA)


def test_merge_and_subtypes(spark):
    df = frame(spark, page("https://a.example/", ["x", "x"], [
        ("bookmark", "https://b.example/", ["one"]), ("cite", "https://b.example", ["two", "one"]),
        (None, "https://c.example", []), ("endorse", "https://d.example", []), ("link", "", [])]))
    rows_ = ingest.annotation_rows(df)
    got = rows(ingest.mentions(rows_), "src", "dst", "subtype", "terms")
    assert got == [("https://a.example", "https://b.example", "Bookmark", ["one", "two"]),
                   ("https://a.example", "https://c.example", "Backlink", [])]
    assert ingest.exact_annotations(rows_).filter("kind = 'tag'").count() == 1


def test_replay_changes_nothing(spark):
    root = tempfile.mkdtemp()
    store = GraphStore(spark, root, INSTANCE)
    first = frame(spark, page("https://a.example/1", ["x"], [("cite", "https://b.example/2", ["t"])], " T ", date="2024-01-02"))
    assert store.ingest(0, first, 1000) and not store.ingest(0, first, 1000)
    before = {n: store.log(n).count() for n in Graph.table_names()}
    assert store.ingest(1, first, 2000)
    after = {n: store.log(n).count() for n in Graph.table_names()}
    assert {n for n in before if before[n] != after[n]} == {"pages"}
    got = store.graph().pages.orderBy("uri").collect()
    assert [(r.uri, r.created, r.indexed, r.title, r.self_indexed) for r in got] == [
        ("https://a.example/1", 1000, 2000, "T", True), ("https://b.example/2", 1000, None, None, False)]
    assert got[0].post_date == 1_704_153_600_000
    assert rows(store.graph().terms, "term") == [("t",), ("x",)]
    # a blank or unreadable value does not replace a stored one; a new value does
    store.ingest(2, frame(spark, page("https://a.example/1", title="  ", date="soon")), 3000)
    store.ingest(3, frame(spark, page("https://a.example/1", title="New")), 4000)
    kept = store.graph().pages.filter("uri = 'https://a.example/1'").first()
    assert (kept.title, kept.post_date, kept.indexed) == ("New", 1_704_153_600_000, 4000)
    compact = store.compact_to(root + "-compact")
    assert compact.compacted_graph().inbound.count() == store.graph().edges.count()
    assert rows(compact.graph().pages, "uri", "title") == rows(store.graph().pages, "uri", "title")


def test_ring_handshake_from_both_sides(spark):
    g = Graph.empty(spark, INSTANCE)
    ring = page("https://ring.example", links=[("link", "https://m.example", [])], kind="Webring")
    member = page("https://m.example/p", links=[("link", "https://ring.example", [])])
    for first, second in ((ring, member), (member, ring)):
        one = ingest.apply(g, ingest.ingest(g, frame(spark, first), 1))
        assert one.ring_members.count() == 0
        two = ingest.apply(one, ingest.ingest(one, frame(spark, second), 2))
        assert rows(two.ring_members, "ring", "origin") == [("https://ring.example", "https://m.example")]
        again = ingest.ingest(two, frame(spark, second), 3)
        assert again["ring_members"].count() == 0


def test_endorsements_are_stored(spark):
    df = frame(spark, page("https://a.example/x", links=[("endorse", "https://b.example/y", [])]))
    got = ingest.ingest(Graph.empty(spark, INSTANCE), df, 1)
    assert rows(got["endorsements"], "src_origin", "dst_origin") == [("https://a.example", "https://b.example")]
    assert got["edges"].count() == 0


def test_assertions(spark, small):
    asked = spark.createDataFrame(
        [("https://a.example", "https://z.example/", ["red"], None, None),
         ("https://a.example", "https://z.example/", ["red", "new"], None, None)],
        "source string, uri string, terms array<string>, title string, description string")
    got = ingest.assert_terms(small, asked, 9)
    assert rows(got["assertions"], "terms") == [(["new", "red"],)]
    assert rows(got["terms"], "term") == [("new",)]


def test_stream_equals_batch(spark):
    folder, root = tempfile.mkdtemp(), tempfile.mkdtemp()
    pages = [(f"https://a.example/{i}", f"<title>P{i}</title><a class=t href='https://b.example/{i % 3}'>x</a>") for i in range(6)]
    df = spark.createDataFrame(pages, "url string, html string")
    for i in range(3):
        df.filter(F.substring("url", -1, 1).cast("int") % 3 == i).coalesce(1).write.mode("append").parquet(folder)
    rules = {"subject": {"s": "source", "title": [{"selector": "title", "attribute": "textContent"}]},
             "link": {"s": "source", "o": [{"selector": "a.t", "attribute": "href"}]}}
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    store = GraphStore(spark, root + "/graph", INSTANCE)
    query = ingest_stream(source, store, lambda p: harvest_html(p, rules), lambda b: 1000 + b, root + "/cp")
    query.awaitTermination()
    assert len(store.committed()) == 3
    batch = ingest.ingest(Graph.empty(spark, INSTANCE), harvest_html(df, rules), 1000)
    assert rows(store.graph().edges, "src", "dst") == rows(batch["edges"], "src", "dst")
    assert store.graph().pages.count() == 9


def test_removed_members_may_join_again(spark):
    store = GraphStore(spark, tempfile.mkdtemp(), INSTANCE)
    one = spark.createDataFrame([("r", "a"), ("r", "b")], "ring string, origin string")
    store.append(0, {"ring_members": one})
    store.remove_members(1, one.filter("origin = 'a'"))
    assert rows(store.graph().ring_members, "origin") == [("b",)]
    store.append(2, {"ring_members": one.filter("origin = 'a'")})
    assert rows(store.graph().ring_members, "origin") == [("a",), ("b",)]


def test_writers_do_not_shadow_each_other(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path), INSTANCE)
    one = spark.createDataFrame([("r", "a"), ("r", "b")], "ring string, origin string")
    assert store.append(0, {"ring_members": one}, "first")
    assert store.remove_members(0, one.filter("origin = 'a'")) and not store.remove_members(0, one)
    assert store.append(0, {"ring_members": one.filter("origin = 'a'")}, "second")
    assert rows(store.graph().ring_members, "origin") == [("a",), ("b",)]
    compact = store.compact_to(str(tmp_path / "compact"))
    assert compact.append(0, {"ring_members": one}, "first") and len(compact.commits()) == 2
