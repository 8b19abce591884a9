import pytest
from pyspark.sql import functions as F

from linkloom.client import LinkGraph
from linkloom.operators import listings, page_objects, rings, terms, trust
from linkloom.operators.page_objects import assemble

from core_helpers import rows


@pytest.fixture(scope="module")
def client(small):
    return LinkGraph(small)


def test_pages_by_term_newest_first(client):
    got = [tuple(r) for r in client.get("pages", "thorped", o="red").select("role", "uri").collect()]
    # post date 50 beats edge time 21; the shared target comes after its first source
    assert got == [("subject", "https://a.example/1"), ("object", "https://lg.example/~/red"), ("subject", "https://a.example/2")]


def test_target_image_is_read(client):
    got = client.get("pages", "linked", o="https://b.example/1").filter("role = 'object'").collect()
    assert [r.image for r in got] == ["https://b.example/i.png"]


def test_match_all_and_exclusions(client):
    assert rows(client.get("pages", "thorped", o="red,blue", match="all").filter("role='subject'"), "uri") == [("https://a.example/1",)]
    # a row goes when it matches any excluded value, not only all of them
    got = client.get("pages", "linked", s="https://a.example", not_s="https://a.example/1,https://zzz.example", match="fuzzy-s")
    assert ("https://a.example/1",) not in rows(got, "uri")
    # exclusions by URL work when the class is not a term
    got = client.get("pages", "linked", s="a.example", not_o="https://b.example/1")
    assert rows(got, "uri") == [("https://a.example/2",), ("https://b.example/2",)]


def test_subtypes_and_relation_terms(client):
    cited = client.get("pages", "cited", o="b.example").filter("role = 'object'")
    assert rows(cited, "uri") == [("https://b.example/1",)]
    # terms without a subtype hold for every link of the page, or for the link itself
    loose = client.get("pages", "linked", rt="blue").filter("role = 'object'")
    tight = client.get("pages", "linked", rt="blue", rt_scope="link").filter("role = 'object'")
    assert rows(loose, "uri") == [("https://b.example/1",), ("https://b.example/2",)]
    assert rows(tight, "uri") == [("https://b.example/2",)]


def test_posted_includes_pages_first_seen_as_targets(client):
    got = client.get("pages", "posted", s="b.example")
    assert rows(got, "uri") == [("https://b.example/1",), ("https://b.example/2",)]


def test_ring_subjects(client):
    got = client.get("pages", "in-webring", s="https://ring.example").filter("role = 'subject'")
    assert rows(got, "uri") == [("https://a.example/1",), ("https://a.example/2",)]
    two = client.get("domains", "in-webring", s="https://ring.example,https://ring2.example")
    assert rows(two, "uri") == [("https://a.example",), ("https://b.example",)]


def test_domains_drop_banned(client):
    assert rows(client.get("domains", "posted"), "uri") == [("https://a.example",)]


def test_objects(client):
    got = rows(client.get("everything", "thorped", o="blue"), "id", "kind", "target", "type")
    assert got == [
        ("https://a.example/1", "link", "https://b.example/1", "Cite"),
        ("https://a.example/1", "tag", "blue", None),
        ("https://a.example/1", "tag", "red", None),
    ]
    ids = client.get("everything", "thorped", o="red", limit=1, offset=1).select("id").distinct()
    assert rows(ids, "id") == [("https://a.example/2",)]
    assert client.get("everything", "thorped", o="red", limit="0").select("id").distinct().count() == 2


def test_assembled_objects_lose_nothing(client):
    whole = assemble(client.get("everything", "linked", s="a.example", limit=0)).collect()
    assert len(whole) == 2
    assert len({(r.id, t) for r in whole for t in r.tags} | {(r.id, x.uri) for r in whole for x in r.links}) == 6


def test_a_page_with_many_tags_is_one_item_and_one_record(spark, small):
    page, term = "https://a.example/1", "https://lg.example/~/n"
    many = spark.range(2500).select(
        F.lit(page).alias("src"), F.concat(F.lit(term), "id").alias("dst"), F.lit("term").alias("kind"), F.lit(11).cast("long").alias("ts"))
    client = LinkGraph(small.with_tables(edges=many))
    found = client.get("everything", "posted", s=page, limit=0)
    lines = [r.value for r in client.publish(found, "rss").collect()]
    assert sum(line.startswith("<item>") for line in lines) == 1
    records = client.prepare(found, "siteDocument").collect()
    assert len(records) == 1 and len(records[0].record.tags) == 2500


def test_terms_and_rollup(client, small):
    assert rows(client.get("thorpes", "thorped", s="a.example"), "term", "date") == [("blue", 12), ("red", 11), ("red", 21)]
    assert rows(terms.term_rollup(small), "term_uri", "latest", "domains", "uses") == [
        ("https://lg.example/~/blue", 12, 1, 1), ("https://lg.example/~/red", 21, 1, 2)]
    assert rows(terms.term_bookmarks(small, "red"), "uri") == [("https://z.example/",)]


def test_debug_and_routes(client):
    found = client.get("pages", "thorped", o="red", as_="debug")
    assert found["spec"]["meta"]["resultMode"] == "links" and "Physical Plan" in found["query"]
    assert "Physical Plan" in client.explain_spec("pages", "thorped", o="red")
    with pytest.raises(ValueError, match="Invalid route"):
        client.get("mentions", "thorped", o="red")
    saved = client.spec("everything", "thorped", o="red").to_json()
    assert client.run(saved).count() > 0


def test_rss_document(client):
    lines = [r.value for r in client.get("everything", "thorped", o="red", as_="rss").collect()]
    assert lines[0].startswith("<rss") and lines[-1] == "</channel></rss>" and len(lines) == 4


def test_ring_profile_and_neighbours(spark, small):
    assert rows(listings.ring_profile(small, "https://nope.example"), "ring") == []
    assert listings.ring_exists(small, "https://nope.example").first().ring_exists is False
    members = spark.createDataFrame([("r", f"https://m{i}.example") for i in range(30)], "ring string, origin string")
    got = {r.origin: r for r in rings.neighbours(members).collect()}
    seen, at = set(), "https://m0.example"
    while at not in seen:
        seen.add(at)
        assert got[got[at].next].previous == at
        at = got[at].next
    assert len(seen) == 30
    for r in rings.random_sites(members, 3).collect():
        assert r.random not in (None, r.origin, r.previous, r.next)
    lone = spark.createDataFrame([("r", "a")], "ring string, origin string")
    assert rings.random_sites(lone, 1).first().random is None


def test_trust(spark, small):
    found = {r.origin: r.hops for r in trust.trusted_origins(small).collect()}
    assert found == {"https://a.example": 0, "https://b.example": 0, "https://c.example": 1}
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src_origin string, dst_origin string")
    start = spark.createDataFrame([("a", True, False)], "origin string, verified boolean, banned boolean")
    got = trust.trusted_origins(small.with_tables(endorsements=loop, origins=start), checkpoint_every=1)
    assert {r.origin: r.hops for r in got.collect()} == {"a": 0, "b": 1, "c": 2}


def test_discover_and_domain(small):
    found = page_objects.discover(small, limit=1)
    assert {r.id for r in found.collect()} == {"https://b.example/2"}
    summary = listings.domain_summary(listings.domain_annotations(small, "https://a.example"))
    assert rows(summary, "name", "type") == [
        ("blue", "Term"), ("https://b.example/1", "Link"), ("https://b.example/2", "Bookmark"), ("red", "Term")]
