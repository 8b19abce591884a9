"""Page objects: assembly, enrichment, selection, discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from linkloom.functions.dates import DateRange
from linkloom.operators import listings, page_objects
from linkloom.operators.page_objects import HEAD, assemble, get_objects
from linkloom.plans.spec import QuerySpec
from linkloom.sources.shop_graph import INSTANCE, shop_graph


def flat(df):
    """Terms as text, so that rows compare by value."""
    return df.withColumn("terms", F.array_join("terms", ","))


def objects(spark, sf_dir, by, **options):
    spec = QuerySpec.build("everything", by, instance=INSTANCE, **options)
    return flat(get_objects(shop_graph(spark, sf_dir), spec))


_COLS = "id, title, description, image, date, post_date, kind, target, type, nullif(terms, '') AS terms"


def _object_sql(pages: str, *, heads: str = "linked_heads", order: str = "") -> str:
    return f"""
        SELECT {_COLS} FROM (SELECT * FROM {heads} WHERE id IN ({pages}) {order})
        LEFT JOIN object_rows USING (id)"""


_BRAND = "SELECT src FROM lg_edges WHERE dst = 'https://lg.example/~/Brand12'"
_NEWEST = "ORDER BY coalesce(post_date, date) DESC, id LIMIT 100"


@check("get_g02_page_objects", _object_sql(_BRAND, order=_NEWEST))
def _(spark, sf_dir):
    return objects(spark, sf_dir, "thorped", o="Brand12")


def _ids(sql: str) -> str:
    return f"SELECT src FROM lg_edges WHERE {sql}"


@check("agg_a06_assembled_objects", """
    SELECT id, title, description, date, post_date,
      (SELECT string_agg(target, ',' ORDER BY target) FROM object_rows o WHERE o.id = h.id AND kind = 'tag') AS tags,
      (SELECT count(*) FROM object_rows o WHERE o.id = h.id AND kind = 'link') AS links
    FROM linked_heads h WHERE contains(id, 'c7')""")
def _(spark, d):
    spec = QuerySpec.build("everything", "tagged", instance=INSTANCE, s="c7", limit=0)
    found = assemble(get_objects(shop_graph(spark, d), spec))
    return found.select(
        "id", "title", "description", "date", "post_date",
        F.when(F.size("tags") > 0, F.array_join("tags", ",")).alias("tags"),
        F.size("links").cast("bigint").alias("links"),
    )


@check("agg_a06_object_parts", """
    SELECT id, count(*) AS annotations FROM object_rows GROUP BY id""")
def _(spark, d):
    """Nested objects keep every annotation, one row per page."""
    spec = QuerySpec.build("everything", "posted", instance=INSTANCE, s="https://c", match="fuzzy-s", limit=0)
    found = assemble(get_objects(shop_graph(spark, d), spec))
    sized = found.select("id", (F.size("tags") + F.size("links")).cast("bigint").alias("annotations"))
    return sized.filter("annotations > 0")


@check("agg_a07_relation_details", """
    SELECT src, dst, subtype, array_to_string(terms, ',') AS terms FROM lg_relations""")
def _(spark, d):
    g = shop_graph(spark, d)
    # the same relation noted once more as a plain backlink must not win
    again = g.relations.withColumn("subtype", F.lit("Backlink")).withColumn("created", F.lit(0).cast("bigint"))
    found = page_objects.relation_details(g.relations.unionByName(again))
    return found.withColumn("terms", F.array_join("terms", ","))


@check("set_u01_linked_and_unlinked", f"""
    SELECT {_COLS} FROM (
      SELECT * FROM linked_heads UNION ALL
      SELECT uri, title, description, image, created, post_date FROM lg_pages
      WHERE uri NOT IN (SELECT src FROM lg_edges)) h LEFT JOIN object_rows USING (id)
    WHERE contains(id, '.example/p/1') OR contains(id, 'c7')""")
def _(spark, d):
    return objects(spark, d, "posted", s=".example/p/1,c7", match="fuzzy", limit=0)


@check("pred_p24_object_date_range", _object_sql(
    _BRAND, heads="(SELECT * FROM linked_heads WHERE coalesce(post_date, date) BETWEEN 757382400000 AND 852076800000)"))
def _(spark, d):
    g = shop_graph(spark, d)
    spec = QuerySpec.build("everything", "thorped", instance=INSTANCE, o="Brand12", limit=0)
    heads, detail = page_objects.object_heads(g, spec)
    span = DateRange(757_382_400_000, 852_076_800_000)
    heads = page_objects.in_range(heads, span, "post_date", "date")
    return flat(page_objects.annotations(g, heads, detail, None))


@check("sort_o04_limited_objects", _object_sql(
    _BRAND, order="ORDER BY coalesce(post_date, date) DESC, id LIMIT 7 OFFSET 5"))
def _(spark, d):
    return objects(spark, d, "thorped", o="Brand12", limit=7, offset=5)


@check("get_g02_cited_objects", """
    SELECT id, title, description, image, max(ts) AS date, post_date, 'link' AS kind, target, type, nullif(terms, '') AS terms
    FROM (SELECT e.src AS id, p.title, p.description, p.image, p.post_date, e.dst AS target, r.subtype AS type,
            array_to_string(r.terms, ',') AS terms, max(e.ts) OVER (PARTITION BY e.src) AS ts
          FROM lg_edges e JOIN lg_relations r ON e.src = r.src AND e.dst = r.dst AND r.subtype = 'Cite'
          JOIN lg_pages p ON p.uri = e.src
          WHERE e.src IN (SELECT src FROM lg_relations WHERE subtype = 'Cite' AND contains(dst, 's1.example')))
    GROUP BY ALL""")
def _(spark, d):
    return objects(spark, d, "cited", o="s1.example", limit=0)


_DISCOVER = """SELECT uri AS id, title, description, image, created AS date, post_date, kind, target, type,
    nullif(terms, '') AS terms FROM (SELECT p.* FROM lg_pages p JOIN lg_origin_pages ON uri = page
      JOIN lg_origins USING (origin) WHERE verified AND {} ORDER BY coalesce(post_date, indexed) DESC NULLS LAST, uri
      LIMIT {}) LEFT JOIN object_rows ON uri = id"""


@check("get_g06_discover", _DISCOVER.format("true", 50))
def _(spark, d):
    return flat(page_objects.discover(shop_graph(spark, d)))


@check("sort_o05_discover_limits", _DISCOVER.format("indexed <= 852076800000", 5000))
def _(spark, d):
    return flat(page_objects.discover(shop_graph(spark, d), limit=5000, indexed=DateRange(before=852_076_800_000)))


@check("set_u02_discover_unlinked", _DISCOVER.format("indexed IS NULL", 50))
def _(spark, d):
    g = shop_graph(spark, d)
    return flat(page_objects.discover(g.with_tables(pages=g.pages.filter("indexed IS NULL"))))


@check("win_n04_first_scalars", "SELECT id, title, description, date, post_date FROM linked_heads")
def _(spark, d):
    g = shop_graph(spark, d)
    return page_objects.heads_of_linked(g, g.edges).drop("image")


@check("win_n06_first_subtype", """
    SELECT event_type AS dst, arg_min(kind, event_id) AS subtype FROM (
      SELECT *, CASE event_id % 3 WHEN 0 THEN 'Cite' WHEN 1 THEN 'Bookmark' ELSE 'Link' END AS kind FROM events) GROUP BY event_type""")
def _(spark, d):
    from linkloom.operators.ingest import mentions
    from linkloom.sources.shop_graph import read

    k = F.col("event_id")
    rows = read(spark, d, "events").select(
        F.lit("https://x.example").alias("src"), F.lit("mention").alias("kind"),
        F.when(k % 3 == 0, "cite").when(k % 3 == 1, "bookmark").otherwise("link").alias("type"),
        F.col("event_type").alias("dst"), F.lit(None).cast("array<string>").alias("terms"), k.alias("pos"),
    )
    return mentions(rows).select("dst", "subtype")


@check("set_u03_harvested_sections", """
    SELECT url AS src, unnest(['tag', 'mention', 'endorse']) AS kind,
      unnest(['t' || page_id, 'https://b.example/' || page_id, 'https://d.example']) AS dst FROM pages""")
def _(spark, d):
    """Tags and the links of two sections, taken together."""
    from linkloom.operators.ingest import annotation_rows
    from linkloom.sources.shop_graph import read

    n = F.col("page_id").cast("string")

    def link(kind, uri):
        return F.struct(F.lit(kind).alias("type"), uri.alias("uri"), F.lit(None).cast("array<string>").alias("terms"))

    links = F.array(link("link", F.concat(F.lit("https://b.example/"), n)), link("endorse", F.lit("https://d.example")))
    rows = read(spark, d, "pages").select(
        F.col("url").alias("id"), F.array(F.concat(F.lit("t"), n)).alias("tags"), links.alias("links"))
    return annotation_rows(rows).select("src", "kind", "dst")


@check("set_u04_new_minus_known", """
    SELECT DISTINCT dst AS origin FROM lg_ring_links WHERE contains(src, '/n/') AND dst NOT IN
      (SELECT origin FROM lg_ring_members)""")
def _(spark, d):
    from linkloom.operators.ingest import new_rows
    from linkloom.sources.shop_graph import ring_links

    found = ring_links(spark, d).filter(F.col("src").contains("/n/"))
    return new_rows(found.select(F.col("dst").alias("origin")).distinct(), shop_graph(spark, d).ring_members, ["origin"])


@check("set_u05_federated_term", """
    SELECT server, uri FROM (SELECT 'a' AS server, src AS uri FROM lg_edges WHERE dst = 'https://lg.example/~/Brand12'
      UNION ALL SELECT 'b', src FROM lg_edges WHERE dst = 'https://lg.example/~/Brand12' AND contains(src, 'c7'))""")
def _(spark, d):
    from linkloom.operators.federation import federated_term

    g = shop_graph(spark, d)
    part = g.with_tables(edges=g.edges.filter(F.col("src").contains("c7")))
    return federated_term({"a": lambda: g, "b": lambda: part}, "Brand12").select("server", "uri")
