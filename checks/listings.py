"""Roll-ups, listings, rings, totals and trust."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from linkloom.functions.dates import DateRange
from linkloom.operators import listings, rings, terms, trust
from linkloom.plans.spec import QuerySpec
from linkloom.sources.shop_graph import INSTANCE, read, ring_links, shop_graph

RING = "https://ring.example/n/3"


@check(
    "agg_a01_class_counts",
    """SELECT 'Term' AS class, count(*) AS n FROM lg_terms UNION ALL SELECT 'Page', count(*) FROM lg_pages
       UNION ALL SELECT 'Origin', count(*) FROM lg_origins UNION ALL SELECT 'Assertion', count(*) FROM lg_assertions""",
)
def _(spark, d):
    return listings.class_counts(shop_graph(spark, d))


@check("agg_a02_ring_count", "SELECT count(*) AS rings FROM lg_rings WHERE NOT contains(ring, '/n/1')")
def _(spark, d):
    return listings.ring_count(shop_graph(spark, d), hidden=["/n/1"])


_USE = """SELECT dst AS term_uri, ts, origin, page FROM lg_edges JOIN lg_origin_pages ON src = page
          WHERE kind = 'term'"""


@check(
    "agg_a03_term_rollup",
    f"""SELECT term_uri, max(ts) AS latest, count(DISTINCT origin) AS domains, CAST(count(*) AS BIGINT) AS uses
        FROM ({_USE}) GROUP BY term_uri""",
)
def _(spark, d):
    return terms.term_rollup(shop_graph(spark, d))


@check("agg_a03_term_domains", f"SELECT DISTINCT term_uri, origin FROM ({_USE})")
def _(spark, d):
    return terms.term_domains(shop_graph(spark, d))


@check(
    "sort_o06_popular_terms",
    f"""SELECT term_uri, max(ts) AS latest, count(DISTINCT origin) AS domains, CAST(count(*) AS BIGINT) AS uses
        FROM ({_USE}) GROUP BY term_uri""",
)
def _(spark, d):
    return terms.popular_terms(shop_graph(spark, d))


@check("sort_o07_usage_feed", "SELECT src AS page, dst AS term_uri, ts AS time FROM lg_edges WHERE kind = 'term'")
def _(spark, d):
    return terms.usage_feed(shop_graph(spark, d))


@check(
    "agg_a04_bookmark_rollup",
    """SELECT uri, min_by(title, id) AS title, min_by(description, id) AS description, count(DISTINCT term) AS tags
       FROM (SELECT id, uri, title, description, unnest(terms) AS term FROM lg_assertions) GROUP BY uri""",
)
def _(spark, d):
    return listings.bookmark_rollup(shop_graph(spark, d))


@check("agg_a04_bookmark_tags", "SELECT DISTINCT unnest(terms) AS term FROM lg_assertions")
def _(spark, d):
    return listings.all_bookmark_tags(shop_graph(spark, d))


@check(
    "agg_a05_backlink_rollup",
    """SELECT src, title, description, count(*) AS targets FROM page_edges JOIN lg_pages ON src = uri
       GROUP BY ALL""",
)
def _(spark, d):
    return listings.backlink_rollup(shop_graph(spark, d))


@check(
    "agg_a05_backlink_groups",
    "SELECT src, string_agg(dst, ',' ORDER BY dst) AS targets FROM page_edges GROUP BY src",
)
def _(spark, d):
    found = listings.backlink_groups(shop_graph(spark, d))
    return found.select("src", F.array_join("targets", ",").alias("targets"))


_DOMAIN = """SELECT uri AS id, title, description, image, indexed AS date, post_date, target,
    CASE WHEN kind = 'tag' THEN 'Term' WHEN kind = 'link' THEN coalesce(type, 'Link') END AS type,
    nullif(terms, '') AS terms FROM lg_pages LEFT JOIN object_rows ON uri = id WHERE contains(uri, 'c7')"""


@check("agg_a08_domain_annotations", _DOMAIN)
def _(spark, d):
    found = listings.domain_annotations(shop_graph(spark, d), "https://c7")
    return found.withColumn("terms", F.array_join("terms", ","))


@check(
    "agg_a09_domain_summary",
    f"""SELECT target AS name, type FROM (SELECT target, type, row_number() OVER (PARTITION BY target
        ORDER BY -date NULLS FIRST, id, type) AS n FROM ({_DOMAIN}) WHERE target IS NOT NULL) WHERE n = 1""",
)
def _(spark, d):
    return listings.domain_summary(listings.domain_annotations(shop_graph(spark, d), "c7"))


@check("agg_a11_last_indexed", "SELECT uri, max(indexed) + 5 AS indexed FROM lg_pages GROUP BY uri")
def _(spark, d):
    """Every page is harvested twice, the second time 5 ms later."""
    from linkloom.operators.ingest import latest_pages

    first = shop_graph(spark, d).pages.withColumn("type", F.lit(None).cast("string")).withColumn("ts", F.lit(1))
    again = first.withColumn("indexed", F.col("indexed") + 5).withColumn("ts", F.lit(2))
    return latest_pages(first.unionByName(again)).select("uri", "indexed")


# --- listings ----------------------------------------------------------------------


@check(
    "get_g04_domains",
    """SELECT origin AS uri, title, description, image FROM lg_origins LEFT JOIN lg_pages ON origin = uri
       WHERE verified AND NOT banned""",
)
def _(spark, d):
    spec = QuerySpec.build("domains", "posted", instance=INSTANCE, limit="no-limit")
    return listings.get_domains(shop_graph(spark, d), spec)


@check(
    "get_g04_ring_members",
    f"""SELECT origin AS uri, title, description, image FROM lg_ring_members LEFT JOIN lg_pages ON origin = uri
        WHERE ring = '{RING}'""",
)
def _(spark, d):
    spec = QuerySpec.build("domains", "in-webring", instance=INSTANCE, s=RING, limit="no-limit")
    return listings.get_domains(shop_graph(spark, d), spec)


@check(
    "get_g07_all_terms",
    "SELECT dst AS term_uri, ts AS time, page, origin FROM lg_edges JOIN lg_origin_pages ON src = page WHERE kind = 'term'",
)
def _(spark, d):
    return terms.term_usage(shop_graph(spark, d))


@check(
    "get_g08_term_pages",
    """SELECT uri, title, description, post_date, indexed AS date FROM lg_pages
       WHERE uri IN (SELECT src FROM lg_edges WHERE dst = 'https://lg.example/~/Brand12')""",
)
def _(spark, d):
    return terms.term_pages(shop_graph(spark, d), "Brand12")


@check(
    "get_g08_term_bookmarks",
    "SELECT DISTINCT uri, title, description FROM lg_assertions WHERE list_contains(terms, 'en')",
)
def _(spark, d):
    return terms.term_bookmarks(shop_graph(spark, d), "https://lg.example/~/en")


@check("get_g09_domains", "SELECT origin FROM lg_origins WHERE verified AND NOT banned")
def _(spark, d):
    return listings.verified_origins(shop_graph(spark, d))


@check(
    "get_g10_origin_links",
    """SELECT src, dst, kind FROM lg_edges JOIN lg_origin_pages ON src = page
       WHERE origin = 'https://c70.example'""",
)
def _(spark, d):
    return listings.origin_links(shop_graph(spark, d), "https://c70.example/")


@check(
    "get_g11_backlinks",
    """WITH p AS MATERIALIZED (SELECT uri, title, description FROM lg_pages)
       SELECT src, dst, s.title AS src_title, s.description AS src_description, o.title AS dst_title,
       o.description AS dst_description FROM page_edges LEFT JOIN p s ON src = s.uri LEFT JOIN p o ON dst = o.uri""",
)
def _(spark, d):
    return listings.backlinks(shop_graph(spark, d))


@check("get_g12_bookmarks", "SELECT id, uri, title, description, unnest(terms) AS term FROM lg_assertions")
def _(spark, d):
    return listings.bookmarks(shop_graph(spark, d))


@check(
    "get_g13_rings",
    "SELECT uri, title, description, image FROM lg_rings JOIN lg_pages ON ring = uri WHERE NOT contains(uri, '/n/1')",
)
def _(spark, d):
    return listings.rings(shop_graph(spark, d), hidden=["/n/1"])


@check(
    "get_g14_ring_profile",
    f"""WITH known AS MATERIALIZED (SELECT uri, title, description, image FROM lg_pages),
        m AS MATERIALIZED (SELECT ring, origin FROM lg_ring_members WHERE ring = '{RING}')
        SELECT m.ring, p.title AS ring_title, p.description AS ring_description, p.image AS ring_image, origin,
        o.title, o.description, o.image FROM m JOIN known p ON m.ring = p.uri
        LEFT JOIN known o ON origin = o.uri""",
)
def _(spark, d):
    return listings.ring_profile(shop_graph(spark, d), RING)


@check("get_g14_ring_exists", f"SELECT '{RING}' AS ring, count(*) > 0 AS ring_exists FROM lg_rings WHERE ring = '{RING}'")
def _(spark, d):
    return listings.ring_exists(shop_graph(spark, d), RING)


@check(
    "get_g15_totals",
    """SELECT (SELECT count(*) FROM lg_terms) AS terms, (SELECT count(*) FROM lg_pages) AS pages,
       (SELECT count(*) FROM lg_origins) AS domains, (SELECT count(*) FROM lg_assertions) AS assertions,
       (SELECT count(*) FROM lg_rings) AS rings""",
)
def _(spark, d):
    return listings.totals(shop_graph(spark, d))


# --- rings -------------------------------------------------------------------------


@check(
    "win_n02_ring_neighbours",
    """SELECT ring, origin,
         coalesce(lag(origin) OVER w, last_value(origin) OVER (PARTITION BY ring ORDER BY md5(origin), origin
           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS previous,
         coalesce(lead(origin) OVER w, first_value(origin) OVER w) AS next
       FROM lg_ring_members WINDOW w AS (PARTITION BY ring ORDER BY md5(origin), origin)""",
)
def _(spark, d):
    return rings.neighbours(shop_graph(spark, d).ring_members)


_AROUND = """m AS (SELECT DISTINCT ring, origin, md5(origin) AS rank FROM lg_ring_members),
    n AS (SELECT ring, origin,
      coalesce(lag(origin) OVER w, last_value(origin) OVER f) AS previous,
      coalesce(lead(origin) OVER w, first_value(origin) OVER f) AS next FROM m
      WINDOW w AS (PARTITION BY ring ORDER BY rank, origin),
        f AS (PARTITION BY ring ORDER BY rank, origin ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@check("win_n03_random_ring_site", f"""WITH {_AROUND}
    SELECT ring, origin, previous, next, (SELECT arg_min(m.origin, md5(m.origin || ' 7')) FROM m WHERE m.ring = n.ring
      AND m.origin NOT IN (n.previous, n.origin, n.next)) AS random FROM n""")
def _(spark, d):
    return rings.random_sites(shop_graph(spark, d).ring_members, seed=7)


@check(
    "ingest_w22_ring_members",
    f"SELECT DISTINCT origin FROM lg_ring_members WHERE ring = '{RING}'",
)
def _(spark, d):
    return rings.members_of(shop_graph(spark, d), RING)


_JOIN = """SELECT DISTINCT i.dst AS ring, regexp_extract(i.src, '^https://[^/]+') AS origin
    FROM lg_ring_links i JOIN lg_ring_links o ON o.src = i.dst AND o.dst = regexp_extract(i.src, '^https://[^/]+')
    WHERE i.dst IN (SELECT ring FROM lg_rings)"""


@check("ingest_w16_ring_handshake", _JOIN)
def _(spark, d):
    g = shop_graph(spark, d)
    known = g.ring_members.limit(0)
    return rings.handshakes(ring_links(spark, d), g.rings, known)


@check(
    "ingest_w17_ring_side_handshake",
    f"SELECT * FROM ({_JOIN}) EXCEPT SELECT * FROM lg_ring_members WHERE ring LIKE '%1'",
)
def _(spark, d):
    g = shop_graph(spark, d)
    known = g.ring_members.filter(F.col("ring").endswith("1"))
    return rings.ring_side_handshakes(ring_links(spark, d), ring_links(spark, d), g.rings, known)


@check(
    "ingest_w19_removed_member",
    "SELECT ring, origin FROM lg_ring_members WHERE origin NOT LIKE '%2.example'",
)
def _(spark, d):
    members = shop_graph(spark, d).ring_members
    return rings.without_removed(members, members.filter(F.col("origin").endswith("2.example")))


# --- trust -------------------------------------------------------------------------


@check(
    "ingest_w23_endorsed",
    """WITH asked AS (SELECT DISTINCT 'https://s' || s_suppkey || '.example/p/1' AS src,
         'https://s' || (s_suppkey + CASE WHEN s_suppkey % 3 = 0 THEN -1 ELSE 2 - s_suppkey % 3 END) || '.example/' AS dst FROM supplier)
       SELECT src, dst, so = dor OR (dor, so) IN (SELECT (src_origin, dst_origin) FROM lg_endorsements)
         OR (dst, src) IN (SELECT (src, dst) FROM lg_edges) AS endorsed
       FROM (SELECT *, regexp_extract(src, '^https://[^/]+') AS so, regexp_extract(dst, '^https://[^/]+') AS dor FROM asked)""",
)
def _(spark, d):
    k = F.col("s_suppkey")
    step = F.when(k % 3 == 0, -1).otherwise(2 - k % 3)
    pairs = read(spark, d, "supplier").select(
        F.concat(F.lit("https://s"), k.cast("string"), F.lit(".example/p/1")).alias("src"),
        F.concat(F.lit("https://s"), (k + step).cast("string"), F.lit(".example/")).alias("dst"),
    )
    return trust.endorsed(pairs.distinct(), shop_graph(spark, d))


@check(
    "ingest_w26_approved",
    "SELECT origin, page FROM lg_origin_pages WHERE origin IN (SELECT origin FROM lg_origins WHERE verified)",
)
def _(spark, d):
    g = shop_graph(spark, d)
    return trust.approved(g.origin_pages, g)


@check(
    "ingest_w27_trusted_origins",
    """WITH RECURSIVE seeds AS (SELECT origin FROM lg_origins WHERE origin LIKE 'https://s%1.example'),
       walk AS (SELECT origin, 0 AS hops FROM seeds
       UNION SELECT dst_origin, hops + 1 FROM walk JOIN lg_endorsements ON src_origin = origin)
       SELECT origin, min(hops) AS hops FROM walk GROUP BY origin""",
)
def _(spark, d):
    g = shop_graph(spark, d)
    seeds = F.col("origin").like("https://s%1.example")
    return trust.trusted_origins(g.with_tables(origins=g.origins.withColumn("verified", seeds)))


@check(
    "ingest_w28_registration_status",
    """SELECT domain, CASE WHEN banned THEN 'banned' WHEN verified THEN 'verified' ELSE 'pending' END AS status
       FROM (SELECT 'https://c' || (c_custkey * 2) || '.example/' AS domain FROM customer)
       LEFT JOIN lg_origins ON rtrim(domain, '/') = origin""",
)
def _(spark, d):
    asked = F.concat(F.lit("https://c"), (F.col("c_custkey") * 2).cast("string"), F.lit(".example/"))
    return trust.registration_status(
        read(spark, d, "customer").select(asked.alias("domain")), shop_graph(spark, d)
    )
