"""Edge conditions, joins, row listings, sorts and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from linkloom.functions.dates import DateRange
from linkloom.functions.tags import fuzzy_tags
from linkloom.operators import filters, ingest, listings, pages, terms
from linkloom.operators.pages import edge_rows, get_pages, linked_rows, matching_edges
from linkloom.operators.terms import get_terms
from linkloom.plans.spec import QuerySpec
from linkloom.sources.shop_graph import INSTANCE, ring_links, shop_graph

TERM = "https://lg.example/~/"
RING = "https://ring.example/n/"


def spec(what, by, **options):
    options.setdefault("limit", "no-limit")
    return QuerySpec.build(what, by, instance=INSTANCE, **options)


def matched(spark, d, by, **options):
    """Matching edges as (src, dst)."""
    return matching_edges(shop_graph(spark, d), spec("pages", by, **options)).select("src", "dst")


def register_edges(name, sql, by, **options):
    @check(name, f"SELECT src, dst FROM lg_edges WHERE {sql}")
    def _(spark, d):
        return matched(spark, d, by, **options)


def _like_any(col, values):
    return "(" + " OR ".join(f"contains({col}, '{v}')" for v in values) + ")"


def _listed(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_C7 = "https://c7.example/o/"
_RINGS = [RING + "3", RING + "4"]
_IN_RING = f"""kind <> 'term' AND src IN (SELECT page FROM lg_origin_pages JOIN lg_ring_members USING (origin)
               WHERE ring IN {_listed(_RINGS)})"""

register_edges(
    "pred_p01_subject_exact",
    "src IN ('https://c899.example/o/0', 'https://c769.example/o/1') AND kind <> 'term'",
    "linked", s="https://c899.example/o/0,https://c769.example/o/1", match="exact",
)
register_edges(
    "pred_p02_subject_fuzzy",
    "kind = 'term' AND " + _like_any("src", ["c7.example", "c11.example"]),
    "thorped", s="c7.example,c11.example", match="fuzzy-s",
)
register_edges("pred_p03_subject_by_ring", _IN_RING, "in-webring", s=",".join(_RINGS))
register_edges(
    "pred_p04_exclude_subject_exact",
    "dst = 'https://lg.example/~/Brand12' AND src NOT IN ('https://c1.example/o/1', 'https://c2.example/o/2')",
    "thorped", o="Brand12", not_s="https://c1.example/o/1,https://c2.example/o/2", match="exact",
)
register_edges(
    "pred_p05_exclude_subject_fuzzy",
    "dst = 'https://lg.example/~/Brand12' AND NOT " + _like_any("src", ["https://c1", "9.example"]),
    "thorped", o="Brand12", not_s="https://c1,9.example", match="fuzzy-s",
)
register_edges(
    "pred_p06_exclude_subject_by_ring", _IN_RING.replace("src IN", "src NOT IN"), "in-webring", not_s=",".join(_RINGS)
)
register_edges(
    "pred_p07_object_terms", f"dst IN {_listed([TERM + 'Brand3', TERM + 'Brand4'])}", "thorped", o="Brand3,Brand4"
)
register_edges(
    "pred_p08_object_urls",
    "dst IN ('https://s1.example/p/1', 'https://s2.example/p/2', 'https://s3.example/p/3')",
    "linked", o="https://s1.example/p/1,https://s2.example/p/2,https://s3.example/p/3",
)
register_edges(
    "pred_p09_object_terms_fuzzy",
    f"dst IN {_listed([TERM + v for v in fuzzy_tags('brand12')])}",
    "thorped", o="brand12", match="fuzzy-o",
)
register_edges(
    "pred_p10_object_urls_fuzzy", "kind <> 'term' AND " + _like_any("dst", ["s1.example", "/p/77"]),
    "linked", o="s1.example,/p/77",
)
register_edges(
    "pred_p11_object_very_fuzzy",
    "kind = 'term' AND " + _like_any("dst", fuzzy_tags("brand1")),
    "thorped", o="brand1", match="very-fuzzy-o",
)
register_edges(
    "pred_p12_object_all",
    """dst IN ('https://lg.example/~/Brand3', 'https://lg.example/~/Brand4') AND src IN (
       SELECT src FROM lg_edges WHERE dst = 'https://lg.example/~/Brand3' INTERSECT
       SELECT src FROM lg_edges WHERE dst = 'https://lg.example/~/Brand4')""",
    "thorped", o="Brand3,Brand4", match="all",
)
register_edges(
    "pred_p13_exclude_object_exact",
    f"kind = 'term' AND contains(src, 'c7') AND dst NOT IN {_listed([TERM + 'Brand3', TERM + 'Brand4'])}",
    "thorped", s="c7", not_o="Brand3,Brand4",
)
register_edges(
    "pred_p13_exclude_object_urls",
    "kind <> 'term' AND contains(src, 'c7') AND dst <> 'https://s1.example/p/1'",
    "linked", s="c7", not_o="https://s1.example/p/1",
)
register_edges(
    "pred_p14_exclude_terms_fuzzy",
    "kind = 'term' AND contains(src, 'c7') AND NOT " + _like_any("dst", fuzzy_tags("brand1")),
    "thorped", s="c7", not_o="brand1", match="fuzzy",
)
register_edges(
    "pred_p15_exclude_urls_fuzzy",
    "kind <> 'term' AND contains(src, 'c7') AND NOT " + _like_any("dst", ["s1.example", "s2.example"]),
    "linked", s="c7", not_o="s1.example,s2.example", match="fuzzy",
)
register_edges(
    "pred_p16_exclude_very_fuzzy",
    "kind = 'term' AND contains(src, 'c7') AND NOT " + _like_any("dst", fuzzy_tags(["brand1", "brand2"])),
    "thorped", s="c7", not_o="brand1,brand2", match="very-fuzzy",
)


@check(
    "pred_p17_object_classes",
    """SELECT c AS class, count(*) AS n FROM lg_edges, (VALUES ('termsOnly'), ('pagesOnly'), ('notTerms'), ('all')) v(c)
       WHERE c = 'all' OR (c = 'termsOnly') = (dst IN (SELECT term_uri FROM lg_terms)) GROUP BY c""",
)
def _(spark, d):
    edges = shop_graph(spark, d).edges
    names = ("termsOnly", "pagesOnly", "notTerms", "all")
    # one scan: each edge counts for every class it belongs to
    tests = {
        "termsOnly": F.col("kind") == "term",
        "pagesOnly": F.col("kind") == "page",
        "notTerms": F.col("kind") != "term",
        "all": F.lit(True),
    }
    kinds = F.array_compact(F.array(*[F.when(tests[n], F.lit(n)) for n in names]))
    return edges.select(F.explode(kinds).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


def _rel(test):
    return f"(src, dst) IN (SELECT (src, dst) FROM lg_relations WHERE {test})"


_HAS_TERM = "(list_contains(terms, 'Brand12') OR list_contains(terms, 'small'))"
register_edges(
    "pred_p18_subtype", "contains(dst, 's1.example') AND " + _rel("subtype = 'Cite'"),
    "cited", o="s1.example",
)
register_edges(
    "pred_p19_relation_terms_of_page",
    f"kind <> 'term' AND src IN (SELECT src FROM lg_relations WHERE {_HAS_TERM})",
    "linked", rt="Brand12,small",
)
register_edges(
    "pred_p20_subtype_and_terms", _rel(f"subtype = 'Bookmark' AND {_HAS_TERM}"), "bookmarked", rt="Brand12,small"
)


@check("pred_p19_relation_terms_of_link", f"SELECT src, dst FROM lg_edges WHERE {_rel(_HAS_TERM)}")
def _(spark, d):
    g = shop_graph(spark, d)
    found = matching_edges(g, spec("pages", "linked", rt="Brand12,small"), rt_scope="link")
    return found.select("src", "dst")


_LINKED = """SELECT src, dst, ts AS date FROM lg_edges JOIN lg_pages ON src = uri
             WHERE dst = 'https://lg.example/~/Brand12' AND {}"""
_A, _B = 757_382_400_000, 852_076_800_000  # 1994-01-01, 1997-01-01


def register_dates(name, sql, **options):
    @check(name, _LINKED.format(sql))
    def _(spark, d):
        found = linked_rows(shop_graph(spark, d), spec("pages", "thorped", o="Brand12", **options))
        return found.select("src", "dst", "date")


register_dates(
    "pred_p21_when", f"coalesce(post_date, ts) BETWEEN {_A} AND {_B}", when="between-1994-01-01-and-1997-01-01"
)
register_dates("pred_p22_created", f"lg_pages.created >= {_A}", created="after-1994-01-01")
register_dates("pred_p23_indexed", f"indexed <= {_B}", indexed="before-1997-01-01")


@check("pred_p26_not_banned", "SELECT origin FROM lg_origins WHERE verified AND NOT banned")
def _(spark, d):
    return listings.verified_origins(shop_graph(spark, d))


@check("pred_p27_without_internal_rings", "SELECT ring FROM lg_rings WHERE NOT contains(ring, '/n/1')")
def _(spark, d):
    return filters.without_text(shop_graph(spark, d).rings, "ring", ["/n/1"]).select("ring")


@check("pred_p28_without_own_pages", "SELECT uri FROM lg_pages WHERE NOT starts_with(uri, 'https://s1')")
def _(spark, d):
    return filters.without_own_pages(shop_graph(spark, d).pages, "https://s1").select("uri")


@check(
    "pred_p29_search_boxes",
    """SELECT uri, title FROM lg_pages WHERE contains(lower(uri), 'ring') OR contains(lower(title), 'ring')
       OR contains(lower(coalesce(description, '')), 'ring')""",
)
def _(spark, d):
    found = filters.search(shop_graph(spark, d).pages, "RING", "uri", "title", "description")
    return found.select("uri", "title")


@check("pred_p30_pages_of_domain", "SELECT uri FROM lg_pages WHERE contains(uri, 's1.example')")
def _(spark, d):
    return listings.pages_in_domain(shop_graph(spark, d), "https://s1.example").select("uri")


@check(
    "pred_p31_domain_pages_with_term",
    """SELECT DISTINCT uri AS id, title FROM lg_pages LEFT JOIN object_rows ON uri = id
       WHERE contains(uri, 'c7.example') AND (target = 'Brand12' OR contains(',' || terms || ',', ',Brand12,'))""",
)
def _(spark, d):
    found = listings.domain_annotations(shop_graph(spark, d), "c7.example")
    return listings.domain_pages_with(found, "Brand12")


_NEEDLES = """SELECT 'c' || c_custkey || '.' AS needle FROM customer WHERE c_custkey % 3 = 1
    UNION ALL SELECT 'o/' || c_custkey FROM customer WHERE c_custkey % 50 = 7"""


def _needles(spark, d):
    from linkloom.sources.shop_graph import read

    key = F.col("c_custkey").cast("string")
    customers = read(spark, d, "customer")
    sites = customers.filter("c_custkey % 3 = 1").select(F.concat(F.lit("c"), key, F.lit(".")).alias("needle"))
    return sites.unionByName(customers.filter("c_custkey % 50 = 7").select(F.concat(F.lit("o/"), key).alias("needle")))


@check(
    "pred_p02_needle_table",
    f"""WITH n AS MATERIALIZED ({_NEEDLES}), u AS MATERIALIZED (SELECT DISTINCT src FROM lg_edges),
        m AS MATERIALIZED (SELECT src FROM u WHERE EXISTS (SELECT 1 FROM n WHERE contains(src, needle)))
        SELECT src, dst FROM lg_edges WHERE src IN (SELECT src FROM m)""",
)
def _(spark, d):
    """Fuzzy subjects from a table that grows with the customers."""
    edges = shop_graph(spark, d).edges
    return filters.filter_by_needles(edges, include=_needles(spark, d), col="src").select("src", "dst")


@check(
    "pred_p15_needle_table",
    """WITH n AS MATERIALIZED (SELECT '/p/' || p_partkey AS needle FROM part WHERE p_partkey % 4 = 1
           UNION ALL SELECT 's' || s_suppkey || '.' FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT NULL),
        u AS MATERIALIZED (SELECT DISTINCT dst FROM lg_edges WHERE kind = 'page'),
        m AS MATERIALIZED (SELECT dst FROM u WHERE EXISTS (SELECT 1 FROM n WHERE contains(dst, needle)))
        SELECT src, dst FROM lg_edges WHERE kind = 'page' AND dst NOT IN (SELECT dst FROM m)""",
)
def _(spark, d):
    """Links to none of the pages that a table of parts and sites names."""
    from linkloom.sources.shop_graph import read

    parts = read(spark, d, "part").filter("p_partkey % 4 = 1").select(F.concat(F.lit("/p/"), F.col("p_partkey").cast("string")).alias("needle"))
    sites = read(spark, d, "supplier").filter("s_suppkey % 2 = 1").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".")).alias("needle")
    )
    needles = parts.unionByName(sites).unionByName(spark.range(1).select(F.lit(None).cast("string").alias("needle")))
    edges = shop_graph(spark, d).edges.filter("kind = 'page'")
    return filters.filter_by_needles(edges, exclude=needles).select("src", "dst")


# --- joins -----------------------------------------------------------------------


@check("join_j01_edge_with_time", "SELECT src, dst, ts FROM lg_edges")
def _(spark, d):
    return shop_graph(spark, d).edges.select("src", "dst", "ts")


_BOTH_ENDS = """SELECT e.src, e.dst, ts AS date, s.post_date, s.title, s.description, o.title AS o_title,
    o.description AS o_description FROM lg_edges e JOIN lg_pages s ON e.src = s.uri
    LEFT JOIN lg_pages o ON e.dst = o.uri WHERE {}"""
_BOTH_COLS = ("src", "dst", "date", "post_date", "title", "description", "o_title", "o_description")


@check(
    "join_j02_attributes_of_both_ends",
    "WITH p AS MATERIALIZED (SELECT uri, post_date, title, description FROM lg_pages) "
    + _BOTH_ENDS.format("kind <> 'term'").replace("lg_pages", "p"),
)
def _(spark, d):
    g = shop_graph(spark, d)
    s = spec("pages", "linked", s="example")
    return pages.attach_target(linked_rows(g, s), g, None).select(*_BOTH_COLS)


@check("join_j03_semi", "SELECT uri FROM lg_pages WHERE uri IN (SELECT dst FROM lg_edges)")
def _(spark, d):
    g = shop_graph(spark, d)
    return ingest.existing(g.pages, g.edges.select(F.col("dst").alias("uri")), ["uri"]).select("uri")


@check("join_j04_anti", "SELECT uri FROM lg_pages WHERE uri NOT IN (SELECT src FROM lg_edges)")
def _(spark, d):
    g = shop_graph(spark, d)
    return ingest.new_rows(g.pages, g.edges.select(F.col("src").alias("uri")), ["uri"]).select("uri")


@check(
    "join_j05_relation_of_edge",
    "SELECT e.src, e.dst, subtype FROM lg_edges e LEFT JOIN lg_relations r ON e.src = r.src AND e.dst = r.dst",
)
def _(spark, d):
    g = shop_graph(spark, d)
    return g.edges.join(g.relations, ["src", "dst"], "left").select("src", "dst", "subtype")


@check(
    "join_j06_ring_member_page",
    "SELECT ring, origin, page FROM lg_ring_members JOIN lg_origin_pages USING (origin)",
)
def _(spark, d):
    g = shop_graph(spark, d)
    return g.origin_pages.join(g.ring_members, "origin").select("ring", "origin", "page")


@check(
    "join_j07_literal_substrings",
    "SELECT src, dst FROM lg_edges WHERE contains(dst, '/p/1') OR contains(dst, '/p/2')",
)
def _(spark, d):
    edges = shop_graph(spark, d).edges
    return edges.filter(filters.contains_any(F.col("dst"), ["/p/1", "/p/2"])).select("src", "dst")


@check(
    "join_j08_term_usage",
    """SELECT dst AS term_uri, ts AS time, page, origin FROM lg_edges
       JOIN lg_origin_pages ON src = page WHERE kind = 'term'""",
)
def _(spark, d):
    return terms.term_usage(shop_graph(spark, d))


@check(
    "join_j09_assertions_of_origin",
    "SELECT uri, unnest(terms) AS term FROM lg_assertions WHERE source = 'https://d7.example'",
)
def _(spark, d):
    return listings.origin_bookmarks(shop_graph(spark, d), "https://d7.example/")


@check(
    "join_j10_mutual_mention",
    """WITH one AS MATERIALIZED (SELECT src, dst FROM page_edges),
            e AS MATERIALIZED (SELECT src, dst FROM one UNION ALL
                 SELECT dst, src FROM one WHERE src LIKE '%7'),
            turned AS MATERIALIZED (SELECT src || ' ' || dst AS pair FROM e)
       SELECT src, dst FROM e JOIN turned ON dst || ' ' || src = pair""",
)
def _(spark, d):
    from linkloom.operators.trust import mutual_links

    g = shop_graph(spark, d)
    links = g.edges.filter("kind = 'page'").select("src", "dst")
    back = links.filter(F.col("src").endswith("7")).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return mutual_links(links.unionByName(back))


@check(
    "join_j11_merge_by_pair",
    """SELECT e.src, e.dst, subtype, array_to_string(terms, ',') AS terms FROM page_edges e
       LEFT JOIN lg_relations r ON e.src = r.src AND e.dst = r.dst""",
)
def _(spark, d):
    from linkloom.operators.page_objects import relation_details

    g = shop_graph(spark, d)
    links = g.edges.filter("kind = 'page'").select("src", "dst")
    found = links.join(relation_details(g.relations), ["src", "dst"], "left")
    return found.select("src", "dst", "subtype", F.array_join("terms", ",").alias("terms"))


# --- listings of rows --------------------------------------------------------------

_PAGES_SQL = """
    WITH r AS ({rows}),
    seen AS (
      SELECT 'subject' AS role, src AS uri, title, description, date, -coalesce(post_date, date) AS age, src, dst, 0 AS k FROM r
      UNION ALL
      SELECT 'object', dst, o_title, o_description, NULL, -coalesce(post_date, date), src, dst, 1 FROM r)
    SELECT role, uri, title, description, date, CAST(NULL AS VARCHAR) AS image FROM (
      SELECT *, row_number() OVER (PARTITION BY uri ORDER BY age, src, dst, k) AS n FROM seen WHERE uri IS NOT NULL)
    WHERE n = 1"""


@check("win_n01_role_tagged_pages", _PAGES_SQL.format(rows=_BOTH_ENDS.format("kind <> 'term'")))
def _(spark, d):
    return get_pages(shop_graph(spark, d), spec("pages", "linked", s="example"))


_TOP = " ORDER BY coalesce(post_date, date) DESC NULLS LAST, src, dst LIMIT {} OFFSET {}"


@check(
    "get_g01_pages_by_term",
    _PAGES_SQL.format(
        rows="SELECT * FROM (" + _BOTH_ENDS.format("e.dst = 'https://lg.example/~/Brand12'") + ")" + _TOP.format(100, 0)
    ),
)
def _(spark, d):
    return get_pages(shop_graph(spark, d), QuerySpec.build("pages", "thorped", instance=INSTANCE, o="Brand12"))


@check(
    "get_g16_linkers_of_url",
    "SELECT DISTINCT src FROM lg_edges WHERE dst = 'https://s1.example/p/1'",
)
def _(spark, d):
    return pages.linkers(shop_graph(spark, d), "https://s1.example/p/1")


@check(
    "sort_o01_newest_rows",
    "SELECT src, dst, date FROM (" + _BOTH_ENDS.format("kind <> 'term'") + ")" + _TOP.format(50, 0),
)
def _(spark, d):
    found = edge_rows(shop_graph(spark, d), spec("pages", "linked", s="example", limit=50))
    return found.select("src", "dst", "date")


@check(
    "sort_o03_limit_offset",
    "SELECT src, dst, date FROM (" + _BOTH_ENDS.format("kind <> 'term'") + ")" + _TOP.format(20, 30),
)
def _(spark, d):
    found = edge_rows(shop_graph(spark, d), spec("pages", "linked", s="example", limit=20, offset=30))
    return found.select("src", "dst", "date")


_TERM_ROWS = """SELECT DISTINCT split_part(dst, '~/', 2) AS term, ts AS date FROM lg_edges
                WHERE kind = 'term' AND {}"""


@check("get_g03_terms", _TERM_ROWS.format("contains(src, 'c7')"))
def _(spark, d):
    return get_terms(shop_graph(spark, d), spec("thorpes", "thorped", s="c7"))


@check(
    "sort_o02_newest_terms",
    "SELECT term, date FROM (" + _TERM_ROWS.format("contains(src, 'c7')") + ") ORDER BY date DESC, term LIMIT 25",
)
def _(spark, d):
    return get_terms(shop_graph(spark, d), spec("thorpes", "thorped", s="c7", limit=25))


@check(
    "agg_a10_distinct_rows",
    "SELECT DISTINCT src, kind FROM lg_edges",
)
def _(spark, d):
    return shop_graph(spark, d).edges.select("src", "kind").distinct()


@check(
    "agg_a12_result_count",
    "SELECT count(*) AS results FROM lg_edges WHERE kind <> 'term'",
)
def _(spark, d):
    found = linked_rows(shop_graph(spark, d), spec("pages", "linked", s="example"))
    return listings.result_count(found)


@check(
    "get_qrun_saved_spec",
    "SELECT DISTINCT split_part(dst, '~/', 2) AS term, ts AS date FROM lg_edges WHERE contains(src, 'c9') AND kind = 'term'",
)
def _(spark, d):
    from linkloom.client import LinkGraph

    saved = spec("thorpes", "thorped", s="c9").to_json()
    return LinkGraph(shop_graph(spark, d)).run(saved)
