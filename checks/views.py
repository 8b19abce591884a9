"""The sample link graph as SQL views; only the ones a query names are put before it."""

from __future__ import annotations

import re

VIEWS = {
    "order_pages": """
        SELECT 'https://c' || o_custkey || '.example/o/' || o_orderkey AS uri,
               epoch_ms(o_orderdate) + 86400000 AS created,
               epoch_ms(o_orderdate) + 86400000 + (o_orderkey % 7) * 86400000 AS indexed,
               CASE WHEN o_orderstatus <> 'P' THEN epoch_ms(o_orderdate) END AS post_date,
               'Order ' || o_orderpriority AS title,
               CASE WHEN o_orderstatus <> 'P' THEN 'status ' || o_orderstatus END AS description,
               CAST(NULL AS VARCHAR) AS image, TRUE AS self_indexed
        FROM orders""",
    "part_pages": """
        SELECT 'https://s' || l_suppkey || '.example/p/' || l_partkey AS uri,
               created, CAST(NULL AS BIGINT) AS indexed, CAST(NULL AS BIGINT) AS post_date,
               p_name AS title, CAST(NULL AS VARCHAR) AS description,
               CAST(NULL AS VARCHAR) AS image, FALSE AS self_indexed
        FROM (SELECT l_suppkey, l_partkey, min(epoch_ms(l_shipdate)) AS created
              FROM lineitem GROUP BY l_suppkey, l_partkey) JOIN part ON l_partkey = p_partkey""",
    "lg_pages": """
        SELECT * FROM order_pages UNION ALL SELECT * FROM part_pages UNION ALL
        SELECT 'https://ring.example/n/' || n_nationkey, CAST(694224000000 AS BIGINT),
               CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), n_name, CAST(NULL AS VARCHAR),
               CAST(NULL AS VARCHAR), TRUE FROM nation""",
    "term_edges": """
        SELECT 'https://c' || o_custkey || '.example/o/' || o_orderkey AS src,
               'https://lg.example/~/' || replace(p_brand, '#', '') AS dst,
               'term' AS kind, min(epoch_ms(l_shipdate)) AS ts
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
        GROUP BY ALL""",
    "pairs": """
        SELECT 'https://c' || o_custkey || '.example/o/' || o_orderkey AS src,
               'https://s' || l_suppkey || '.example/p/' || l_partkey AS dst,
               l_partkey, min(epoch_ms(l_shipdate)) AS ts,
               min_by(l_returnflag, l_linenumber) AS flag,
               min_by(l_linestatus, l_linenumber) AS line
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        GROUP BY o_custkey, o_orderkey, l_suppkey, l_partkey""",
    "page_edges": "SELECT src, dst, 'page' AS kind, ts FROM pairs",
    "lg_edges": "SELECT * FROM term_edges UNION ALL SELECT * FROM page_edges",
    "lg_relations": """
        SELECT src, dst,
               CASE flag WHEN 'R' THEN 'Bookmark' WHEN 'A' THEN 'Cite' ELSE 'Link' END AS subtype,
               CASE WHEN line = 'O'
                    THEN list_sort(list_distinct([replace(p_brand, '#', ''), lower(p_type)]))
                    ELSE CAST([] AS VARCHAR[]) END AS terms,
               ts AS created
        FROM pairs JOIN part ON l_partkey = p_partkey""",
    "lg_terms": """
        SELECT dst AS term_uri, replace(dst, 'https://lg.example/~/', '') AS term,
               min(ts) AS created FROM term_edges GROUP BY dst""",
    "lg_origins": """
        SELECT 'https://c' || c_custkey || '.example' AS origin,
               c_acctbal > 0 AS verified, c_acctbal < -900 AS banned FROM customer
        UNION ALL SELECT 'https://s' || s_suppkey || '.example', TRUE, FALSE FROM supplier""",
    "lg_origin_pages": """
        SELECT regexp_extract(uri, '^https://[^/]+') AS origin, uri AS page FROM lg_pages""",
    "lg_rings": """
        SELECT 'https://ring.example/n/' || n_nationkey AS ring,
               CAST(694224000000 AS BIGINT) AS created FROM nation""",
    "lg_ring_links": """
        SELECT 'https://ring.example/n/' || c_nationkey AS src,
               'https://c' || c_custkey || '.example' AS dst FROM customer WHERE c_custkey % 2 = 0
        UNION ALL
        SELECT 'https://c' || c_custkey || '.example/o/' || o, 'https://ring.example/n/' || c_nationkey
        FROM customer JOIN (SELECT o_custkey, min(o_orderkey) AS o FROM orders GROUP BY 1)
             ON c_custkey = o_custkey WHERE c_custkey % 3 = 0""",
    "lg_ring_members": """
        SELECT 'https://ring.example/n/' || c_nationkey AS ring,
               'https://c' || c_custkey || '.example' AS origin
        FROM customer WHERE c_custkey % 6 = 0
          AND c_custkey IN (SELECT o_custkey FROM orders)""",
    "lg_endorsements": """
        SELECT 'https://s' || s_suppkey || '.example' AS src_origin,
               'https://s' || (s_suppkey + 1) || '.example' AS dst_origin
        FROM supplier WHERE s_suppkey % 5 <> 0""",
    "lg_assertions": """
        SELECT CAST(doc_id AS VARCHAR) AS id, 'https://d' || (doc_id % 50) || '.example' AS source,
               'https://doc.example/' || doc_id AS uri, substr(text, 1, 40) AS title,
               CAST(NULL AS VARCHAR) AS description, [lang, source] AS terms
        FROM documents""",
    "lg_requests": """
        SELECT event_id AS request_id, epoch_us(ts) // 1000 AS ts,
               'https://u' || user_id || '.example/' || event_type || '?k='
                   || json_extract_string(props, '$.k') AS uri,
               CASE WHEN event_id % 11 = 0 THEN 'https://u' || (user_id + 1) || '.example'
                    ELSE 'https://u' || user_id || '.example' END AS requesting_origin,
               CASE WHEN event_id % 13 = 0 THEN 'http://rules.example/set.json'
                    ELSE 'default' END AS rule_set,
               event_id % 17 <> 0 AS opted_in
        FROM events""",
    # one row per page with the scalars a page object shows
    "linked_heads": """
        SELECT src AS id, title, description, image, max(ts) AS date, post_date
        FROM lg_edges JOIN lg_pages ON src = uri GROUP BY ALL""",
    # one row per annotation of a page object
    "object_rows": """
        SELECT e.src AS id, CASE WHEN e.kind = 'term' THEN 'tag' ELSE 'link' END AS kind,
               CASE WHEN e.kind = 'term' THEN split_part(e.dst, '~/', 2) ELSE e.dst END AS target,
               r.subtype AS type, array_to_string(r.terms, ',') AS terms
        FROM lg_edges e LEFT JOIN lg_relations r ON e.src = r.src AND e.dst = r.dst""",
}


def with_views(body: str) -> str:
    """The body with the views it needs, in order, as common table expressions."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(VIEWS[name])

    visit(body)
    if not needed:
        return body
    parts = ", ".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in needed)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {parts}, {body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {parts}, {body[len('WITH'):]}"
    return f"WITH {parts} {body}"
