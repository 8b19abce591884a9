"""Column functions over the URLs, texts and events of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from linkloom.functions import dates, safety, tags, text, urls
from linkloom.sources.shop_graph import INSTANCE, read, requests, shop_graph

# the URL text of the SQL side
_ORIGIN = """CASE WHEN {0} LIKE 'https://%' OR {0} LIKE 'http://%' THEN
    regexp_extract({0}, '^(https?)://', 1) || '://' ||
    regexp_replace(lower(regexp_extract({0}, '^https?://([^/?#]*)', 1)),
                   CASE WHEN {0} LIKE 'http://%' THEN ':80$' ELSE ':443$' END, '') END"""
_NORMAL = (
    "rtrim(" + _ORIGIN + """ || regexp_replace(
    regexp_extract({0}, '^https?://[^/?#]*([^?#]*)', 1), '/{{2,}}', '/', 'g'), '/')"""
)


def origin_sql(col: str) -> str:
    return _ORIGIN.format(col)


def normal_sql(col: str) -> str:
    return _NORMAL.format(col)


def pages(spark, d):
    return read(spark, d, "pages")


def events(spark, d):
    return read(spark, d, "events")


def documents(spark, d):
    return read(spark, d, "documents")


@check("fn_f01_deslash", "SELECT page_id, regexp_replace(coalesce(url, ''), '/$', '') AS v FROM pages")
def _(spark, d):
    return pages(spark, d).select("page_id", urls.deslash("url").alias("v"))


@check("fn_f02_cut_slashes", "SELECT page_id, rtrim(url || '//', '/') AS v FROM pages")
def _(spark, d):
    return pages(spark, d).select("page_id", urls.cut_slashes(F.concat("url", F.lit("//"))).alias("v"))


@check(
    "fn_f03_parse_uri",
    f"""SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme,
               {origin_sql('url')} AS origin, {normal_sql('url')} AS normalized FROM pages""",
)
def _(spark, d):
    return pages(spark, d).select("page_id", urls.parse_uri("url").alias("p")).select("page_id", "p.*")


@check(
    "fn_f03_ports_and_case",
    """SELECT event_id, 'https://u' || user_id || '.example' ||
              CASE event_id % 3 WHEN 0 THEN ':8080' ELSE '' END || '/' || event_type AS v FROM events""",
)
def _(spark, d):
    port = F.element_at(F.array(F.lit(":8080"), F.lit(":443"), F.lit("")), (F.col("event_id") % 3 + 1).cast("int"))
    uri = F.concat(
        F.lit("https://U"), F.col("user_id").cast("string"), F.lit(".Example"), port, F.lit("//"), "event_type",
        F.lit("/?q="), "props", F.lit("#x"),
    )
    return events(spark, d).select("event_id", urls.normalize(uri).alias("v"))


@check(
    "fn_f04_scheme",
    """SELECT page_id, nullif(regexp_extract(substr(url, page_id % 3 + 1), '^([a-z][a-z0-9+.-]*):', 1), '') AS v
       FROM pages""",
)
def _(spark, d):
    part = F.substring("url", (F.col("page_id") % 3 + 1).cast("int"), F.length("url"))
    return pages(spark, d).select("page_id", urls.scheme(part).alias("v"))


@check(
    "fn_f05_same_origin",
    "SELECT request_id, " + origin_sql("uri") + " = requesting_origin AS v FROM lg_requests",
)
def _(spark, d):
    return requests(spark, d).select("request_id", urls.same_origin("uri", "requesting_origin").alias("v"))


@check(
    "fn_f06_is_url",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS v
       FROM events""",
)
def _(spark, d):
    kinds = F.array(
        F.concat(F.lit("https://x.example/"), "event_type"),
        F.col("event_type"),
        F.concat(F.lit("mailto:"), "event_type"),
        F.concat(F.lit("https:// "), "event_type"),
    )
    value = F.element_at(kinds, (F.col("event_id") % 4 + 1).cast("int"))
    return events(spark, d).select("event_id", urls.is_url(value).alias("v"))


@check(
    "fn_f07_any_not_url",
    "SELECT page_id, page_id % 2 = 1 AS v FROM pages",
)
def _(spark, d):
    listed = F.when(F.col("page_id") % 2 == 1, F.array("url", F.lit("plain"))).otherwise(F.array("url"))
    return pages(spark, d).select("page_id", urls.any_not_url(listed).alias("v"))


_TITLE = "list_transform(w, lambda x: upper(x[1]) || substr(x, 2))"


@check(
    "fn_f08_tag_variations",
    f"""WITH t AS (SELECT p_partkey, trim(p_name) AS c, string_split(lower(trim(p_name)), ' ') AS w FROM part),
       f AS (SELECT p_partkey, unnest([c, lower(c), array_to_string(w, ' '), array_to_string(w, '_'),
             array_to_string({_TITLE}, '_'), array_to_string(w, '-'), array_to_string({_TITLE}, '-'),
             w[1] || array_to_string(list_transform(w[2:], lambda x: upper(x[1]) || substr(x, 2)), ''),
             array_to_string({_TITLE}, ''), array_to_string(w, ''),
             upper(array_to_string(w, '')[1]) || substr(array_to_string(w, ''), 2)]) AS v FROM t)
       SELECT DISTINCT p_partkey, v FROM f UNION SELECT p_partkey, '#' || v FROM f""",
)
def _(spark, d):
    return read(spark, d, "part").select("p_partkey", F.explode(tags.tag_variations("p_name")).alias("v"))


@check(
    "fn_f09_date_to_ms",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN epoch_us(ts) // 1000 WHEN 1 THEN epoch_us(date_trunc('day', ts)) // 1000 END
              AS v FROM events""",
)
def _(spark, d):
    forms = F.array(
        dates.ms("ts").cast("string"), F.date_format("ts", "yyyy-MM-dd"), F.concat(F.lit("no "), "event_type")
    )
    value = F.element_at(forms, (F.col("event_id") % 3 + 1).cast("int"))
    return events(spark, d).select("event_id", dates.parse_date_ms(value).alias("v"))


@check(
    "fn_f11_input_check",
    r"""SELECT doc_id, error IS NULL AS valid, error FROM (SELECT doc_id, CASE
          WHEN length(trim(text)) > 512 THEN 'Input exceeds maximum length (512)'
          WHEN regexp_matches(trim(text), '["''<>\\{}]') THEN 'Input contains dangerous characters (<>"{}\)'
          WHEN contains(trim(text), '../') OR contains(trim(text), '/..')
            OR contains(lower(trim(text)), '..%2f') OR contains(lower(trim(text)), '%2e%2e%2f')
            OR contains(lower(trim(text)), '%2e%2e/') OR contains(lower(trim(text)), '..%5c')
            OR contains(lower(trim(text)), '%2e%2e%5c') THEN 'Path traversal attack pattern detected'
          WHEN regexp_matches(lower(trim(text)), '^(javascript|data|file|ftp):')
            THEN 'Dangerous URL scheme detected. Why would you do that?' END AS error FROM documents)""",
)
def _(spark, d):
    return documents(spark, d).select("doc_id", safety.input_check("text").alias("c")).select("doc_id", "c.*")


@check(
    "fn_f13_term_name_uri",
    "SELECT term_uri, term AS name, 'https://lg.example/~/' || term AS again FROM lg_terms",
)
def _(spark, d):
    terms = shop_graph(spark, d).terms
    return terms.select(
        "term_uri", tags.term_name("term_uri").alias("name"), tags.term_uri("term", INSTANCE).alias("again")
    )


@check("fn_f14_strip_type_prefix", "SELECT event_id, event_type AS v FROM events")
def _(spark, d):
    typed = F.concat(F.lit(tags.TYPE_PREFIX), "event_type")
    return events(spark, d).select("event_id", tags.strip_type_prefix(typed).alias("v"))


@check(
    "fn_f15_format_date",
    """SELECT event_id, strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') AS rfc822,
              strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso8601, CAST(epoch_us(ts) // 1000 AS VARCHAR) AS unix FROM events""",
)
def _(spark, d):
    when = dates.ms("ts")
    return events(spark, d).select(
        "event_id", *[dates.format_date(when, s).alias(s) for s in ("rfc822", "iso8601", "unix")]
    )


_XML_SQL = """replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
              '"', '&quot;'), '''', '&apos;')"""


def xml_sql(col: str) -> str:
    return _XML_SQL.format(col)


@check("fn_f16_xml_encode", f"SELECT page_id, {xml_sql('html')} AS v FROM pages")
def _(spark, d):
    return pages(spark, d).select("page_id", text.xml_encode("html").alias("v"))


@check(
    "fn_f16_uri_encode",
    """SELECT doc_id, replace(replace(replace(replace(replace(url_encode(text), '%21', '!'), '%27', ''''),
              '%28', '('), '%29', ')'), '%2A', '*') AS v FROM documents""",
)
def _(spark, d):
    return documents(spark, d).select("doc_id", text.uri_encode("text").alias("v"))


@check("fn_f16_json_encode", "SELECT doc_id, CAST(to_json(text) AS VARCHAR) AS v FROM documents")
def _(spark, d):
    return documents(spark, d).select("doc_id", text.json_encode("text").alias("v"))


@check(
    "fn_f17_prefix_suffix_default",
    """SELECT uri, '<' || description || '>' AS wrapped, coalesce(nullif(description, ''), 'none') AS filled
       FROM lg_pages""",
)
def _(spark, d):
    from linkloom.sinks.projection import apply_steps

    p = shop_graph(spark, d).pages
    wrap = [{"method": "prefix", "params": "<"}, {"method": "suffix", "params": ">"}]
    fill = [{"method": "default", "params": "none"}]
    return p.select(
        "uri",
        apply_steps(F.col("description"), wrap).alias("wrapped"),
        apply_steps(F.col("description"), fill).alias("filled"),
    )


@check(
    "fn_f18_extract_tags",
    """SELECT doc_id, nullif(array_to_string(list_filter([trim(lang), trim(source)], lambda x: x <> ''), '|'), '') AS v
       FROM documents""",
)
def _(spark, d):
    raw = F.array(F.concat(F.lit(" "), "lang"), F.lit("  "), F.concat("source", F.lit(" ")))
    return documents(spark, d).select("doc_id", F.array_join(tags.extract_tags(raw), "|").alias("v"))


@check(
    "fn_f19_path_lookup",
    "SELECT event_id, json_extract_string(props, '$.k') AS v, CAST(NULL AS VARCHAR) AS missing FROM events",
)
def _(spark, d):
    from linkloom.sources.json_docs import path_values

    doc = F.try_parse_json("props")
    return events(spark, d).select(
        "event_id",
        F.try_element_at(path_values(doc, "k"), F.lit(1)).alias("v"),
        F.try_element_at(path_values(doc, "k.deep"), F.lit(1)).alias("missing"),
    )


@check(
    "fn_f20_first_path",
    "SELECT uri, coalesce(nullif(description, ''), nullif(title, ''), uri) AS v FROM lg_pages",
)
def _(spark, d):
    p = shop_graph(spark, d).pages
    return p.select("uri", text.first_non_blank("description", "title", "uri").alias("v"))


@check(
    "fn_f21_transform_chain",
    """SELECT uri, strftime(epoch_ms(post_date), '%Y-%m-%dT%H:%M:%S.%gZ') || '!' AS v FROM lg_pages""",
)
def _(spark, d):
    from linkloom.sinks.projection import apply_steps

    steps = [
        {"method": "date", "params": "iso8601"},
        {"method": "suffix", "params": "!"},
        {"method": "default", "params": "now"},
    ]
    p = shop_graph(spark, d).pages
    return p.select("uri", apply_steps(F.col("post_date"), steps).alias("v"))


@check(
    "fn_f22_first_url",
    "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'https://ref.example/' END AS v FROM pages",
)
def _(spark, d):
    explicit = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise("not a url")
    return pages(spark, d).select("page_id", urls.first_url(explicit, F.lit("https://ref.example/")).alias("v"))


@check(
    "fn_f23_graphemes",
    """SELECT doc_id, length_grapheme(text) AS n,
       CASE WHEN length_grapheme(text) <= 20 THEN text ELSE left_grapheme(text, 19) || '…' END AS cut FROM documents""",
)
def _(spark, d):
    return documents(spark, d).select(
        "doc_id", text.grapheme_count("text").alias("n"), text.truncate_graphemes("text", 20).alias("cut")
    )


@check(
    "fn_f24_valid_tag",
    r"""SELECT event_id, event_id % 2 = 0 AS v FROM events""",
)
def _(spark, d):
    tag = F.when(F.col("event_id") % 2 == 0, F.concat("event_type", F.lit("_é1"))).otherwise(
        F.concat("event_type", F.lit("-x"))
    )
    return events(spark, d).select("event_id", tags.is_valid_tag(tag).alias("v"))


@check(
    "fn_f25_byte_offset",
    """SELECT doc_id, CASE WHEN contains(text, ' ')
              THEN CAST(octet_length(encode(split_part(text, ' ', 1))) AS BIGINT) END AS v FROM documents""",
)
def _(spark, d):
    return documents(spark, d).select(
        "doc_id", text.byte_offset("text", F.lit(" ")).cast("bigint").alias("v")
    )


@check(
    "fn_f26_strip_protocol",
    "SELECT page_id, regexp_replace(url, '^https?://', '') AS v FROM pages",
)
def _(spark, d):
    return pages(spark, d).select("page_id", urls.strip_protocol("url").alias("v"))


@check(
    "fn_f27_loose_site_url",
    """SELECT page_id, 'https://' || regexp_replace(regexp_replace(url, '^https?://', ''), '/$', '') AS v
       FROM pages""",
)
def _(spark, d):
    typed = F.concat(F.lit("  "), urls.strip_protocol("url"), F.lit(" "))
    return pages(spark, d).select("page_id", urls.loose_site_url(typed).alias("v"))


@check(
    "fn_f28_display",
    """SELECT uri AS u, coalesce(title, uri) AS title, uri AS url,
              coalesce(strftime(epoch_ms(indexed), '%Y-%m-%d'), '') AS day FROM lg_pages""",
)
def _(spark, d):
    p = shop_graph(spark, d).pages
    none = F.lit(None).cast("string")
    return p.select(
        F.col("uri").alias("u"),
        text.display_title(F.col("title"), none, F.col("uri"), none).alias("title"),
        text.display_url(none, F.col("uri")).alias("url"),
        text.display_date("indexed").alias("day"),
    )


@check(
    "ingest_w25_subtype",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'Bookmark' WHEN 'view' THEN 'Cite'
              ELSE upper(event_type[1]) || substr(event_type, 2) END AS v FROM events""",
)
def _(spark, d):
    kind = (
        F.when(F.col("event_type") == "click", "bookmark")
        .when(F.col("event_type") == "view", "citation")
        .otherwise(F.col("event_type"))
    )
    return events(spark, d).select("event_id", tags.subtype(kind).alias("v"))


@check(
    "stream_t04_rule_set_allowed",
    """SELECT request_id, rule_set = 'default' OR request_id % 2 = 0 AS v FROM lg_requests""",
)
def _(spark, d):
    allow = ["good.example"]
    named = F.when(
        (F.col("rule_set") != "default") & (F.col("request_id") % 2 == 0), F.lit("https://a.good.example/s.json")
    ).otherwise(F.col("rule_set"))
    return requests(spark, d).select(
        "request_id", safety.rule_set_allowed(named, "requesting_origin", INSTANCE, allow).alias("v")
    )


@check(
    "stream_t05_rule_set_url_is_safe",
    """SELECT page_id, url LIKE 'https://%' AND page_id % 3 = 0 AS v FROM pages""",
)
def _(spark, d):
    inside = F.array(F.lit("https://10.0.0.1/x"), F.lit("https://169.254.169.254/"), F.lit("https://172.20.1.1/"))
    value = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(
        F.element_at(inside, (F.col("page_id") % 3 + 1).cast("int"))
    )
    return pages(spark, d).select("page_id", safety.rule_set_url_is_safe(value).alias("v"))
