"""Text columns used when publishing: encoding, graphemes, byte offsets, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.dates import format_date

_XML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))
# characters encodeURIComponent leaves alone but form encoding escapes
_URI_PLAIN = (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~"))


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def xml_encode(col: Column | str) -> Column:
    out = _c(col).cast("string")
    for plain, entity in _XML:
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def uri_encode(col: Column | str) -> Column:
    out = F.url_encode(_c(col).cast("string"))
    for escaped, plain in _URI_PLAIN:
        out = F.replace(out, F.lit(escaped), F.lit(plain))
    return out


def json_encode(col: Column | str) -> Column:
    text = _c(col).cast("string")
    wrapped = F.to_json(F.struct(text.alias("v")))
    # {"v":"..."} → "..."
    return F.when(text.isNotNull(), F.substring(wrapped, F.lit(6), F.length(wrapped) - 6))


def non_blank(col: Column | str) -> Column:
    return F.when(_c(col).cast("string") != "", _c(col))


def first_non_blank(*cols: Column | str) -> Column:
    return F.coalesce(*[non_blank(c) for c in cols])


def graphemes(col: Column | str) -> Column:
    return F.regexp_extract_all(_c(col), F.lit(r"\X"), F.lit(0))


def grapheme_count(col: Column | str) -> Column:
    return F.size(graphemes(col))


def truncate_graphemes(col: Column | str, limit: Column | int) -> Column:
    """At most ``limit`` graphemes; a cut text ends in an ellipsis."""
    bound = F.lit(limit) if isinstance(limit, int) else limit
    parts = graphemes(col)
    keep = F.greatest(bound - 1, F.lit(0))
    cut = F.concat(F.array_join(F.slice(parts, F.lit(1), keep), ""), F.lit("…"))
    return F.when(F.size(parts) <= bound, _c(col)).otherwise(cut)


def byte_offset(text: Column | str, part: Column | str) -> Column:
    """UTF-8 offset of the first occurrence of ``part``, NULL when absent."""
    at = F.position(_c(part), _c(text))
    before = F.substring(_c(text), F.lit(1), F.greatest(at - 1, F.lit(0)))
    return F.when(at > 0, F.octet_length(before))


def display_title(title: Column, page_id: Column, uri: Column, term: Column) -> Column:
    return F.coalesce(first_non_blank(title, page_id, uri, term), F.lit("Untitled"))


def display_url(page_id: Column, uri: Column) -> Column:
    return F.coalesce(first_non_blank(page_id, uri), F.lit("#"))


def display_date(value: Column | str) -> Column:
    """Day text of an epoch-millisecond column, '' when there is none."""
    day = F.substring(format_date(value), 1, 10)
    return F.coalesce(F.when(_c(value) != 0, day), F.lit(""))
