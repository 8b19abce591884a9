"""URI columns: normal form, origin, scheme and the small URL tests."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^([a-z][a-z0-9+.-]*):"
_SITE = "(?s)^https?://."
_USER = "^(https?://)[^@]*@"
_DEFAULT_PORT = "(?s)^(https://.*):443$|^(http://.*):80$"
_PATH = r"^https?://[^/?#]*([^?#]*)"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _blank_to_null(col: Column) -> Column:
    return F.when(col != "", col)


def deslash(col: Column | str) -> Column:
    """Cut one trailing slash, also before a last line end; NULL becomes the empty string."""
    text = F.coalesce(_c(col), F.lit(""))
    ends = F.substring(text, -1, 1).isin("/", "\n", "\r", "\u0085", "\u2028", "\u2029")
    return F.when(ends, F.regexp_replace(text, "/$", "")).otherwise(text)


def cut_slashes(col: Column | str) -> Column:
    """Cut every trailing slash."""
    return F.rtrim(_c(col), F.lit("/"))


def scheme(col: Column | str) -> Column:
    """Lower-case scheme of a URI, NULL when there is none."""
    return _blank_to_null(F.regexp_extract(_c(col), _SCHEME, 1))


def _is_http(col: Column) -> Column:
    """Is the scheme http or https: it ends at the first colon, so two prefixes tell."""
    return F.startswith(col, F.lit("https:")) | F.startswith(col, F.lit("http:"))


def _site(uri: Column) -> Column:
    """http(s):// and lower-case host and port, without user and default port; NULL for other forms or no host.

    Plain cuts, as this runs for every page and link; only a host with an @ or a colon takes the patterns.
    The URI stands here few times: Spark pushes filters to where a URI is put together, copies it to
    each of these places and computes every copy.
    """
    head = F.substring_index(uri, "/", 3)
    for mark in "?#":
        head = F.substring_index(head, mark, 1)
    bare = F.regexp_replace(F.regexp_replace(head, _USER, "$1"), _DEFAULT_PORT, "$1$2")
    marked = F.contains(head, F.lit("@")) | (F.locate(":", head, 7) > 0)
    http = F.startswith(uri, F.lit("https://")) | F.startswith(uri, F.lit("http://"))
    return F.when(marked, F.when(bare.rlike(_SITE), F.lower(bare))).when(
        http & ~head.isin("https://", "http://"), F.lower(head)
    )


def host_port(col: Column | str) -> Column:
    """Lower-case host with its port, without the scheme's default port."""
    return F.substring_index(_site(_c(col)), "//", -1)


def host(col: Column | str) -> Column:
    return F.regexp_replace(host_port(col), r":\d+$", "")


def origin(col: Column | str) -> Column:
    """Origin of a URI: scheme and host for http(s), the DID for at://, else the URI."""
    uri = _c(col)
    return (
        F.when(_is_http(uri), _site(uri))
        .when(F.startswith(uri, F.lit("at:")), _blank_to_null(F.regexp_extract(uri, "^at://([^/]+)", 1)))
        .when(uri.rlike(_SCHEME), uri)
    )


def normalize(col: Column | str) -> Column:
    """Page identity: query and fragment dropped, doubled and trailing slashes cut."""
    uri = _c(col)
    path = F.regexp_replace(F.regexp_extract(uri, _PATH, 1), "/{2,}", "/")
    return (
        F.when(_is_http(uri), F.rtrim(F.concat(origin(uri), path), F.lit("/")))
        .when(scheme(uri) == "at", F.when(origin(uri).isNotNull(), uri))
        .when(scheme(uri).isNotNull(), uri)
    )


def parse_uri(col: Column | str) -> Column:
    return F.struct(
        scheme(col).alias("scheme"), origin(col).alias("origin"), normalize(col).alias("normalized")
    )


def same_origin(uri: Column | str, requesting: Column | str) -> Column:
    """True when both share an origin; other schemes are not compared."""
    return F.when(
        _is_http(_c(uri)), F.coalesce(origin(uri) == origin(requesting), F.lit(False))
    ).otherwise(True)


def is_url(col: Column | str) -> Column:
    """Is the text an absolute URL (http forms also need a host)."""
    text = F.trim(_c(col))
    return F.coalesce(
        text.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
        & (~text.rlike("^(?i)https?:") | text.rlike(r"^(?i)https?:/*[^/?#\s]+([/?#]|$)")),
        F.lit(False),
    )


def any_not_url(array: Column | str) -> Column:
    return F.exists(_c(array), lambda x: ~is_url(x))


def first_url(*candidates: Column | str) -> Column:
    """First candidate that is an absolute URL."""
    return F.coalesce(*[F.when(is_url(c), _c(c)) for c in candidates])


def strip_protocol(col: Column | str) -> Column:
    return F.regexp_replace(_c(col), "^https?://", "")


def loose_site_url(col: Column | str) -> Column:
    """A hand-typed site address: blanks dropped, https added, one slash cut."""
    text = _blank_to_null(_c(col))
    packed = F.regexp_replace(text, r"\s", "")
    full = F.when(packed.rlike("^https?://"), packed).otherwise(F.concat(F.lit("https://"), packed))
    return F.regexp_replace(full, "/$", "")


# --- driver side, for the few values of a query ----------------------------------


def looks_like_url(text: object) -> bool:
    if not isinstance(text, str):
        return False
    text = text.strip()
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", text):
        return False
    if re.match(r"(?i)https?:", text):
        return re.match(r"(?i)https?:/*[^/?#\s]+([/?#]|$)", text) is not None
    return True


def tidy_url(text: str) -> str:
    """Query-side URL normal form; https unless http:// is written out."""
    text = text.strip()
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", text):
        text = "https://" + text.lstrip("/")
    parts = urlsplit(text)
    if parts.scheme not in ("http", "https"):
        return text
    netloc = parts.netloc.rsplit("@", 1)[-1].lower()
    netloc = re.sub(":80$" if parts.scheme == "http" else ":443$", "", netloc)
    path = re.sub("/{2,}", "/", parts.path).rstrip("/")
    tail = f"?{parts.query}" if parts.query else ""
    tail += f"#{parts.fragment}" if parts.fragment else ""
    return f"{parts.scheme}://{netloc}{path}{tail}"
