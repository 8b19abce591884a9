"""Input checks: forbidden characters, path traversal, bad schemes."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.urls import host, is_url, looks_like_url, origin, scheme, tidy_url

# --- fixed values: limits, patterns and messages ---------------------------------
MAX_INPUTS = 50
MAX_LENGTH = 512
FORBIDDEN = r"""["'<>\\{}]"""
TRAVERSAL = r"(?i)\.\./|\.\.\\|/\.\.|\\\.\.|\.\.%2f|%2e%2e%2f|%2e%2e/|\.\.%5c|%2e%2e%5c"
BAD_SCHEME = r"(?i)^(javascript|data|file|ftp):"
TOO_MANY = f"Exceeded maximum input count ({MAX_INPUTS})"
NOT_TEXT = "Input must be a string"
TOO_LONG = f"Input exceeds maximum length ({MAX_LENGTH})"
HAS_FORBIDDEN = 'Input contains dangerous characters (<>"{}\\)'
HAS_TRAVERSAL = "Path traversal attack pattern detected"
HAS_BAD_SCHEME = "Dangerous URL scheme detected. Why would you do that?"
PRIVATE_HOST = r"^(127\.|192\.168\.|10\.|172\.(1[6-9]|2[0-9]|3[0-1])\.)"
METADATA_HOST = "169.254.169.254"
# --- end of fixed values ---------------------------------------------------------


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def input_error(col: Column | str) -> Column:
    """Why a text is refused, NULL when it is safe."""
    text = F.trim(_c(col))
    return (
        F.when(text.isNull(), NOT_TEXT)
        .when(F.length(text) > MAX_LENGTH, TOO_LONG)
        .when(text.rlike(FORBIDDEN), HAS_FORBIDDEN)
        .when(text.rlike(TRAVERSAL), HAS_TRAVERSAL)
        .when(text.rlike(BAD_SCHEME), HAS_BAD_SCHEME)
    )


def input_check(col: Column | str) -> Column:
    error = input_error(col)
    return F.struct(error.isNull().alias("valid"), error.alias("error"))


def rule_set_url_is_safe(col: Column | str) -> Column:
    """https (http for localhost only), no private range, no metadata address."""
    name = host(col)
    secure = (scheme(col) == "https") | ((scheme(col) == "http") & (name == "localhost"))
    inside = (name != "localhost") & name.rlike(PRIVATE_HOST)
    return F.coalesce(secure & ~inside & (name != METADATA_HOST), F.lit(False))


def rule_set_allowed(
    rule_set: Column | str,
    requesting: Column | str,
    instance: str,
    allow_hosts: Sequence[str] = ("localhost",),
) -> Column:
    """A name, or a URL on the instance, the requester's origin or an allowed host."""
    name = host(rule_set)
    listed = F.lit(False)
    for allowed in allow_hosts:
        listed = listed | (name == allowed) | F.endswith(name, F.lit("." + allowed))
    own = origin(rule_set) == origin(F.lit(instance))
    same = origin(rule_set) == origin(requesting)
    readable = is_url(rule_set) & is_url(requesting)
    return F.when(~F.startswith(_c(rule_set), F.lit("http")), True).otherwise(
        F.coalesce(readable & (own | same | listed), F.lit(False))
    )


# --- driver side, for the few values of a query ----------------------------------


def check_inputs(values: Sequence[str]) -> None:
    if len(values) > MAX_INPUTS:
        raise ValueError(TOO_MANY)
    for value in values:
        if not isinstance(value, str):
            raise ValueError(NOT_TEXT)
        text = value.strip()
        if len(text) > MAX_LENGTH:
            raise ValueError(TOO_LONG)
        for pattern, message in (
            (FORBIDDEN, HAS_FORBIDDEN),
            (TRAVERSAL, HAS_TRAVERSAL),
            (BAD_SCHEME, HAS_BAD_SCHEME),
        ):
            if re.search(pattern, text):
                raise ValueError(message)


def clean_inputs(values: str | Sequence[str] | None, exact: bool = False) -> tuple[str, ...]:
    if not values:
        return ()
    items = [values] if isinstance(values, str) else list(values)
    check_inputs(items)
    return tuple(tidy_url(v) if exact else v for v in items)


def any_fuzzy(values: Sequence[str]) -> bool:
    """Is any of the values not an absolute URL."""
    return any(not looks_like_url(v) for v in values)
