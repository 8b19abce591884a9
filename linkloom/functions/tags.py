"""Tag names, term URIs and the spelling variations used by fuzzy matching."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.vocabulary import SUBTYPES, TERM_PATH, TYPE_PREFIX


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def term_name(uri: Column | str) -> Column:
    return F.substring_index(_c(uri), TERM_PATH, -1)


def term_uri(name: Column | str, instance: str) -> Column:
    return F.concat(F.lit(instance + TERM_PATH), _c(name))


def strip_type_prefix(col: Column | str) -> Column:
    return F.regexp_replace(_c(col), f"^{TYPE_PREFIX}", "")


def _capital(col: Column) -> Column:
    return F.concat(F.upper(F.substring(col, 1, 1)), F.substring(col, F.lit(2), F.length(col)))


def subtype(col: Column | str) -> Column:
    """Subtype label of a link section; unknown sections get a capital first letter."""
    kind = _c(col)
    named = F.lit(None).cast("string")
    for label in sorted(set(SUBTYPES.values())):
        keys = [k for k, v in SUBTYPES.items() if v == label]
        named = F.coalesce(named, F.when(kind.isin(keys), F.lit(label)))
    return F.coalesce(named, _capital(kind))


def is_valid_tag(col: Column | str) -> Column:
    """Letters, numbers and underscores only."""
    return _c(col).rlike(r"^[\p{L}\p{N}_]+$")


def extract_tags(tags: Column | str) -> Column:
    """Trimmed non-empty tags, NULL when none is left."""
    kept = F.filter(F.transform(_c(tags), lambda t: F.trim(t)), lambda t: t != "")
    return F.when(F.size(kept) > 0, kept)


def split_terms(col: Column | str) -> Column:
    """Comma list of an attribute → trimmed, non-empty terms."""
    parts = F.transform(F.split(_c(col), ","), lambda t: F.trim(t))
    return F.filter(parts, lambda t: t != "")


def tag_variations(col: Column | str) -> Column:
    """Every spelling fuzzy matching accepts for a tag, each also with a leading #."""
    clean = F.trim(F.regexp_replace(_c(col), "^#", ""))
    words = F.filter(F.split(F.lower(clean), r"\s+"), lambda w: w != "")
    title = F.transform(words, _capital)
    joined = F.array_join(words, "")
    camel = F.concat(
        F.element_at(words, 1), F.array_join(F.slice(title, 2, F.greatest(F.size(title), F.lit(1))), "")
    )
    forms = F.array(
        clean,
        F.lower(clean),
        F.array_join(words, " "),
        F.array_join(words, "_"),
        F.array_join(title, "_"),
        F.array_join(words, "-"),
        F.array_join(title, "-"),
        camel,
        F.array_join(title, ""),
        joined,
        _capital(joined),
    )
    hashed = F.transform(forms, lambda f: F.concat(F.lit("#"), f))
    return F.when(clean != "", F.array_distinct(F.concat(forms, hashed))).otherwise(
        F.array().cast("array<string>")
    )


# --- driver side, for the few values of a query ----------------------------------


def fuzzy_tags(tags: str | Iterable[str]) -> list[str]:
    """The same variations for the values of a query, in a stable order."""
    if isinstance(tags, str):
        tags = [tags]
    found: dict[str, None] = {}
    for tag in tags:
        if not isinstance(tag, str):
            continue
        clean = tag.removeprefix("#").strip()
        if not clean:
            continue
        words = clean.lower().split()
        title = [w[0].upper() + w[1:] for w in words]
        joined = "".join(words)
        forms = [clean, clean.lower()]
        forms += [sep.join(words) for sep in (" ", "_", "-", "")]
        forms += [sep.join(title) for sep in ("_", "-", "")]
        forms += [words[0] + "".join(title[1:]), joined[0].upper() + joined[1:]]
        for form in forms + ["#" + f for f in forms]:
            found.setdefault(form)
    return list(found)
