"""Filters and transforms a rule applies to the values it found."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def keep_values(values: Column, test: Mapping[str, Any], get=lambda v: v) -> Column:
    """regex, contains, exclude, startsWith, endsWith; an unknown method keeps all."""
    method, params = test["method"], test.get("params")
    if method == "regex":
        return F.filter(values, lambda v: get(v).rlike(params))
    if method == "contains":
        return F.filter(values, lambda v: get(v).contains(params))
    if method == "exclude":
        return F.filter(values, lambda v: ~get(v).contains(params))
    if method == "startsWith":
        return F.filter(values, lambda v: F.startswith(get(v), F.lit(params)))
    if method == "endsWith":
        return F.filter(values, lambda v: F.endswith(get(v), F.lit(params)))
    return values


def _split(value: Column, params: str) -> Column:
    # the separator is plain text
    return F.split(value, r"\Q" + params + r"\E") if params else F.split(value, "")


def processed(value: Column, step: Mapping[str, Any]) -> Column:
    """One value → array of values: regex, substring, split or trim; empties dropped."""
    method, params = step["method"], step.get("params")
    if method == "regex":
        # without a match, or with an empty group, nothing is left
        out = F.array(F.regexp_extract(value, params, 1))
    elif method == "substring":
        start, end = sorted(max(int(p), 0) for p in params)
        out = F.array(F.substring(value, start + 1, end - start))
    elif method == "split":
        return _split(value, params)
    elif method == "trim":
        out = F.array(F.regexp_replace(value, r"^\s+|\s+$", ""))
    else:
        out = F.array(value)
    return F.filter(out, lambda v: v != "")


def process_values(values: Column, step: Mapping[str, Any]) -> Column:
    return F.flatten(F.transform(values, lambda v: processed(v, step)))
