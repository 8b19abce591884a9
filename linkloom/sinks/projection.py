"""Declarative projections: a schema dict becomes a select."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions import safety
from linkloom.functions.dates import format_date
from linkloom.functions.tags import extract_tags
from linkloom.functions.text import json_encode, uri_encode, xml_encode

MAX_META_BYTES = 4096
_ENCODERS = {"xml": xml_encode, "uri": uri_encode, "json": json_encode}


def apply_steps(value: Column, steps: Mapping[str, Any] | Sequence[Mapping[str, Any]]) -> Column:
    """Fold the steps over a column. A step that gives NULL ends the chain; a first ``default`` replaces NULL."""
    for number, step in enumerate([steps] if isinstance(steps, Mapping) else steps):
        method, params = step["method"], step.get("params")
        if method == "date":
            value = format_date(value, params or "iso8601")
        elif method == "encode":
            value = _ENCODERS.get(params or "xml", lambda c: c.cast("string"))(value)
        elif method == "prefix":
            value = F.concat(F.lit(params), value.cast("string"))
        elif method == "suffix":
            value = F.concat(value.cast("string"), F.lit(params))
        elif method == "default":
            empty = value.cast("string") == ""
            empty = empty | value.isNull() if number == 0 else empty
            value = F.when(empty, F.lit(params)).otherwise(value)
        elif method == "extractTags":
            value = extract_tags(value)
    return value


def _type_at(schema: T.StructType, path: str) -> T.DataType | None:
    found: T.DataType = schema
    for name in path.split("."):
        if isinstance(found, T.MapType):
            found = found.valueType
        elif isinstance(found, T.StructType) and name in found.names:
            found = found[name].dataType
        else:
            return None
    return found


def _present(df: DataFrame, path: str) -> Column | None:
    """The column at a dotted path, NULL where it is the empty text; None if unknown."""
    kind = _type_at(df.schema, path)
    if kind is None:
        return None
    col = F.col(path)
    if isinstance(kind, T.ArrayType):
        return F.when(F.size(col) > 0, col)
    return F.when(col != "", col) if isinstance(kind, T.StringType) else col


def _source(df: DataFrame, paths: str | Sequence[str]) -> Column | None:
    listed = [paths] if isinstance(paths, str) else list(paths)
    found = [c for c in (_present(df, p) for p in listed) if c is not None]
    return F.coalesce(*found) if found else None


def field_column(df: DataFrame, rule: Mapping[str, Any], now_ms: Column) -> Column:
    if "value" in rule:
        value = now_ms if rule["value"] == "now" else F.lit(rule["value"])
    else:
        value = _source(df, rule["from"])
        if value is None:  # the rows have no such column
            steps = rule.get("postProcess") or []
            steps = [steps] if isinstance(steps, Mapping) else steps
            listed = any(s["method"] == "extractTags" for s in steps)
            return F.lit(None).cast("array<string>" if listed else "string")
    return apply_steps(value, rule["postProcess"]) if rule.get("postProcess") else value


def project(df: DataFrame, schema: Mapping[str, Mapping[str, Any]], now_ms: int | None = None) -> DataFrame:
    """Select the schema's fields; a row lacking a required one is dropped."""
    now = F.unix_millis(F.current_timestamp()) if now_ms is None else F.lit(now_ms)
    out = df.select(*[field_column(df, rule, now).alias(name) for name, rule in schema.items()])
    for name, rule in schema.items():
        if rule.get("required"):
            out = out.filter(F.col(name).isNotNull() & (F.col(name).cast("string") != ""))
    return out


def resolver_error(resolver: Any) -> str | None:
    """First thing wrong with a publisher schema document, None when it is usable."""
    if not isinstance(resolver, Mapping):
        return "resolver: expected an object"
    for name in ("@context", "@id"):
        if not resolver.get(name):
            return f"{name}: missing"
    if not isinstance(resolver.get("schema"), Mapping):
        return "schema: expected an object"
    meta = resolver.get("meta") or {}
    texts = {"@context": resolver["@context"], "@id": resolver["@id"]}
    if len(json.dumps(meta, separators=(",", ":"), ensure_ascii=False)) > MAX_META_BYTES:
        return f"Meta exceeds size limit ({MAX_META_BYTES} bytes)"
    texts.update({f"meta.{k}": v for k, v in meta.items() if isinstance(v, str)})
    for label, value in texts.items():
        try:
            safety.check_inputs([value])
        except ValueError as e:
            return f"{label}: {e}"
    return None


def load_resolver(source: str | Mapping[str, Any]) -> Mapping[str, Any]:
    if isinstance(source, str):
        try:
            source = json.loads(source)
        except json.JSONDecodeError as e:
            raise ValueError(f"Invalid JSON: {e}") from None
    error = resolver_error(source)
    if error:
        raise ValueError(error)
    return source
