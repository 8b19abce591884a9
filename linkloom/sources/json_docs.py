"""Harvest of JSON documents with dotted-path rules, as VARIANT expressions."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.sources.values import keep_values, process_values

NO_VALUES = "array<string>"


def _json_path(path: str) -> str:
    return "$" + "".join(f"['{part}']" for part in path.split("."))


def path_values(doc: Column, path: str) -> Column:
    """Texts at a dotted path of a VARIANT; an array gives one text per element."""
    where = _json_path(path)
    listed = F.try_variant_get(doc, where, "array<string>")
    single = F.try_variant_get(doc, where, "string")
    # a missing path and a JSON null both give no value
    values = F.coalesce(listed, F.when(single.isNotNull(), F.array(single)))
    return F.coalesce(values, F.array().cast(NO_VALUES))


def rule_values(doc: Column, rules: Any) -> Column:
    """Values of one rule; a list of rules is a fallback chain."""
    if isinstance(rules, (list, tuple)):
        found = F.array().cast(NO_VALUES)
        for rule in reversed(rules):
            values = rule_values(doc, rule)
            found = F.when(F.size(values) > 0, values).otherwise(found)
        return found
    if isinstance(rules, str):
        rules = {"path": rules}
    if not isinstance(rules, Mapping) or not rules.get("path"):
        return F.array().cast(NO_VALUES)
    values = path_values(doc, rules["path"])
    if rules.get("filterResults"):
        values = keep_values(values, rules["filterResults"])
    if rules.get("postProcess"):
        values = process_values(values, rules["postProcess"])
    return values


def _typed(found: Column, section: str) -> Column:
    no_terms = F.lit(None).cast(NO_VALUES)
    return F.transform(
        found, lambda v: F.struct(F.lit(section).alias("type"), v.alias("uri"), no_terms.alias("terms"))
    )


def harvest_json(docs: DataFrame, schema: Mapping[str, Any], url: str = "url", body: str = "body") -> DataFrame:
    """(url, body) → id, subject texts, tags and typed links."""
    schema = schema.get("schema", schema)
    subject = schema.get("subject", {})
    read = docs.withColumn("_doc", F.try_parse_json(F.col(body)))
    doc = F.col("_doc")
    ids = rule_values(doc, subject.get("s")) if subject.get("s") else F.array().cast(NO_VALUES)
    columns = [
        F.col(url).alias("url"),
        F.coalesce(F.try_element_at(ids, F.lit(1)), F.lit("source")).alias("id"),
    ]
    for prop, rules in subject.items():
        if prop != "s":
            values = rule_values(doc, rules)
            columns.append(F.when(F.size(values) > 0, F.array_join(values, ", ")).alias(prop))
    tags = F.array().cast(NO_VALUES)
    links = F.array().cast("array<struct<type:string,uri:string,terms:array<string>>>")
    for section, rules in schema.items():
        if section == "subject":
            continue
        found = rule_values(doc, rules.get("o", rules) if isinstance(rules, Mapping) else rules)
        if section == "hashtag":
            tags = found
        else:
            links = F.concat(links, _typed(found, section))
    return read.select(*columns, tags.alias("tags"), links.alias("links"))
