"""Safety lint over a table of submitted rule sets, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.sources.patterns import first_reason

# --- fixed values: limits and patterns --------------------------------------------
MAX_BYTES = 56 * 1024
MAX_SELECTOR = 200
MAX_COMBINATORS = 10
MAX_RULES = 50
COMBINATOR = r"[>+~\s]+"
UNSAFE_SELECTOR = r"(?i):has\(|\(\s*\)|\*{2,}|\[[^\]]{100,}\]"
NESTED_QUANTIFIER = r"(\(.+\)\+|\(.+\)\*){2,}"
# --- end of fixed values -----------------------------------------------------------

_SHAPE = (
    "title string, schema map<string, struct<o: array<struct<selector: string, "
    "postProcess: struct<method: string, params: string>>>>>"
)


def selector_error(selector: Column) -> Column:
    return (
        F.when(F.length(selector) > MAX_SELECTOR, "selector too long")
        .when(F.size(F.regexp_extract_all(selector, F.lit(COMBINATOR), F.lit(0))) > MAX_COMBINATORS, "selector too deep")
        .when(selector.rlike(UNSAFE_SELECTOR), "selector has a forbidden pattern")
    )


def lint(df: DataFrame, col: str = "rule_set") -> DataFrame:
    """Add ``reason``: the first thing wrong with each rule set, NULL when it is safe.

    A rule's pattern must compile and must not take exponential time, see `patterns`.
    """
    parsed = df.withColumn("_set", F.from_json(F.col(col), _SHAPE))
    sections = F.map_values("_set.schema")
    rules = F.flatten(F.transform(sections, lambda s: F.coalesce(s["o"], F.array().cast("array<struct<selector:string,postProcess:struct<method:string,params:string>>>"))))
    bad = F.try_element_at(
        F.filter(F.transform(rules, lambda r: selector_error(r["selector"])), lambda e: e.isNotNull()), F.lit(1)
    )
    crowded = F.exists(sections, lambda s: F.size(s["o"]) > MAX_RULES)
    nested = F.exists(
        rules,
        lambda r: (r["postProcess"]["method"] == "regex") & r["postProcess"]["params"].rlike(NESTED_QUANTIFIER),
    )
    reason = (
        F.when(F.octet_length(col) > MAX_BYTES, "too large")
        .when(F.col("_set").isNull() | ~F.coalesce(F.trim(col).rlike(r"^\{"), F.lit(False)), "not a JSON object")
        .when(F.coalesce("_set.title", F.lit("")) == "", "no title")
        .when(F.col("_set.schema").isNull(), "no schema")
        .when(crowded, "too many rules")
        .when(bad.isNotNull(), bad)
        .when(nested, "regex has nested quantifiers")
        .otherwise(F.col("_pattern"))
    )
    patterns = F.transform(F.filter(rules, lambda r: r["postProcess"]["method"] == "regex"), lambda r: r["postProcess"]["params"])
    parsed = parsed.withColumn("_pattern", first_reason(patterns))
    return parsed.withColumn("reason", reason).drop("_set", "_pattern")
