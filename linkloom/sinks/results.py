"""Query results as one JSON document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_results(rows: DataFrame, *order: Column) -> DataFrame:
    """``{"results": [...]}`` as one text column in document order, sorted by ``order`` and then by the row's text.

    Written with write.text, the parts put one after the other are the document. Equal rows share a line.
    """
    value = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    keyed = rows.select(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], value.alias("value")).alias("place"))
    counted = keyed.groupBy("place").agg(F.count("*").cast("int").alias("n"))
    first = counted.agg(F.min(F.struct("place", "n")).alias("first"))
    text, n = F.col("first.place.value"), F.col("first.n")
    more = F.repeat(F.concat(F.lit(","), text), n - 1)
    head = first.select(
        F.lit(0).alias("part"), F.col("first.place").alias("place"),
        F.concat(F.lit('{"results":['), F.coalesce(F.concat(text, more), F.lit(""))).alias("value"),
    )
    rest = counted.join(first.select("first.place"), "place", "left_anti").select(
        F.lit(1).alias("part"), "place", F.repeat(F.concat(F.lit(","), F.col("place.value")), F.col("n")).alias("value")
    )
    tail = first.select(F.lit(2).alias("part"), F.col("first.place").alias("place"), F.lit("]}").alias("value"))
    return head.unionByName(rest).unionByName(tail).orderBy("part", "place").select("value")
