"""What several operators of this folder share.

Every operator reads `doc_id` and `text` by name and returns only its own columns, so further columns of the
input never clash with them. A null text counts as the empty text and a null id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.session import stored  # noqa: F401  (the operators of this folder take it from here)

#: fixed values: the white space of every contract, as a Java character class
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def doc_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def one_space(text: Column) -> Column:
    """The text with each run of white space replaced by one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def same_key(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Equality on the named columns where null equals null."""
    cond = F.lit(True)
    for name in names:
        cond = cond & left[name].eqNullSafe(right[name])
    return cond


def batches(rows: Iterator[dict[str, list]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for columns in rows:
        yield pa.RecordBatch.from_pydict(columns, schema=schema)
