"""Tables of saved specs: each row checked and turned back into the options it was built from."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.plans.spec import QuerySpec

OPTIONS = "error string, title string, what string, by string, options map<string, string>"


def spec_options(saved: str | None) -> tuple:
    """(error, title, what, by, options that are not empty) of one saved spec; lists are JSON."""
    if saved is None:
        return "spec: expected an object", None, None, None, None
    try:
        spec = QuerySpec.from_json(saved)
        what, by, options = spec.inverse()
    except ValueError as wrong:
        return str(wrong), None, None, None, None
    texts = {k: json.dumps(v, ensure_ascii=False) if isinstance(v, list) else v for k, v in options.items() if v}
    return None, spec.meta.title, what, by, texts


def with_options(df: DataFrame, col: str = "spec", out: str = "asked") -> DataFrame:
    """Add a struct of the first error of each saved spec (null: none), its title, and what, by and options."""

    @F.pandas_udf(OPTIONS)
    def read(saved: pd.Series) -> pd.DataFrame:
        found = [spec_options(text if isinstance(text, str) else None) for text in saved]
        return pd.DataFrame(found, columns=["error", "title", "what", "by", "options"], dtype=object)

    return df.withColumn(out, read(F.col(col)))
