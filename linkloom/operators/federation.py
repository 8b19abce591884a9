"""One term looked up on several graphs."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.graph import Graph
from linkloom.operators.terms import term_pages


def federated_term(
    servers: Mapping[str, Callable[[], Graph]], term: str, left_out: list[str] | None = None
) -> DataFrame:
    """Pages of a term on every server whose tables exist, with a ``server`` column.

    Names of servers without tables are appended to ``left_out``; any other fault is raised.
    """
    parts = []
    for name, load in servers.items():
        try:
            parts.append(term_pages(load(), term).withColumn("server", F.lit(name)))
        except AnalysisException as fault:
            if fault.getCondition() != "PATH_NOT_FOUND":
                raise
        except FileNotFoundError:
            pass
        else:
            continue
        if left_out is not None:
            left_out.append(name)
    if not parts:
        raise ValueError("No server could be read")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
