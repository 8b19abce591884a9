"""Content handlers: MIME type → mode → the harvest of that mode."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ----------------------------------------------------------------
MIME = {
    "html": ("text/html", "application/xhtml+xml"),
    "json": ("application/json", "application/ld+json", "application/feed+json"),
}
# --- end of fixed values ---------------------------------------------------------

Harvest = Callable[[DataFrame, Any], DataFrame]


class Handlers:
    def __init__(self):
        from linkloom.sources.html import harvest_html
        from linkloom.sources.json_docs import harvest_json

        self._modes: dict[str, tuple[tuple[str, ...], Harvest]] = {
            "html": (MIME["html"], harvest_html),
            "json": (MIME["json"], harvest_json),
        }
        self._builtin = frozenset(self._modes)

    def register(self, mode: str, content_types: Sequence[str], harvest: Harvest) -> None:
        if mode in self._builtin:
            raise ValueError(f"{mode}: a built-in handler cannot be replaced")
        if not mode or not content_types or not callable(harvest):
            raise ValueError("handler: a mode, content types and a harvest function are needed")
        self._modes[mode] = (tuple(content_types), harvest)

    def get(self, mode: str) -> Harvest | None:
        found = self._modes.get(mode)
        return found[1] if found else None

    def list(self) -> list[str]:
        return list(self._modes)

    def mode(self, content_type: Column | str, explicit: Column | str | None = None) -> Column:
        """The explicit mode if known, else by MIME type without parameters, else html."""
        mime = F.trim(F.substring_index(F.col(content_type) if isinstance(content_type, str) else content_type, ";", 1))
        by_mime = F.lit(None).cast("string")
        for name, (types, _) in self._modes.items():
            # a type claimed twice belongs to the handler registered last
            by_mime = F.when(mime.isin(list(types)), F.lit(name)).otherwise(by_mime)
        chosen = F.coalesce(by_mime, F.lit("html"))
        if explicit is None:
            return chosen
        asked = F.col(explicit) if isinstance(explicit, str) else explicit
        return F.coalesce(F.when(asked.isin(self.list()), asked), chosen)

    def harvest(self, docs: DataFrame, rule_sets: dict[str, Any], explicit: str | None = None) -> DataFrame:
        """(url, content_type, body) → harvested rows of every mode that has a rule set."""
        chosen = docs.withColumn("_mode", self.mode("content_type", explicit))
        parts = [
            self._modes[m][1](chosen.filter(F.col("_mode") == m).drop("_mode"), rules)
            for m, rules in rule_sets.items()
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out
