"""The graph tables and their schemas."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "pages": "uri string, created bigint, indexed bigint, post_date bigint, title string, "
    "description string, image string, self_indexed boolean",
    "terms": "term_uri string, term string, created bigint",
    "term_usage": "term_uri string, used bigint",
    "edges": "src string, dst string, kind string, ts bigint",
    "relations": "src string, dst string, subtype string, terms array<string>, created bigint",
    "origins": "origin string, verified boolean, banned boolean",
    "origin_pages": "origin string, page string",
    "rings": "ring string, created bigint",
    "ring_members": "ring string, origin string",
    "endorsements": "src_origin string, dst_origin string",
    "assertions": "id string, source string, uri string, title string, description string, "
    "terms array<string>, created bigint",
}

# the columns that identify a row of each latest view
KEYS = {
    "pages": ["uri"],
    "terms": ["term_uri"],
    "edges": ["src", "dst"],
    "relations": ["src", "dst"],
    "origins": ["origin"],
    "origin_pages": ["origin", "page"],
    "rings": ["ring"],
    "ring_members": ["ring", "origin"],
    "endorsements": ["src_origin", "dst_origin"],
    "assertions": ["id"],
}


@dataclass(frozen=True)
class Graph:
    """One DataFrame per table; ``edges_by_dst`` may name a copy clustered by target."""

    instance: str
    pages: DataFrame
    terms: DataFrame
    term_usage: DataFrame
    edges: DataFrame
    relations: DataFrame
    origins: DataFrame
    origin_pages: DataFrame
    rings: DataFrame
    ring_members: DataFrame
    endorsements: DataFrame
    assertions: DataFrame
    edges_by_dst: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @property
    def inbound(self) -> DataFrame:
        """Edges for lookups by target."""
        return self.edges if self.edges_by_dst is None else self.edges_by_dst

    def with_tables(self, **tables: DataFrame) -> Graph:
        return replace(self, **tables)

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    @classmethod
    def empty(cls, spark: SparkSession, instance: str) -> Graph:
        tables = {n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()}
        return cls(instance=instance, **tables)

    @staticmethod
    def table_names() -> list[str]:
        skip = {"instance", "edges_by_dst"}
        return [f.name for f in fields(Graph) if f.name not in skip]
