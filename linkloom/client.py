"""LinkGraph: one entry point over a graph, its rule sets, handlers and publishers."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame

from linkloom import vocabulary as V
from linkloom.graph import Graph
from linkloom.operators.listings import get_domains
from linkloom.operators.page_objects import assemble, get_objects
from linkloom.operators.pages import get_pages
from linkloom.operators.terms import get_terms
from linkloom.plans.spec import QuerySpec
from linkloom.session import configure

RANGE_OPTIONS = ("when", "created", "indexed")


def run(graph: Graph, spec: QuerySpec, what: str | None = None, rt_scope: str = "page") -> DataFrame:
    """The DataFrame of a spec; nothing runs until it is used."""
    what = what or spec.what_by()[0]
    if what in V.RUNNABLE_LINK_WHAT:
        return get_pages(graph, spec, rt_scope)
    if what in V.OBJECT_WHAT:
        return get_objects(graph, spec, rt_scope)
    if what in V.TERM_WHAT:
        return get_terms(graph, spec)
    if what == "domains":
        return get_domains(graph, spec)
    raise ValueError("Invalid route.")


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


class LinkGraph:
    def __init__(self, graph: Graph, rules=None, handlers=None, publishers=None):
        from linkloom.sinks.registry import Publishers
        from linkloom.sources.handlers import Handlers
        from linkloom.sources.rules import RuleSets

        configure(graph.spark)
        self.graph = graph
        self.rules = rules or RuleSets(graph.instance)
        self.handlers = handlers or Handlers()
        self.publishers = publishers or Publishers(graph.instance)

    def spec(self, what: str, by: str, **options: Any) -> QuerySpec:
        return QuerySpec.build(what, by, instance=self.graph.instance, **options)

    def get(self, what: str, by: str, *, as_: str | None = None, rt_scope: str = "page", **options: Any):
        """Rows of a query; ``as_`` asks for the spec, its plan or a publisher's output."""
        spec = self.spec(what, by, **options)
        rows = run(self.graph, spec, what, rt_scope)
        if as_ == V.AS_SPEC:
            return {"spec": spec.to_dict(), "query": plan_text(rows)}
        if as_ == V.AS_DEBUG:
            return {"spec": spec.to_dict(), "query": plan_text(rows), "results": rows}
        if as_:
            return self.publish(rows, as_, spec)
        return rows

    def run(self, saved: str | dict | QuerySpec) -> DataFrame:
        """Run a saved spec, given as JSON text, a dict or a QuerySpec."""
        if isinstance(saved, str):
            saved = QuerySpec.from_json(saved)
        elif isinstance(saved, dict):
            saved = QuerySpec.from_dict(saved)
        return run(self.graph, saved)

    def explain_spec(self, what: str, by: str, **options: Any) -> str:
        found = self.get(what, by, as_=V.AS_SPEC, **options)
        return json.dumps(found["spec"], indent=2) + "\n" + found["query"]

    def publish(self, rows: DataFrame, name: str, spec: QuerySpec | None = None) -> DataFrame:
        """Map rows with a registered publisher; page objects are nested first."""
        publisher = self.publishers.get(name)
        if publisher is None:
            raise ValueError(f"Unknown publisher: {name}")
        items = assemble(rows) if "kind" in rows.columns else rows
        channel = None
        if spec is not None:
            channel = {"title": spec.meta.title, "description": spec.meta.description}
        return publisher.publish(items, channel)

    def prepare(self, rows: DataFrame, name: str, protocol: str | None = None) -> DataFrame:
        """Records for a target protocol, with collection and content type columns; page objects are nested first."""
        return self.publishers.prepare(assemble(rows) if "kind" in rows.columns else rows, name, protocol)
