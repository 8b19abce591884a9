"""Link-graph analytics over web pages, on Spark DataFrames."""

from linkloom.graph import Graph
from linkloom.client import LinkGraph
from linkloom.session import configure

__all__ = ["Graph", "LinkGraph", "configure"]
