"""Headline queries on stored graph tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from linkloom.client import LinkGraph
from linkloom.graph import Graph
from linkloom.operators import listings, rings, terms
from linkloom.operators.page_objects import relation_details
from linkloom.operators.store import clustered
from linkloom.session import configure
from linkloom.sources.html import harvest_html
from linkloom.sources.rules import RuleSets
from linkloom.sources.shop_graph import INSTANCE, read, requests, ring_links, shop_graph
from linkloom.streaming.admission import admit

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def stored(spark: SparkSession) -> Graph:
    """The sample graph written once as parquet tables, edges clustered both ways."""
    root = tempfile.mkdtemp(prefix="linkloom-bench-")
    graph = shop_graph(spark, FOLDER)
    tables = {}
    for name in Graph.table_names():
        df = graph.table(name)
        df = clustered(df, "src") if name in ("edges", "relations") else df
        df.write.parquet(f"{root}/{name}")
        tables[name] = spark.read.parquet(f"{root}/{name}")
    by_dst = clustered(graph.edges, "dst").sortWithinPartitions("dst")
    by_dst.write.parquet(f"{root}/edges_by_dst")
    return Graph(instance=INSTANCE, edges_by_dst=spark.read.parquet(f"{root}/edges_by_dst"), **tables)


def timed(make) -> float:
    started = time.time()
    make().write.format("noop").mode("overwrite").save()
    return round(time.time() - started, 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("linkloom-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    graph = stored(spark)
    client = LinkGraph(graph)
    links = ring_links(spark, FOLDER)
    no_members = graph.ring_members.limit(0)
    queries = {
        "warm_up": lambda: graph.edges.groupBy("kind").agg(F.count("*")),
        "g01_pages_by_term": lambda: client.get("pages", "thorped", o="Brand12"),
        "g01_pages_by_subject": lambda: client.get("pages", "linked", s="c7", limit="no-limit"),
        "g02_objects_by_term": lambda: client.get("everything", "thorped", o="Brand12"),
        "g02_objects_all": lambda: client.get("everything", "thorped", o="Brand12", limit="no-limit"),
        "g03_terms": lambda: client.get("thorpes", "thorped", s="c7"),
        "a03_term_rollup": lambda: terms.term_rollup(graph),
        "a07_relation_details": lambda: relation_details(graph.relations),
        "n01_pages_flattened": lambda: client.get("pages", "linked", s="example", limit="no-limit"),
        "g11_backlinks": lambda: listings.backlinks(graph),
        "h01_harvest": lambda: harvest_html(read(spark, FOLDER, "pages"), RuleSets(INSTANCE).schema()),
        "n02_ring_neighbours": lambda: rings.neighbours(graph.ring_members),
        "w16_ring_handshake": lambda: rings.handshakes(links, graph.rings, no_members),
        "t03_admission": lambda: admit(requests(spark, FOLDER), graph, limit=2, window_ms=86_400_000),
    }
    times = {name: timed(make) for name, make in queries.items()}
    times.pop("warm_up")
    print(
        json.dumps(
            {
                "metric": "link graph queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
