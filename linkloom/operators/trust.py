"""Verification, endorsement and registration of origins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.urls import cut_slashes, origin
from linkloom.graph import Graph
from linkloom.session import ensure_checkpoint_dir


def mutual_links(links: DataFrame) -> DataFrame:
    """Links whose target links back."""
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return links.join(back, ["src", "dst"], "left_semi")


def approved(df: DataFrame, graph: Graph, col: str = "origin") -> DataFrame:
    """Rows whose origin is verified."""
    verified = graph.origins.filter("verified").select(F.col("origin").alias(col))
    return df.join(verified, col, "left_semi")


def flag(df: DataFrame, found: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add a boolean column telling whether the keys occur in the other table."""
    marked = found.select(*keys).distinct().withColumn(name, F.lit(True))
    return df.join(marked, keys, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def endorsed(pairs: DataFrame, graph: Graph, mentions_count: bool = True, ring: bool = False) -> DataFrame:
    """(src, dst) → is the link endorsed by its target.

    Same origin, or the target's origin endorses the source's (the source page itself
    for a ring), or, where mentions count, the target links back.
    """
    source: Column = F.col("src") if ring else origin("src")
    df = pairs.select("src", "dst", source.alias("dst_origin"), origin("dst").alias("src_origin"))
    df = flag(df, graph.endorsements, ["src_origin", "dst_origin"], "by_origin")
    told = (F.col("src_origin") == F.col("dst_origin")) | F.col("by_origin")
    if mentions_count and not ring:
        back = graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        df = flag(df, back, ["src", "dst"], "mutual")
        told = told | F.col("mutual")
    return df.select("src", "dst", told.alias("endorsed"))


def registration_status(df: DataFrame, graph: Graph, col: str = "domain") -> DataFrame:
    """banned, verified or pending for each submitted domain."""
    known = graph.origins.select(F.col("origin").alias("_origin"), "verified", "banned")
    joined = df.join(known, cut_slashes(col) == F.col("_origin"), "left")
    status = F.when(F.coalesce("banned", F.lit(False)), "banned").when(
        F.coalesce("verified", F.lit(False)), "verified"
    )
    return joined.select(*df.columns, F.coalesce(status, F.lit("pending")).alias("status"))


def trusted_origins(graph: Graph, checkpoint_every: int = 5) -> DataFrame:
    """Origins reached along endorsements from verified origins, with the hop count.

    One join per hop on the newly found origins only. Lineage is cut with a reliable
    checkpoint, so a lost executor never forces all hops to be redone. The loop ends
    when a hop finds nothing new; no depth is assumed.
    """
    spark = graph.spark
    ensure_checkpoint_dir(spark)
    links = graph.endorsements.select("src_origin", "dst_origin").distinct()
    found = graph.origins.filter("verified").select("origin", F.lit(0).alias("hops"))
    frontier, hop = found, 0
    while True:
        hop += 1
        step = (
            links.join(frontier, F.col("src_origin") == F.col("origin"), "left_semi")
            .select(F.col("dst_origin").alias("origin"))
            .distinct()
            .join(found, "origin", "left_anti")
            .withColumn("hops", F.lit(hop))
        )
        frontier = step.checkpoint()
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)
        if hop % checkpoint_every == 0:
            found = found.checkpoint()
