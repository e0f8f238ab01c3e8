"""Breadth-first searches as layered frontier joins: k hops, traversal with a budget, shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.plans.rank import numbered
from graphloom.plans.scratch import Scratch


def neighbours(edges: DataFrame) -> DataFrame:
    """Distinct undirected arcs ``x, y`` between different ids."""
    both = F.array(F.struct(F.col("source").alias("x"), F.col("target").alias("y")), F.struct(F.col("target").alias("x"), F.col("source").alias("y")))
    return edges.where("source <> target").select(F.explode(both).alias("a")).select("a.x", "a.y").distinct()


def k_hop(g: Graph, seeds: list[str], depth: int) -> DataFrame:
    """``id, hop, via``: everything within ``depth`` undirected steps of the seeds; via is the discoverer, the least of
    those one hop nearer ('' for seeds). A round joins only the last layer with the arcs."""
    spark = g.edges.sparkSession
    scratch = Scratch(spark, "hops")
    arcs, arcs_path = scratch.put(neighbours(g.edges), "arcs")
    start = spark.createDataFrame([(s,) for s in sorted(set(seeds))], "id string").join(g.nodes.select("id").distinct(), "id", "left_semi")
    reached, path = scratch.put(start.select("id", F.lit(0).alias("hop"), F.lit("").alias("via")), "reached")
    for hop in range(1, depth + 1):
        layer = reached.where(F.col("hop") == hop - 1).select(F.col("id").alias("x"))
        found = arcs.join(layer, "x").groupBy(F.col("y").alias("id")).agg(F.min("x").alias("via"))
        fresh = found.join(reached, "id", "left_anti").select("id", F.lit(hop).alias("hop"), "via")
        following, new = scratch.put(reached.unionByName(fresh), "reached")
        scratch.drop(path)
        reached, path = following, new
        if not reached.where(F.col("hop") == hop).limit(1).count():
            break
    scratch.drop(arcs_path)
    return reached


def traverse(g: Graph, start: str, depth: int = 2, limit: int = 50) -> DataFrame:
    """``hop, id, label``: at most ``limit`` nodes within ``depth`` steps, nearer ones first, then by label and id."""
    near = k_hop(g, [start], depth).join(g.nodes.select("id", "label"), "id")
    return near.orderBy("hop", "label", "id").limit(limit).select("hop", "id", "label")


def shortest_path(g: Graph, source: str, target: str) -> DataFrame:
    """``step, id`` of the shortest undirected path, the lexicographically least among equals; empty if there is none.

    Layers grow from the source until the target is met; each reached node keeps its least path. Only nodes of the last
    layer take part in a round.
    """
    spark = g.edges.sparkSession
    scratch = Scratch(spark, "path")
    arcs, _ = scratch.put(neighbours(g.edges), "arcs")
    layer = spark.createDataFrame([(source, [source])], "id string, path array<string>")
    if source == target:
        return layer.select(F.posexplode("path").alias("step", "id"))
    seen, _ = scratch.put(layer.select("id"), "seen")
    while True:
        grown = arcs.join(layer.withColumnRenamed("id", "x"), "x").groupBy(F.col("y").alias("id")).agg(F.min(F.concat("path", F.array("y"))).alias("path"))
        layer, _ = scratch.put(grown.join(seen, "id", "left_anti").select("id", "path"), "layer")
        hit = layer.where(F.col("id") == target)
        if hit.limit(1).count():
            return hit.select(F.posexplode("path").alias("step", "id"))
        if not layer.limit(1).count():
            break
        seen, _ = scratch.put(seen.unionByName(layer.select("id")), "seen")
    return layer.limit(0).select(F.lit(0).alias("step"), "id")


def bounded_levels(g: Graph, start: str, depth: int) -> DataFrame:
    """``hop, n``: number of nodes at every distance from ``start``."""
    return k_hop(g, [start], depth).groupBy("hop").agg(F.count(F.lit(1)).alias("n"))


def numbered_components(ids: DataFrame, roots: DataFrame) -> DataFrame:
    """``id, component``: components numbered by the least id of each. ``roots`` has id, root."""
    number = numbered(roots.select("root").distinct(), "root", "component")
    return ids.select("id").join(roots, "id").join(number, "root").select("id", "component")
