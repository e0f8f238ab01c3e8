"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.scratch import Scratch
from graphloom.plans.skew import crowded_keys, salted_join


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct links ``u < v`` of different, non-null, non-empty ends."""
    x, y = F.col(a), F.col(b)
    return edges.where((x != "") & (y != "") & (x != y)).select(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")).distinct()


def arcs(edges: DataFrame) -> DataFrame:
    """Both directions ``x, y`` of every link."""
    both = F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))
    return edges.select(F.explode(both).alias("a")).select("a.x", "a.y")


def star_roots(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``x, root`` for every vertex of ``edges`` (u < v) but the roots themselves; a root is its component's least id.

    Large star: every vertex hands its larger neighbours to the least vertex it knows; small star: it does so with its
    smaller ones. The least neighbour is aggregated before its shuffle; joins back to the arcs are salted for vertices
    with a large share of them. Every generation is written to the shared folder. Logarithmically many rounds.
    """
    scratch = scratch or Scratch(edges.sparkSession, "stars")
    current, path = edges, None
    while True:
        both, both_path = scratch.put(arcs(current), "arcs")
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = salted_join(both, least, "x", crowded_keys(both, "x"), F.col("y")).where("y > x and m <> y")
        large, large_path = scratch.put(large.select(F.col("m").alias("u"), F.col("y").alias("v")).distinct(), "large")
        down = large.select(F.col("v").alias("x"), F.col("u").alias("y"))
        first = down.groupBy("x").agg(F.min("y").alias("m"))
        small = salted_join(down, first, "x", crowded_keys(down, "x"), F.col("y"))
        pair = F.array(F.struct(F.col("m").alias("u"), F.col("y").alias("v")), F.struct(F.col("m").alias("u"), F.col("x").alias("v")))
        small = small.select(F.explode(pair).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        small, new = scratch.put(small, "small")
        # Done when every vertex has one parent and no parent has one itself: the stars no longer touch.
        ends = small.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(0).alias("up")), F.struct(F.col("v").alias("x"), F.lit(1).alias("up")))).alias("e")).select("e.x", "e.up")
        held = ends.groupBy("x").agg(F.sum("up").alias("parents"), F.min("up").alias("least"))
        done = held.where("parents > 1 or (parents = 1 and least = 0)").isEmpty()
        for p in (both_path, large_path, path):
            scratch.drop(p)
        current, path = small, new
        if done:
            return current.select(F.col("v").alias("x"), F.col("u").alias("root"))


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, root`` for every distinct vertex id; unlinked vertices are their own root. ``edges`` has u < v."""
    roots = star_roots(edges)
    all_ids = vertices.select("id").where("id is not null").union(edges.select("u")).union(edges.select("v")).distinct()
    return all_ids.join(roots.withColumnRenamed("x", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
