"""Consolidating pairwise matches into groups.

The link graph is reduced before it is solved. Every round strips vertices of degree one onto their neighbour and
compresses chains of degree-two vertices by list ranking (pointer doubling over arcs), replacing a chain by one edge
between its ends. What no longer shrinks, the core, is solved by alternating stars. Labels then return to the removed
vertices in reverse order of their removal, and every group takes its smallest id.

All steps are joins and aggregates keyed by vertex pairs or aggregated before their shuffle; joins keyed by a vertex are
salted for vertices with a large share of the rows. Each generation is written to the shared folder.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.operators.components import arcs, star_roots
from graphloom.plans.scratch import Scratch
from graphloom.plans.skew import crowded_keys, salted_join

#: The core begins where a round removes less than this share of the edges: stripping goes on only while it is geometric. A strip
#: of triangles, say, loses one vertex a round and would take as many rounds as it is long; the stars take the logarithm.
WORTHWHILE = 0.05
#: Jumps over one stored generation of pointers.
JUMPS = 3


def links(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct undirected links ``u < v`` of pairs of different, non-null ids."""
    a, b = F.col(left), F.col(right)
    return pairs.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def _hop(state: DataFrame, table: DataFrame) -> DataFrame:
    """Every pointer of ``state`` moved on by the pointer ``table`` holds for the arc it points at."""
    t = table.select(F.col("p").alias("tp"), F.col("x").alias("tx"), F.col("q").alias("tq"), F.col("y").alias("ty"), F.col("low").alias("tlow"))
    joined = state.join(t, (F.col("q") == F.col("tp")) & (F.col("y") == F.col("tx")), "left")
    inside = F.col("tp").isNotNull()
    return joined.select(
        "p", "x", F.when(inside, F.col("tq")).otherwise(F.col("q")).alias("q"), F.when(inside, F.col("ty")).otherwise(F.col("y")).alias("y"),
        F.least("low", "tlow").alias("low"), inside.alias("open"), "old",
    )


def _rank_chains(degree: DataFrame, scratch: Scratch) -> DataFrame:
    """``x, e1, e2, low`` per degree-two vertex: the ends of its chain, or (e1 null) the least id of its pure cycle.

    An arc (p, x) enters x from p and points at the arc it jumps to. A jump replaces the pointer by the target's
    pointer; a pointer that names no arc has left the chain, and its second half is the chain's end. Three jumps over
    one stored generation quadruple the reach, so the rounds are the logarithm, to base four, of the longest chain. Chains close
    from their ends on, so a round that closes none and lowers nothing has cycles alone left.
    """
    arc = lambda p, n: F.struct(F.col(p).alias("p"), F.col("x"), F.col("x").alias("q"), F.col(n).alias("y"), F.col("x").alias("low"))
    state = degree.where("d = 2").select(F.explode(F.array(arc("a", "b"), arc("b", "a"))).alias("s")).select("s.*")
    path, before = None, None
    while True:
        step = state.withColumn("old", F.col("low"))
        for _ in range(JUMPS):
            step = _hop(step, state)
        seen = Observation()
        step = step.observe(seen, F.count_if("open").alias("open"), F.count_if(F.col("low") != F.col("old")).alias("moved")).drop("old")
        state, new = scratch.put(step, "arcs")
        scratch.drop(path)
        path, now = new, seen.get
        if not now["open"] or (before is not None and now["open"] == before and not now["moved"]):
            break
        before = now["open"]
    end = F.when(~F.col("open"), F.col("y"))
    return state.groupBy("x").agg(F.min(end).alias("e1"), F.max(end).alias("e2"), F.min("low").alias("low"))


def _resolve(forest: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """``x, root``: the top of every vertex's path in a forest ``x, root`` of at most ``depth`` steps, by pointer jumping."""
    reach = 1
    current, path = scratch.put(forest, "labels")
    while reach < depth:
        step, heavy = current, crowded_keys(current, "root")
        up = current.select(F.col("x").alias("root"), F.col("root").alias("up"))
        for _ in range(JUMPS):
            step = salted_join(step, up, "root", heavy, F.col("x"), "left").select("x", F.coalesce("up", "root").alias("root"))
        current, new = scratch.put(step, "labels")
        scratch.drop(path)
        path, reach = new, reach * (JUMPS + 1)
    return current


def components(edges: DataFrame) -> DataFrame:
    """``node_id, group_id`` for every vertex of ``edges`` (u < v, distinct); group_id is the smallest id of the group.

    Ids compare byte by byte. An empty input gives an empty result. Vertices without links do not appear.
    """
    scratch = Scratch(edges.sparkSession, "components")
    seen = Observation()
    current, current_path = scratch.put(edges.select("u", "v").observe(seen, F.count(F.lit(1)).alias("n")), "edges")
    size = seen.get["n"]
    forest: list[DataFrame] = []
    while size:
        degree, degree_path = scratch.put(
            arcs(current).groupBy("x").agg(F.count(F.lit(1)).alias("d"), F.min("y").alias("a"), F.max("y").alias("b")).where("d <= 2"), "degree"
        )
        ranked = _rank_chains(degree, scratch)
        # A leaf on a chain stays as the chain's end. Keys are single vertices of degree <= 2, met at most twice.
        leaves = degree.where("d = 1").select("x", F.col("a").alias("parent"))
        chained = degree.where("d = 2").select(F.explode(F.array("a", "b")).alias("x")).distinct()
        free = leaves.join(chained, "x", "left_anti")
        twin = free.select(F.col("x").alias("_px"), F.col("parent").alias("_pp"))
        free = free.join(twin, (free.x == twin._pp) & (free.parent == twin._px), "left").where("_px is null or x > parent").select("x", "parent")
        none = F.lit(None).cast("string")
        removed, _ = scratch.put(
            free.select("x", F.col("parent").alias("root"), none.alias("e1"), none.alias("e2"))
            .unionByName(ranked.select("x", F.coalesce("e1", "low").alias("root"), "e1", "e2")),
            "removed",
        )
        forest.append(removed.where("x <> root").select("x", "root"))
        pair = lambda a, b: F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
        gone = removed.where("e1 is null and x <> root").select(pair("x", "root").alias("e")).unionByName(
            degree.where("d = 2").select(F.explode(F.array(pair("x", "a"), pair("x", "b"))).alias("e"))
        )
        bridged = removed.where("e1 <> e2").select(F.col("e1").alias("u"), F.col("e2").alias("v"))
        left = current.join(gone.select("e.u", "e.v"), ["u", "v"], "left_anti").unionByName(bridged).distinct()
        seen = Observation()
        following, following_path = scratch.put(left.observe(seen, F.count(F.lit(1)).alias("n")), "edges")
        for p in (current_path, degree_path):
            scratch.drop(p)
        before, size = size, seen.get["n"]
        current, current_path = following, following_path
        if before - size < WORTHWHILE * before:
            break

    if size:
        forest.append(star_roots(current, scratch).select("x", "root"))
    elif not forest:
        return current.select(F.col("u").alias("node_id"), F.col("v").alias("group_id"))
    labels = _resolve(functools.reduce(DataFrame.unionByName, forest), len(forest), scratch)
    least = labels.groupBy("root").agg(F.least(F.min("x"), F.col("root")).alias("group_id"))
    members = labels.unionByName(least.select(F.col("root").alias("x"), "root"))
    return salted_join(members, least, "root", crowded_keys(labels, "root"), F.col("x")).select(F.col("x").alias("node_id"), "group_id")


def node_groups(nodes: DataFrame, pairs: DataFrame, min_score: float = 92.0) -> DataFrame:
    """``id, label, group_id`` for every distinct (id, label) of ``nodes``; unlinked nodes are a group of their own."""
    grouped = components(links(pairs.where(F.col("score") >= min_score), "left_id", "right_id"))
    return (
        nodes.select("id", "label").where("id is not null").distinct()
        .join(grouped.withColumnRenamed("node_id", "id"), "id", "left")
        .select("id", "label", F.coalesce("group_id", "id").alias("group_id"))
    )
