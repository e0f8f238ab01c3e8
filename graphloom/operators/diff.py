"""Differences between snapshots: graphs, file manifests, and the gate over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import NODE_FIELDS, Graph


def diff_nodes(old: Graph, new: Graph) -> DataFrame:
    """``id, change``: nodes added, removed, or changed in any of their fields."""
    a = old.nodes.select("id", F.struct(*NODE_FIELDS[1:]).alias("_a"))
    b = new.nodes.select("id", F.struct(*NODE_FIELDS[1:]).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, "id", "full").select("id", change.alias("change")).where("change is not null")


def diff_edges(old: Graph, new: Graph) -> DataFrame:
    """``source, target, relation, change``: edges added or removed; confidence is no difference."""
    k = ["source", "target", "relation"]
    a, b = old.edges.select(*k).distinct().withColumn("_a", F.lit(1)), new.edges.select(*k).distinct().withColumn("_b", F.lit(1))
    joined = a.join(b, k, "full").where("_a is null or _b is null")
    return joined.select(*k, F.when(F.col("_a").isNull(), "added").otherwise("removed").alias("change"))


def diff_manifests(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, change`` of two manifests (path, sha256): added, removed or modified content."""
    a, b = old.select("path", F.col("sha256").alias("_a"), F.lit(1).alias("_ia")), new.select("path", F.col("sha256").alias("_b"), F.lit(1).alias("_ib"))
    change = F.when(F.col("_ia").isNull(), "added").when(F.col("_ib").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return a.join(b, "path", "full").select("path", change.alias("change")).where("change is not null")


def summary(old: Graph, new: Graph, limit: int | None = None) -> str:
    """The change as a Markdown text: counts, then a section per kind of change that occurs, in the order of ids.

    A text is one driver string by definition; ``limit`` lines a section (None: all) keep a large change readable.
    """
    n, e = diff_nodes(old, new), diff_edges(old, new)
    counts = {(r.kind, r.change): r["count"] for r in n.select(F.lit("nodes").alias("kind"), "change").unionByName(e.select(F.lit("edges").alias("kind"), "change")).groupBy("kind", "change").count().collect()}
    total = lambda kind, change: counts.get((kind, change), 0)
    lines = ["# Graph diff", "", f"- {total('nodes', 'added')} nodes added, {total('nodes', 'removed')} removed, {total('nodes', 'changed')} changed"]
    lines.append(f"- {total('edges', 'added')} edges added, {total('edges', 'removed')} removed")
    fields = ("label", "community", "filetype")
    a, b = (g.nodes.select("id", *(F.col(f).alias(f"{p}_{f}") for f in fields)) for p, g in (("a", old), ("b", new)))
    rows = n.join(a, "id", "left").join(b, "id", "left")
    cut_ = lambda df: df if limit is None else df.limit(limit)

    def named(r, p: str) -> str:
        return f"- {r[f'{p}_label'] or r['id']} ({r['id']})"

    def moved(r) -> str:
        words = {"label": "label", "community": "community", "filetype": "type"}
        return f"- {r['id']}: " + " ".join(f'{w} "{r[f"a_{f}"]}"→"{r[f"b_{f}"]}"' for f, w in words.items() if r[f"a_{f}"] != r[f"b_{f}"])

    for change, line in (("added", lambda r: named(r, "b")), ("removed", lambda r: named(r, "a")), ("changed", moved)):
        if total("nodes", change):
            lines += ["", f"## Nodes {change}", *(line(r) for r in cut_(rows.where(F.col("change") == change).orderBy("id")).collect())]
    for change in ("added", "removed"):
        if total("edges", change):
            found = cut_(e.where(F.col("change") == change).orderBy("source", "target", "relation")).collect()
            lines += ["", f"## Edges {change}", *(f"- {r.source} --{r.relation}--> {r.target}" for r in found)]
    return "\n".join(lines) + "\n"


def gate(old: Graph, new: Graph, max_added: int = -1, max_removed: int = -1, max_ambiguous: int = -1) -> DataFrame:
    """One row with the counts of a change and whether each stays within its limit (-1: no limit)."""
    n, e = diff_nodes(old, new), diff_edges(old, new)
    ambiguous = new.edges.where("confidence = 2").join(e.where("change = 'added'"), ["source", "target", "relation"], "left_semi")
    counted = (
        n.select(F.concat(F.lit("nodes_"), "change").alias("what"))
        .unionByName(e.select(F.concat(F.lit("edges_"), "change").alias("what")))
        .unionByName(ambiguous.select(F.lit("new_ambiguous").alias("what")))
    )
    names = ("nodes_added", "nodes_removed", "nodes_changed", "edges_added", "edges_removed", "new_ambiguous")
    row = counted.agg(*(F.count_if(F.col("what") == x).alias(x) for x in names))
    within = lambda c, limit: F.lit(True) if limit < 0 else F.col(c) <= limit
    return row.withColumn("passed", within("nodes_added", max_added) & within("nodes_removed", max_removed) & within("new_ambiguous", max_ambiguous))
