"""Entity resolution of graph nodes: exact labels, fuzzy labels, components, winners, rewritten edges.

The fuzzy pass finds all pairs with enough common shingles by an inverted join over rare shingles first (prefix
filtering, exact), and runs Jaro-Winkler on the survivors only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalar import display_label, entropy, jaro_winkler, merge_bucket, normalize_label, shingles, winner_score
from graphloom.model import EDGE_FIELDS, Graph
from graphloom.operators.build import attach, first_per_key
from graphloom.operators.components import star_roots, undirected
from graphloom.plans.scratch import cut

MIN_ENTROPY = 2.5
MIN_SIMILARITY = 0.7
MIN_MATCH = 92.0
DOUBT_FROM = 75.0
COMMUNITY_BONUS = 5.0
#: Rows of rare grams in a task, and the side of the blocks in which they are compared.
ROWS_A_TASK, BLOCK = 50_000, 512


def exact_links(nodes: DataFrame) -> DataFrame:
    """``u < v`` between every node and the least of its equals: same bucket, same normalised label, not empty."""
    keyed = nodes.select("id", merge_bucket().alias("b"), normalize_label(display_label()).alias("n")).where("n <> ''")
    first = keyed.groupBy("b", "n").agg(F.min("id").alias("u"))
    return keyed.join(first, ["b", "n"]).where("id <> u").select("u", F.col("id").alias("v")).distinct()


def _alike(nodes: DataFrame, similarity: str) -> tuple[DataFrame, DataFrame]:
    """Informative labels ``b, n, id, community`` (the least id of each) and the alike ones among them: ``b, x, y``, x < y.

    Grams are ordered by rarity; alike sets share one of their rarest. Sizes, 128-bit signatures (every bit in which they
    differ is a gram that only one has), the first common gram and the sets themselves are compared where two labels meet,
    so only pairs known to be alike leave the task, and once.
    """
    raw = nodes.select("id", merge_bucket().alias("b"), display_label().alias("l"), "community")
    named = raw.groupBy("b", "l").agg(F.min(F.struct("id", "community")).alias("m")).where(entropy("l") >= MIN_ENTROPY)
    named = named.select("b", normalize_label("l").alias("n"), "m").where("n <> ''")
    each = cut(named.groupBy("b", "n").agg(F.min("m").alias("m")).select("b", "n", "m.id", "m.community"), "each")
    rows = each.select("b", "n", F.explode(shingles("n")).alias("g"))
    # Grams of letters and digits: a bounded number in each bucket.
    rarity = rows.groupBy("b", "g").agg(F.count(F.lit(1)).alias("df"))
    ordered = rows.join(F.broadcast(rarity), ["b", "g"]).groupBy("b", "n").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("o"))
    bit = lambda p: F.pmod(F.xxhash64(p["g"]), F.lit(128))
    word = lambda lo: F.aggregate("o", F.lit(0).cast("bigint"), lambda a, p: F.when(bit(p).between(lo, lo + 63), a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit(p) - lo).cast("int")))).otherwise(a))
    size = F.size("o")
    keep = (size - F.ceil(size * 7 / 10) + 1).cast("int")
    sets = ordered.select("b", "n", size.alias("size"), word(0).alias("s0"), word(64).alias("s1"), F.slice("o.g", F.lit(1), keep).alias("first"))
    keyed = cut(sets.select("*", F.explode("first").alias("g")), "prefix")
    parts = max(4 * nodes.sparkSession.sparkContext.defaultParallelism, keyed.count() // ROWS_A_TASK)
    keyed = keyed.withColumn("part", F.pmod(F.xxhash64("b", "g"), F.lit(parts))).repartition(min(parts, 2000), "part")
    return each, keyed.groupBy("part").applyInPandas(partial(_meet, similarity=similarity), "b string, x string, y string")


def _meet(pdf: pd.DataFrame, similarity: str) -> pd.DataFrame:
    """Pairs of alike labels among the rows ``b, n, size, s0, s1, first, g`` of equal b and g, each at its first common gram."""
    pdf = pdf.sort_values(["b", "g", "size"], kind="stable")
    b, g, n, first, size = (pdf[c].to_numpy() for c in ("b", "g", "n", "first", "size"))
    s0, s1 = (pdf[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("s0", "s1"))
    need = np.ceil(MIN_SIMILARITY * size).astype(int)
    size, sets, out = size.astype(int), {}, []
    starts = np.r_[0, np.flatnonzero((b[1:] != b[:-1]) | (g[1:] != g[:-1])) + 1, len(pdf)].tolist()
    for lo, hi in pairwise(starts):
        for i in range(lo, hi - 1, BLOCK):
            to = min(i + BLOCK, hi)
            end = lo + int(np.searchsorted(need[lo:hi], size[to - 1], "right"))
            differ = np.bitwise_count(s0[i:to, None] ^ s0[None, i:end]).astype(int) + np.bitwise_count(s1[i:to, None] ^ s1[None, i:end])
            most = size[i:to, None] + (size - 2 * need)[None, i:end]
            near = (differ <= most) & (size[i:to, None] >= need[None, i:end]) & (np.arange(i, to)[:, None] < np.arange(i, end)[None, :])
            for p, q in (np.argwhere(near) + i).tolist():
                rare = set(first[q])
                if next(x for x in first[p] if x in rare) != g[p]:
                    continue
                for x in (n[p], n[q]):
                    if x not in sets:
                        t = x.replace(" ", "")
                        sets[x] = {t[k : k + 3] for k in range(max(1, len(t) - 2))}
                common = len(sets[n[p]] & sets[n[q]])
                if common >= MIN_SIMILARITY * (size[q] if similarity == "max" else size[p] + size[q] - common):
                    out.append((b[p], min(n[p], n[q]), max(n[p], n[q])))
    return pd.DataFrame(out, columns=["b", "x", "y"])


def _of_labels(each: DataFrame, pairs: DataFrame, *more: str) -> DataFrame:
    """``u < v`` and their communities ``cu, cv`` for pairs of labels, with ``more`` columns of the pairs."""
    side = lambda n, k: each.select("b", F.col("n").alias(n), F.struct("id", "community").alias(k))
    j = pairs.join(side("x", "p"), ["b", "x"]).join(side("y", "q"), ["b", "y"])
    in_order = j.select(F.when(F.col("p.id") < F.col("q.id"), F.struct("p", "q")).otherwise(F.struct(F.col("q").alias("p"), F.col("p").alias("q"))).alias("e"), *more)
    return in_order.select(F.col("e.p.id").alias("u"), F.col("e.q.id").alias("v"), F.col("e.p.community").alias("cu"), F.col("e.q.community").alias("cv"), *more)


def fuzzy_candidates(nodes: DataFrame, similarity: str = "max") -> DataFrame:
    """``u < v`` of informative labels in one bucket whose shingle sets are alike.

    ``similarity`` is ``max`` (common over the larger set) or ``jaccard``. Nodes whose label has no letters or digits
    stay out. Labels equal after normalisation are one candidate each; exact_links has joined them already.
    """
    each, pairs = _alike(nodes, similarity)
    return _of_labels(each, pairs).select("u", "v")


def fuzzy_matches(nodes: DataFrame, least: float = MIN_MATCH) -> DataFrame:
    """``u, v, score`` of the candidates (see fuzzy_candidates) with a score of ``least`` or more, as scored_pairs has it.

    Labels are compared before ids and communities are looked up: only pairs that may reach the score are moved.
    """
    each, pairs = _alike(nodes, "max")
    near = cut(pairs.withColumn("jw", jaro_winkler("x", "y") * 100).where(F.col("jw") + COMMUNITY_BONUS >= least), "near")
    score = F.col("jw") + F.when(F.col("cu") == F.col("cv"), COMMUNITY_BONUS).otherwise(0.0)
    return _of_labels(each, near, "jw").select("u", "v", score.alias("score")).where(F.col("score") >= least)


def scored_pairs(nodes: DataFrame, pairs: DataFrame, communities: bool = True) -> DataFrame:
    """``u, v, score``: Jaro-Winkler of the normalised labels (ids where empty) in percent, more within one community."""
    n = normalize_label(display_label())
    named = nodes.select("id", F.when(n == "", normalize_label("id")).otherwise(n).alias("n"), "community")
    side = lambda k: named.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("community").alias(f"c{k}"))
    j = pairs.join(side("u"), "u").join(side("v"), "v")
    bonus: Column = F.when(F.col("cu") == F.col("cv"), COMMUNITY_BONUS).otherwise(0.0) if communities else F.lit(0.0)
    return j.select("u", "v", (jaro_winkler("nu", "nv") * 100 + bonus).alias("score"))


def doubtful_pairs(nodes: DataFrame) -> DataFrame:
    """``u, v, score`` of alike pairs just below the match score: the candidates a model or person may decide."""
    return fuzzy_matches(nodes, DOUBT_FROM).where(F.col("score") < MIN_MATCH)


def resolve_entities(g: Graph, decide: Callable[[DataFrame], DataFrame] | None = None) -> tuple[Graph, DataFrame]:
    """The graph with alike nodes merged, and the remap ``id, winner``.

    The winner of a group is the node of the best file type without copy suffix and with the shortest id. Edges follow
    the remap; loops go, and of equal (source, target, relation) the greatest confidence stays. ``decide`` may confirm
    doubtful pairs (u, v, score) by returning those to merge.
    """
    first = first_per_key(g.nodes, ["id"], ["label"])
    nodes = cut(first.select("id", "label", "community", "filetype"), "nodes")
    # Equals stand for their least id; only what the fuzzy pass links needs components.
    keyed = nodes.select("id", "filetype", merge_bucket().alias("b"), normalize_label(display_label()).alias("n"))
    least = keyed.where("n <> ''").groupBy("b", "n").agg(F.min("id").alias("rep"))
    equal = cut(keyed.join(least, ["b", "n"], "left").select("id", "filetype", F.coalesce("rep", "id").alias("rep")), "equal")
    sure = fuzzy_matches(nodes).select("u", "v")
    if decide is not None:
        sure = sure.unionByName(decide(doubtful_pairs(nodes)).select("u", "v"))
    for end in ("u", "v"):
        sure = sure.join(equal.select(F.col("id").alias(end), "rep"), end, "left").withColumn(end, F.coalesce("rep", end)).drop("rep")
    roots = star_roots(cut(undirected(sure, "u", "v"), "sure")).withColumnRenamed("x", "rep")
    member = cut(equal.join(roots, "rep", "left").select("id", "filetype", F.coalesce("root", "rep").alias("root")), "member")
    best = member.groupBy("root").agg(F.min(winner_score()).alias("w")).select("root", F.col("w.id").alias("winner"))
    remap = member.join(best, "root").where("id <> winner").select("id", "winner")
    kept = first.join(remap, "id", "left_anti").select(*first.columns)
    edges = g.edges
    for end in ("source", "target"):
        edges = attach(edges, remap.select(F.col("id").alias(end), F.col("winner").alias("_w")), end, "left", g.edges).withColumn(end, F.coalesce("_w", end)).drop("_w")
    edges = edges.where("source <> target").groupBy("source", "target", "relation").agg(F.max("confidence").alias("confidence"))
    return g.with_(nodes=kept, edges=edges.select(*EDGE_FIELDS)), remap
