"""Aggregation over joins when a few keys hold most rows.

Eager aggregation: both inputs are reduced to one compact state per join key (and grouping column) before anything is
joined, the states are joined, counts are multiplied and sums scaled by the other side's count, and the products are
rolled up. A key that stands in a third of all rows is one state per map task, never a long run of rows in one task.

Defined results: null keys match nothing (as in SQL); they stay out of ``key_profile`` too, where the empty string is
also no key. Empty inputs give an empty result. Repeated rows count as often as they stand. Columns other than those
named are never read, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compact(df: DataFrame, key: str, group: Sequence[str] = (), sums: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """State of ``df`` per key: ``{prefix}n`` rows and ``{prefix}{c}`` sums, aggregated map-side before its shuffle."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_k"), *(F.col(g).alias(f"{prefix}{g}") for g in group))
        .agg(F.count(F.lit(1)).alias(f"{prefix}n"), *(F.sum(s).alias(f"{prefix}{s}") for s in sums))
    )


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    left_group: Sequence[str] = (),
    right_group: Sequence[str] = (),
    left_sums: Sequence[str] = (),
    right_sums: Sequence[str] = (),
    by_key: bool = False,
) -> DataFrame:
    """``count(*)`` and sums over ``left JOIN right ON left_key = right_key``, without ever building that join.

    Returns ``l_<group>``, ``r_<group>`` (and ``key`` if ``by_key``), ``pairs`` (rows of the join), ``l_<sum>`` and
    ``r_<sum>`` over the joined rows. ``pairs`` is decimal(38,0): products of large counts must not overflow.
    """
    ls = compact(left, left_key, left_group, left_sums, "l_")
    rs = compact(right, right_key, right_group, right_sums, "r_")
    wide = "decimal(20,0)"
    joined = ls.join(rs, "_k")
    out = [F.col(f"l_{g}") for g in left_group] + [F.col(f"r_{g}") for g in right_group]
    if by_key:
        out.insert(0, F.col("_k").alias("key"))
    return joined.groupBy(*out).agg(
        F.sum(F.col("l_n").cast(wide) * F.col("r_n").cast(wide)).cast("decimal(38,0)").alias("pairs"),
        *(F.sum(F.col(f"l_{s}") * F.col("r_n")).alias(f"l_{s}") for s in left_sums),
        *(F.sum(F.col(f"r_{s}") * F.col("l_n")).alias(f"r_{s}") for s in right_sums),
    )


def key_profile(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Per key of either side: ``key, left_n, right_n, pairs`` (``pairs = left_n * right_n``, the rows of the join).

    Both states are partitioned by the key already, so their full join adds no shuffle.
    """
    usable = lambda df, k: df.select(F.nullif(F.col(k), F.lit("")).alias("_key"))
    ls = compact(usable(left, left_key), "_key", prefix="l_")
    rs = compact(usable(right, right_key), "_key", prefix="r_")
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    return ls.join(rs, "_k", "full").select(
        F.col("_k").alias("key"),
        n("l_n").alias("left_n"),
        n("r_n").alias("right_n"),
        (n("l_n").cast("decimal(19,0)") * n("r_n").cast("decimal(19,0)")).alias("pairs"),
    )


def crowded_endpoints(edges: DataFrame, share: float = 0.02) -> DataFrame:
    """``endpoint, node_id`` for ids standing in at least ``share`` of all rows of ``edges`` at that endpoint.

    Both endpoints come out of one profile of the walk join ``edges.target = edges.source``.
    """
    total = edges.count()
    profile = key_profile(edges, edges, "target", "source")
    floor = F.lit(total * share)
    return (
        profile.where((F.col("left_n") >= floor) | (F.col("right_n") >= floor))
        .select(
            F.explode(
                F.array(
                    F.struct(F.lit("target").alias("endpoint"), F.col("left_n").alias("n")),
                    F.struct(F.lit("source").alias("endpoint"), F.col("right_n").alias("n")),
                )
            ).alias("e"),
            F.col("key").alias("node_id"),
        )
        .where(F.col("e.n") >= floor)
        .select("e.endpoint", "node_id")
    )


def endpoint_counts(edges: DataFrame) -> DataFrame:
    """``node_id, relation, out_n, in_n``: edges of each relation leaving and entering every node id, complete."""
    side = lambda c, name: (
        compact(edges.select(F.nullif(F.col(c), F.lit("")).alias("_e"), "relation"), "_e", ["relation"], prefix="s_")
        .select(F.col("_k").alias("node_id"), F.col("s_relation").alias("relation"), F.col("s_n").alias(name))
    )
    out, into = side("source", "out_n"), side("target", "in_n")
    zero = F.lit(0).cast("bigint")
    o, i = out.alias("o"), into.alias("i")
    return o.join(i, (F.col("o.node_id") == F.col("i.node_id")) & F.col("o.relation").eqNullSafe(F.col("i.relation")), "full").select(
        F.coalesce("o.node_id", "i.node_id").alias("node_id"),
        F.coalesce("o.relation", "i.relation").alias("relation"),
        F.coalesce("o.out_n", zero).alias("out_n"),
        F.coalesce("i.in_n", zero).alias("in_n"),
    )
