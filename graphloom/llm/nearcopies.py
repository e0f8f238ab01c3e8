"""Shingle sets, MinHash bands and verified links between near-equal sets."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.scratch import Scratch
from graphloom.plans.skew import crowded_keys, salted_join

SHINGLE = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Hasher:
    """64-bit hashes of tokens, remembered for a bounded number of tokens."""

    def __init__(self, limit: int = 1 << 18):
        self.seen, self.limit = {}, limit

    def __call__(self, tokens: list[str]) -> np.ndarray:
        seen, out = self.seen, []
        for t in tokens:
            h = seen.get(t)
            if h is None:
                if len(seen) >= self.limit:
                    seen.clear()
                h = seen[t] = xxhash.xxh3_64_intdigest(t)
            out.append(h)
        return np.array(out, np.uint64)


def shingles(hashes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of all runs of ``width`` tokens; a shorter sequence is one shingle, an empty one has none."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    width = min(width, len(hashes))
    acc = np.zeros(len(hashes) - width + 1, np.uint64)
    for i in range(width):
        acc = acc * _ODD + hashes[i : i + len(acc)]
        acc ^= acc >> np.uint64(29)
    return np.unique(acc.view(np.int64))


@functools.cache
def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20)
    return r.integers(1, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, n, dtype=np.uint32)


def band_keys(shingle_set: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band of the set's MinHash signature; none for an empty set."""
    if not len(shingle_set):
        return np.zeros(0, np.int64)
    a, b = _multipliers(bands * rows)
    wide = shingle_set.view(np.uint64)
    short = (wide ^ (wide >> np.uint64(32))).astype(np.uint32)
    low = None
    for i in range(0, len(short), 512):
        mixed = short[i : i + 512, None] * a
        mixed += b
        least = mixed.min(axis=0)
        low = least if low is None else np.minimum(low, least)
    low = low.astype(np.uint64).reshape(bands, rows)
    acc = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows):
        acc = acc * _ODD + low[:, i]
        acc ^= acc >> np.uint64(31)
    return acc.view(np.int64)


def near_links(items: DataFrame, threshold: float = 0.8, sets: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``u, v`` (u < v): verified links between items whose shingle sets have a Jaccard similarity of ``threshold`` or more.

    ``items`` has ``id`` (string, unique), ``bands`` (array<bigint>) and ``shingles``; without the latter, ``sets`` gives
    ``id, shingles`` for a table of ids. Equal sets should be collapsed to one item before. In every bucket all members
    are compared with the least id; where that leaves members apart, all pairs of the bucket that lie in different
    clusters, fit in size and were not compared are. Buckets that hold one cluster, and pairs within a cluster, are never
    paired; the links join all items that a path of near pairs with shared bands joins.
    """
    scratch = Scratch(items.sparkSession, "links")
    rows = items.select("id", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "centre")
    buckets, _ = scratch.put(salted_join(rows, shared, "band", crowded_keys(rows, "band"), F.col("id")), "buckets")
    # Only sets that share a band are ever compared; the others stay out of everything that follows.
    members = buckets.select("id").distinct()
    sets_, _ = scratch.put(sets(members) if sets else items.select("id", "shingles").join(members, "id", "left_semi"), "sets")
    star = buckets.where("id <> centre").select(F.col("centre").alias("u"), F.col("id").alias("v")).distinct()
    judged, _ = scratch.put(_judged(star, sets_, threshold), "judged")
    found = judged.where("close").select("u", "v")
    apart = judged.where("not close").select(F.col("u").alias("centre"), F.col("v").alias("id"))
    if apart.isEmpty():
        return found
    mixed = buckets.join(apart, ["centre", "id"], "left_semi").select("band").distinct()
    split = buckets.join(mixed, "band", "left_semi").select("band", "id")
    return found.unionByName(_across(split, found, judged, sets_, threshold, scratch))


def _judged(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``u, v, close`` for every pair: is the similarity of their sets ``threshold`` or more?"""
    ours = salted_join(pairs, sets.toDF("u", "a"), "u", crowded_keys(pairs, "u"), F.col("v"))
    both = salted_join(ours, sets.toDF("v", "b"), "v", crowded_keys(pairs, "v"), F.col("u"))
    common = F.size(F.array_intersect("a", "b"))
    return both.select("u", "v", (common >= threshold * (F.size("a") + F.size("b") - common)).alias("close"))


def _across(split: DataFrame, found: DataFrame, judged: DataFrame, sets: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Links ``u, v`` between members of a bucket of ``split`` (band, id) that the links found do not join already.

    Two items are joined for sure if they have the same leader: the least item reached by two links to a lesser one. Joined
    items with different leaders are compared once more than needed, no pair that is apart is left out.
    """
    lead, _ = scratch.put(found.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("first")), "leaders")
    upper = lead.select(F.col("id").alias("first"), F.col("first").alias("second"))
    cluster = salted_join(lead, upper, "first", crowded_keys(lead, "first"), F.col("id"), "left").select("id", F.coalesce("second", "first").alias("leader"))
    sized = sets.select("id", F.size("shingles").alias("n"))
    placed = split.join(cluster, "id", "left").join(sized, "id").select("band", "id", F.coalesce("leader", "id").alias("cluster"), "n")
    placed, _ = scratch.put(placed, "placed")
    mixed = placed.groupBy("band").agg(F.min("cluster").alias("a"), F.max("cluster").alias("b")).where("a <> b").select("band")
    placed = placed.join(mixed, "band", "left_semi")
    other = placed.select("band", F.col("id").alias("v"), F.col("cluster").alias("other"), F.col("n").alias("m"))
    fits = (F.col("id") < F.col("v")) & (F.col("cluster") != F.col("other")) & (F.least("n", "m") >= threshold * F.greatest("n", "m"))
    met = salted_join(placed, other, "band", crowded_keys(placed, "band"), F.col("id")).where(fits).select(F.col("id").alias("u"), "v").distinct()
    pairs, _ = scratch.put(met.join(judged.select("u", "v"), ["u", "v"], "left_anti"), "across")
    links, _ = scratch.put(_judged(pairs, sets, threshold).where("close").select("u", "v"), "links")
    return links
