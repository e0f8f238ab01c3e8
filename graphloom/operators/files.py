"""Changed files by modification time and hash, manifests with hash reuse, and the file cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.sources.discovery import extension


def changed_files(current: DataFrame, cache: DataFrame, hash_: Column | None = None) -> DataFrame:
    """``path`` of files to process: unknown ones, and those whose mtime and content hash both differ from the cache.

    ``current`` has path, mtime and sha256 (or ``hash_``, an expression computed only where the mtime differs); ``cache``
    has path, mtime and hash. An equal mtime settles the matter; mtime 0 is unknown.
    """
    known = cache.select("path", F.col("mtime").alias("_m"), F.lower("hash").alias("_h"), F.lit(True).alias("_known"))
    joined = current.join(known, "path", "left")
    same_time = F.coalesce((F.col("mtime") == F.col("_m")) & (F.col("mtime") != 0), F.lit(False))
    now = F.lower(hash_ if hash_ is not None else F.col("sha256"))
    same = same_time | F.coalesce(F.when(~same_time, now) == F.col("_h"), F.lit(False))
    return joined.where(F.col("_known").isNull() | ~same).select("path").distinct()


def save_cache(prior: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cache after a run: entries of ``fresh`` (path, mtime, hash) replace those of ``prior``; others stay."""
    rows = prior.select("path", "mtime", "hash", F.lit(0).alias("g")).unionByName(fresh.select("path", "mtime", "hash", F.lit(1).alias("g")))
    return rows.groupBy("path").agg(F.max(F.struct("g", "mtime", "hash")).alias("m")).select("path", "m.mtime", "m.hash")


def build_manifest(listing: DataFrame, prior: DataFrame, hash_: Column) -> DataFrame:
    """``path, mtime, size, sha256, ext`` of a listing; a prior hash is reused where mtime and size are both the same."""
    old = prior.select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s"), F.col("sha256").alias("_h"))
    keep = F.coalesce((F.col("mtime") == F.col("_m")) & (F.col("size") == F.col("_s")), F.lit(False))
    joined = listing.join(old, "path", "left")
    return joined.select("path", "mtime", "size", F.when(keep & F.col("_h").isNotNull(), F.col("_h")).otherwise(hash_).alias("sha256"), extension("path").alias("ext"))


def cache_stats(entries: DataFrame) -> DataFrame:
    """One row ``entries, bytes, oldest, newest`` of a cache listing (size, mtime)."""
    return entries.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.min("mtime").alias("oldest"), F.max("mtime").alias("newest"))
