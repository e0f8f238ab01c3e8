"""Joins that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BUCKETS = 1 << 16
_known: dict[tuple, list] = {}


def heavy_keys(df: DataFrame, key: str, share: float = 0.01, least: int = 1) -> list:
    """Exact list of the keys that stand in at least ``share`` of the rows of ``df`` and in ``least`` rows (nulls left out).

    At most ``1 / share`` keys can qualify, so the list is small whatever the input. First rows per hash bucket, of which
    one row with the total and the fullest buckets comes back (a key can only be heavy in a heavy bucket); only if there
    is such a bucket, exact counts inside it. Both aggregate before they shuffle, so no heavy key is ever moved row by
    row. The answer is remembered per plan: queries that join the same table several times count once.
    """
    keyed = df.select(F.col(key).alias("k")).where("k is not null")
    memo = (df.sparkSession.sparkContext.applicationId, keyed.semanticHash(), share, least)
    if memo in _known:
        return _known[memo]
    bucket = F.pmod(F.xxhash64("k"), F.lit(_BUCKETS))
    counts = keyed.groupBy(bucket.alias("b")).count()
    fullest = F.slice(F.sort_array(F.collect_list(F.struct("count", "b")), asc=False), 1, int(1 / share) + 1)
    top = counts.agg(F.sum("count").alias("total"), fullest.alias("fullest")).first()
    floor = max(least, int((top.total or 0) * share))
    hot = [r["b"] for r in top.fullest if r["count"] >= floor]
    found = []
    if hot:
        found = [r.k for r in keyed.where(bucket.isin(hot)).groupBy("k").count().where(F.col("count") >= floor).collect()]
    _known[memo] = found
    return found


def crowded_keys(df: DataFrame, key: str) -> list:
    """The keys worth salting: a hundredth of the rows and a thousand rows or more. Fewer rows burden no task."""
    return heavy_keys(df, key, 0.01, 1000)


def salted_join(
    big: DataFrame, small: DataFrame, key: str, heavy: list, spread: Column, how: str = "inner", salts: int = 32, on: Column | None = None
) -> DataFrame:
    """Join on ``key`` with the rows of ``heavy`` keys of ``big`` spread over ``salts`` partitions.

    ``small`` is replicated for heavy keys only, so the growth is at most ``len(heavy) * salts`` groups. ``spread`` is a
    deterministic expression over a row of ``big`` (a retried task must salt alike). ``how`` is inner, left,
    left_semi or left_anti; ``on`` is a further condition over columns with different names (semi and anti joins).
    Rows with a null key match nothing. With no heavy key this is the plain equi-join.
    """
    left, right = big, small
    if heavy:
        is_hot = F.col(key).isin(heavy)
        left = big.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
        right = small.withColumn(
            "_salt",
            F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))),
        )
    keys = [key, "_salt"] if heavy else [key]
    if on is None:
        joined = left.join(right, keys, how)
    else:
        right = right.select(*(F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns))
        equal = on
        for k in keys:
            equal = equal & (F.col(k) == F.col(f"_r_{k}"))
        joined = left.join(right, equal, how)
    return joined.drop("_salt")
