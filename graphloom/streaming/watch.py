"""Watching for changes: file events debounced into batches, rebuilds one at a time, incremental state per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.incremental import ContentState


def debounced(events: DataFrame, time: str, key: str, gap: str = "200 milliseconds", late: str | None = "10 minutes") -> DataFrame:
    """``key, start, end, n``: bursts of events per key that follow each other within ``gap``.

    On a stream ``late`` sets the watermark that closes bursts; on a table it is not needed.
    """
    if events.isStreaming and late:
        events = events.withWatermark(time, late)
    w = F.session_window(F.col(time), gap)
    out = events.groupBy(F.col(key).alias("key"), w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def watch(changes: DataFrame, rebuild: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Call ``rebuild(batch, id)`` for every micro-batch of changes, never two at once; what arrives meanwhile is the next."""
    writer = changes.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def process_changed(
    changes: DataFrame, state: ContentState, work: Callable[[DataFrame], None], checkpoint: str, trigger: dict | None = None, order: str | None = None
) -> StreamingQuery:
    """Run ``work`` on the new and changed records (key, hash) of every batch and commit them after it succeeds.

    ``order`` names a bigint or timestamp column, without nulls, that tells versions of a key apart: the newest counts,
    within a batch and against what was committed, so a late older version is left alone; the state belongs to this
    order alone. Without it batches follow each other, and a batch with several versions of one key is an error, for
    none of them can be called the newest.

    A batch that is replayed after a failure selects the same records again unless its commit went through, in which
    case it selects none.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        records = batch.where("key is not null").withColumn("hash", F.lower("hash"))
        if order is None:
            latest = records.groupBy("key").agg(F.max("hash").alias("hash"), (F.count_distinct("hash") > 1).alias("several"))
            unclear = latest.where("several").select("key").limit(1).collect()
            if unclear:
                raise ValueError(f"several versions of {unclear[0].key!r} in batch {batch_id}: name their order")
            newer = state.changed(latest).select("key", "hash", F.lit(state.next_run()).cast("bigint").alias("seen"), F.lit(True).alias("other"))
        else:
            at = F.col(order)
            if batch.schema[order].dataType.typeName() in ("timestamp", "timestamp_ntz"):
                at = F.unix_micros(at.cast("timestamp"))
            latest = records.groupBy("key").agg(F.max(F.struct(at.cast("bigint").alias("seen"), "hash")).alias("m")).select("key", "m.*")
            then = state.load().select("key", F.struct("seen", F.lower("hash").alias("hash")).alias("then"))
            newer = latest.join(then, "key", "left").where(F.col("then").isNull() | (F.struct("seen", "hash") > F.col("then")))
            # Unchanged content is no work, but its time is kept: what is older than it is late.
            newer = newer.select("key", "hash", "seen", (~F.coalesce(F.col("hash") == F.col("then.hash"), F.lit(False))).alias("other"))
        newer = newer.persist()
        try:
            todo = newer.where("other").select("key", "hash")
            if todo.limit(1).count():
                work(todo)
            if newer.limit(1).count():
                state.commit(newer)
        finally:
            newer.unpersist()

    return watch(changes, one, checkpoint, trigger)


def event_rates(events: DataFrame, time: str, kind: str, window: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """``kind, start, n, total``: counts and sums of ``value`` per window; late rows are dropped on a stream only."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    w = F.window(time, window, slide) if slide else F.window(time, window)
    out = events.groupBy(F.col(kind).alias("kind"), w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("kind", F.col("w.start").alias("start"), "n", "total")
