"""Duplicates hidden by formatting differences: one record per canonical form, with the number of its copies.

Records are reduced to a canonical form inside the JVM (letters and digits only, no case, fields in name order). Two
Bloom filters of canonical hashes, once-seen and repeatedly-seen, are built per input partition and merged: a bit that
two partitions set, or one partition set for a repeated hash, moves to the repeated filter. Only records whose bits all
stand in the repeated filter can have a copy; those alone are shuffled and grouped exactly by their canonical form. All
others are emitted as singletons where they lie.

The filter is cut into segments of 512 KiB by hash, about half a million keys each; a key lives in one segment. Segments
are merged in executors as streams sorted by segment and written to the shared folder, where probing tasks map them into
memory: nothing passes through the driver, and no task holds more than one segment while merging.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.scratch import cut, fresh_path
from graphloom.plans.skew import heavy_keys, salted_join

SEGMENT_BITS = 1 << 22
BITS_PER_KEY = 8
PROBES = 4
OPEN_SEGMENTS = 64


def bare(text: Column) -> Column:
    """Letters and digits of ``text`` in their order, case folded; null becomes ''."""
    folded = F.lower(F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", "")))
    return F.replace(folded, F.lit("ß"), F.lit("ss"))


def bare_fields(props: Column) -> Column:
    """Canonical form of a flat JSON object: bare ``name=value`` pairs in name order; null, {} and { } are all ''.

    Text that is no JSON object is compared by its bare form, marked so that it never equals an object's.
    """
    fields = F.from_json(props, "map<string,string>")
    pairs = F.transform(F.map_entries(fields), lambda e: F.concat(bare(e["key"]), F.lit("="), bare(e["value"])))
    broken = F.concat(F.lit("!"), bare(props))
    return F.when(props.isNull(), "").when(fields.isNull(), broken).otherwise(F.array_join(F.array_sort(pairs), "&"))


def _positions(h: np.ndarray) -> np.ndarray:
    """Bit positions of each hash inside its segment, shape (keys, PROBES)."""
    u = h.view(np.uint64)
    a = (u * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    b = ((u ^ (u >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32) | np.uint64(1)
    return ((a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(SEGMENT_BITS)).astype(np.uint32)


def _segment(h: np.ndarray, segments: int) -> np.ndarray:
    return (((h.view(np.uint64) >> np.uint64(33)) * np.uint64(segments)) >> np.uint64(31)).astype(np.int32)


def _local_filters(segments: int):
    """mapInArrow: the two filters of one partition, as sorted bit positions per segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.asarray(b.column(0).to_numpy(zero_copy_only=False), dtype=np.int64) for b in batches]
        if not parts:
            return
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        del parts
        seg = _segment(keys, segments)
        order = np.argsort(seg, kind="stable")
        keys, counts, seg = keys[order], counts[order], seg[order]
        starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        for lo, hi in zip(starts, [*starts[1:], len(seg)]):
            pos, many = _positions(keys[lo:hi]), counts[lo:hi] > 1
            once, rep = np.unique(pos), np.unique(pos[many])
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(seg[lo])], pa.int32()), pa.array([once.tobytes()], pa.binary()), pa.array([rep.tobytes()], pa.binary())],
                ["segment", "once", "rep"],
            )

    return run


def _store(path: str, data: bytes) -> None:
    """Write one file below the shared folder, visible only when whole."""
    if path.startswith("file:"):
        local = path[5:].replace("//", "", 1) if path.startswith("file://") else path[5:]
        os.makedirs(os.path.dirname(local), exist_ok=True)
        tmp = f"{local}.{uuid.uuid4().hex}"
        with open(tmp, "wb") as f:
            f.write(data)
        os.replace(tmp, local)
        return
    from pyarrow import fs

    system, p = fs.FileSystem.from_uri(path)
    system.create_dir(os.path.dirname(p), recursive=True)
    tmp = f"{p}.{uuid.uuid4().hex}"
    with system.open_output_stream(tmp) as f:
        f.write(data)
    system.move(tmp, p)


def _fetch(path: str) -> bytes:
    """One whole file below the shared folder."""
    if path.startswith("file:"):
        with open(path[5:].replace("//", "", 1) if path.startswith("file://") else path[5:], "rb") as f:
            return f.read()
    from pyarrow import fs

    system, p = fs.FileSystem.from_uri(path)
    with system.open_input_stream(p) as f:
        return f.read()


def _merge(root: str):
    """mapInArrow over rows sorted by segment: merge the partitions' filters and store each segment's repeated bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, once, rep = None, None, None

        def close() -> pa.RecordBatch:
            _store(f"{root}/{current}.bits", np.packbits(rep, bitorder="little").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([int(rep.sum())], pa.int64())], ["segment", "bits"])

        for batch in batches:
            for seg, o, r in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if seg != current:
                    if current is not None:
                        yield close()
                    current, once, rep = seg, np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
                bits = np.frombuffer(o.as_buffer(), np.uint32)
                rep[bits[once[bits]]] = True
                once[bits] = True
                rep[np.frombuffer(r.as_buffer(), np.uint32)] = True
        if current is not None:
            yield close()

    return run


class _Segments:
    """Stored segments, mapped where the shared folder is a mounted path, else read and kept for a bounded number."""

    def __init__(self, root: str):
        self.root, self.open = root, OrderedDict()

    def get(self, seg: int) -> np.ndarray:
        if seg in self.open:
            self.open.move_to_end(seg)
            return self.open[seg]
        path = f"{self.root}/{seg}.bits"
        if path.startswith("file:"):
            bits = np.memmap(path[5:].replace("//", "", 1) if path.startswith("file://") else path[5:], np.uint8, "r")
        else:
            bits = np.frombuffer(_fetch(path), np.uint8)
        self.open[seg] = bits
        if len(self.open) > OPEN_SEGMENTS:
            self.open.popitem(last=False)
        return bits


def possible_repeats(hashes: DataFrame, column: str, rows: int | None = None) -> Column:
    """Build the merged filters over the hash column and return a predicate on it: can this hash stand twice?

    The predicate has no false negatives; with 8 bits a key about one singleton in ten thousand passes it. ``rows``, an
    upper bound of the number of hashes, fixes the filter's size (if not given, the rows of the table are counted).
    """
    spark = hashes.sparkSession
    h = hashes.select(F.col(column).alias("h")).where("h is not null")
    if rows is None:
        rows = hashes.count()
    segments = max(1, -(-rows * BITS_PER_KEY // SEGMENT_BITS))
    root = fresh_path(spark, "bloom")
    local = h.mapInArrow(_local_filters(segments), "segment int, once binary, rep binary")
    tasks = min(segments, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    (
        local.repartition(tasks, "segment").sortWithinPartitions("segment").mapInArrow(_merge(root), "segment int, bits bigint")
        .agg(F.sum("bits")).collect()
    )
    held: list[_Segments] = []

    @F.pandas_udf("boolean")
    def maybe(values: pd.Series) -> pd.Series:
        if not held:
            held.append(_Segments(root))
        known = values.notna().to_numpy()
        keys = values.fillna(0).to_numpy(dtype=np.int64)
        seg, pos, out = _segment(keys, segments), _positions(keys), np.zeros(len(keys), bool)
        order = np.argsort(seg, kind="stable")
        ends = np.flatnonzero(np.r_[seg[order][1:] != seg[order][:-1], True]) + 1 if len(keys) else []
        lo = 0
        for hi in ends:
            rows_ = order[lo:hi][known[order[lo:hi]]]
            if len(rows_):
                bits = held[0].get(int(seg[rows_[0]]))
                p = pos[rows_]
                out[rows_] = ((bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1).all(axis=1)
            lo = hi
        return pd.Series(out)

    return maybe(F.col(column))


def copy_members(records: DataFrame) -> DataFrame:
    """``first_key, copy_key, copies`` for every member of a set of copies but the smallest.

    ``records`` has ``key`` (string) and ``canon`` (string, the canonical form; null takes no part). Repeats of the same
    (key, canon) are one record. ``copies`` counts the distinct keys of the set. Sets of any size stay balanced: they
    are aggregated before the shuffle and heavy ones are salted when their members look up the first key.
    """
    rows = records.select("key", "canon", F.xxhash64("canon").alias("h")).where("key is not null and canon is not null")
    repeats = cut(rows.where(possible_repeats(rows, "h")).distinct(), "repeats")
    groups = repeats.groupBy("h", "canon").agg(F.min("key").alias("first_key"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    sized = salted_join(repeats, groups.withColumnRenamed("canon", "_canon"), "h", heavy_keys(repeats, "h"), F.col("key"))
    return sized.where("canon = _canon and key > first_key").select("first_key", F.col("key").alias("copy_key"), "copies")


def collapse(records: DataFrame) -> DataFrame:
    """``key, copies``: one record per canonical form (its smallest key) with the number of its distinct keys.

    Records without canonical form (null) each stay alone, once per key. Singletons never leave their partition unless the filter
    cannot rule them out.
    """
    canon = F.coalesce("canon", F.concat(F.lit("\u0000"), F.col("key")))
    rows = records.where("key is not null").select("key", canon.alias("canon")).withColumn("h", F.xxhash64("canon"))
    marked = rows.withColumn("maybe", possible_repeats(rows, "h"))
    alone = marked.where("not maybe").select("key", F.lit(1).cast("bigint").alias("copies"))
    exact = marked.where("maybe").select("key", "h", "canon").distinct()
    grouped = exact.groupBy("h", "canon").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"))
    return alone.unionByName(grouped.select("key", "copies"))


def entity_records(entities: DataFrame) -> DataFrame:
    """``key, canon`` of entities: bare type, bare label and fields; rows without a bare label take no part."""
    label = bare(F.col("label"))
    canon = F.concat_ws("\u0001", bare(F.col("type")), label, bare_fields(F.col("props")))
    return entities.select(F.col("entity_key").alias("key"), F.when(label != "", canon).alias("canon"))


def node_records(nodes: DataFrame) -> DataFrame:
    """``key, canon`` of entity and section nodes: kind, source file and bare label."""
    label, kind = bare(F.col("label")), F.split_part(F.col("id"), F.lit(":"), F.lit(2))
    canon = F.concat_ws("\u0001", kind, F.coalesce("sourcefile", F.lit("")), label)
    return nodes.where(kind.isin("entity", "section")).select(F.col("id").alias("key"), F.when(label != "", canon).alias("canon"))
