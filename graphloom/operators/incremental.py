"""Processing only new or changed records.

State is a table of keys and content hashes, kept from run to run below a folder of its own. A run hashes the current
rows, joins them with the state to select new and changed keys, processes them and commits. A commit writes only its own
entries, as one more part beside those before it, and then makes the next version visible by one atomic step: a small
file that lists the parts and whose name is the version's number is renamed into place, which fails if another run has
taken that number. A run that dies before this step leaves the old version in force, so its records are selected again;
a run that dies after it is done; of two runs at once the later one is told so and repeats its commit on the newer
state. No record is skipped or repeated. When ``COMPACT`` parts have gathered they are folded into one, and files no
retained version lists are removed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.scratch import fresh_path

STATE_SCHEMA = "key string, hash string, seen bigint"
_PART_SCHEMA = "key string, hash string, seen bigint, gone boolean, version bigint"
#: Parts a version may list before the next commit folds them into one.
COMPACT = 8
#: Versions whose files stay, so that a reader of the one before is not cut off.
KEEP = 2


class ConcurrentCommit(RuntimeError):
    """Another run committed the version this one was about to write."""


@dataclass(frozen=True)
class _Version:
    number: int
    parts: list[str]


class ContentState:
    """Versioned ``key, hash, seen`` state below ``root`` on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or fresh_path(spark, "state")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def version(self) -> int | None:
        """Number of the version in force, or None before the first commit."""
        folder = self._path(f"{self.root}/versions")
        if not self._fs.exists(folder):
            return None
        names = (s.getPath().getName() for s in self._fs.listStatus(folder))
        return max((int(n) for n in names if n.isdigit()), default=None)

    def _parts(self, version: int | None) -> list[str]:
        if version is None:
            return []
        stream = self._fs.open(self._path(f"{self.root}/versions/{version:012d}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _read(self, parts: list[str]) -> DataFrame:
        """The entries of ``parts``; of several for one key that of the latest version stays."""
        if not parts:
            return self.spark.createDataFrame([], _PART_SCHEMA)
        rows = self.spark.read.schema(_PART_SCHEMA).parquet(*(f"{self.root}/{p}" for p in parts))
        return _latest(rows) if len(parts) > 1 else rows

    def load(self, version: int | None = None) -> DataFrame:
        """The state in force; empty before the first commit."""
        parts = self._parts(self.version() if version is None else version)
        return self._read(parts).where("not gone").select("key", "hash", "seen")

    def next_run(self) -> int:
        """A ``seen`` above every one of the state: entries committed with it replace those of their keys."""
        last = self.load().agg(F.max("seen")).first()[0]
        return 0 if last is None else last + 1

    def commit(self, rows: DataFrame, merge: bool = True, gone: DataFrame | None = None, expected: int | None = None, attempts: int = 5) -> int:
        """Make ``rows`` (key, hash, seen) the newest knowledge of their keys; returns the version in force afterwards.

        With ``merge`` keys absent from ``rows`` keep their entry, those of ``gone`` (key) excepted; otherwise ``rows``
        replaces the state. One entry per key remains, that of the greatest ``(seen, hash)``; null keys are no records.
        A commit that changes nothing writes no version. ``expected`` names the version the caller worked on: if another
        is in force, :class:`ConcurrentCommit` is raised. Without it the commit is repeated on the newer version.
        """
        new = _latest(rows.select("key", "hash", F.col("seen").cast("bigint").alias("seen"), F.lit(False).alias("gone"), F.lit(0).cast("bigint").alias("version")).where("key is not null"))
        for _ in range(attempts):
            base = self.version() or 0
            if expected is not None and base != expected:
                raise ConcurrentCommit(f"version {base} is in force, not {expected}")
            parts = self._parts(base or None) if merge else []
            entries = new
            if parts:
                entries = self._replacing(new, gone, self._read(parts))
                if len(parts) + 1 > COMPACT:
                    entries, parts = _latest(self._read(parts).unionByName(entries.withColumn("version", F.lit(base + 1)))).where("not gone"), []
            name = f"p-{uuid.uuid4().hex}"
            entries.withColumn("version", F.lit(base + 1).cast("bigint")).write.parquet(f"{self.root}/{name}")
            if parts and self.spark.read.parquet(f"{self.root}/{name}").isEmpty():
                self._fs.delete(self._path(f"{self.root}/{name}"), True)
                return base
            if self._swap(_Version(base + 1, [*parts, name])):
                self._clean(base + 1)
                return base + 1
            self._fs.delete(self._path(f"{self.root}/{name}"), True)
            if expected is not None:
                break
        raise ConcurrentCommit(f"version {base + 1} was taken by another run")

    def _replacing(self, new: DataFrame, gone: DataFrame | None, old: DataFrame) -> DataFrame:
        """The entries of ``new`` that the state does not hold yet in this or a later form, and marks for keys that go."""
        held = old.select("key", F.struct("seen", "hash").alias("_held"), F.col("gone").alias("_gone"), F.col("hash").alias("_hash"))
        joined = new.join(held, "key", "left")
        later = F.col("_held").isNull() | F.col("_gone") | (F.struct("seen", "hash") > F.col("_held"))
        entries = joined.where(later).select(new.columns)
        if gone is not None:
            left = gone.select("key").distinct().join(new.select("key"), "key", "left_anti")
            marks = left.join(old.where("not gone").select("key", "hash", "seen"), "key")
            entries = entries.unionByName(marks.select("key", "hash", "seen", F.lit(True).alias("gone"), F.lit(0).cast("bigint").alias("version")))
        return entries

    def _swap(self, new: _Version) -> bool:
        """Put the list of parts in force as the new version; False if its number is taken."""
        jvm = self.spark.sparkContext._jvm
        folder = self._path(f"{self.root}/versions")
        self._fs.mkdirs(folder)
        tmp = self._path(f"{self.root}/versions/.{new.number:012d}.{uuid.uuid4().hex}")
        stream = self._fs.create(tmp, True)
        try:
            stream.write(bytearray(json.dumps(new.parts).encode()))
        finally:
            stream.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        try:
            context.rename(tmp, self._path(f"{self.root}/versions/{new.number:012d}"), options)
        except Exception as e:  # noqa: BLE001
            if "FileAlreadyExists" not in str(e):
                raise
            self._fs.delete(tmp, False)
            return False
        return True

    def _clean(self, version: int) -> None:
        """Remove versions before the retained ones and the parts only they list."""
        kept = {p for v in range(max(1, version - KEEP + 1), version + 1) for p in self._parts(v)}
        for v in range(version - KEEP, 0, -1):
            old = self._path(f"{self.root}/versions/{v:012d}")
            if not self._fs.exists(old):
                break
            for p in self._parts(v):
                if p not in kept:
                    self._fs.delete(self._path(f"{self.root}/{p}"), True)
            self._fs.delete(old, False)

    def changed(self, current: DataFrame) -> DataFrame:
        """Rows of ``current`` (key, hash) whose key is new to the state or stands there with another hash.

        Hashes compare without regard to case. Repeated rows of ``current`` come out once. A null key is no record;
        a null hash in the state means unknown content, so its key counts as changed. Returns ``key, hash, change``
        with change ``new`` or ``changed``.
        """
        now = current.select("key", F.lower("hash").alias("hash")).where("key is not null").distinct()
        then = self.load().select("key", F.lower("hash").alias("_old"), F.lit(True).alias("_known"))
        return (
            now.join(then, "key", "left")
            .where(~F.coalesce(F.col("hash") == F.col("_old"), F.lit(False)))
            .select("key", "hash", F.when(F.col("_known"), "changed").otherwise("new").alias("change"))
        )


def _latest(rows: DataFrame) -> DataFrame:
    """One entry per key: that of the greatest ``(version, seen, hash)``."""
    best = rows.groupBy("key").agg(F.max(F.struct("version", "seen", "hash", "gone")).alias("m"))
    return best.select("key", "m.hash", "m.seen", "m.gone", "m.version")


def content_hash(*columns: str | Column) -> Column:
    """SHA-256 over the columns, each length-prefixed so that neighbours cannot run together; null differs from ''."""
    cells = [F.col(c) if isinstance(c, str) else c for c in columns]
    text = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in cells]
    return F.sha2(F.concat_ws("|", *text), 256)


def newest(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``key, value`` of the greatest ``(order, value)`` per key; rows whose value or key is null take no part.

    An aggregate, not a window: it combines before the shuffle, so one key may hold any share of the rows.
    """
    return (
        df.where(F.col(value).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(F.max(F.struct(F.col(order), F.lower(F.col(value)).alias("v"))).alias("m"))
        .select("key", F.col("m.v").alias("hash"))
    )


def absorb_runs(state: ContentState, hash_cache: DataFrame, run_log: DataFrame) -> int:
    """Bring the state up to what the successful runs of the log wrote; returns the version in force.

    An entry counts from the run (``seen`` = run_id) that wrote it, so what the state knows already, from this or a later
    run, is left alone: calling this again with a longer cache writes only the difference, and with the same one nothing.
    """
    ok = run_log.where(F.col("status") == "ok").select("run_id").distinct()
    done = hash_cache.select(F.col("path").alias("key"), F.lower("hash").alias("hash"), F.col("run_id")).join(ok, "run_id", "left_semi")
    return state.commit(done.withColumnRenamed("run_id", "seen"))


def pending_paths(file_manifest: DataFrame, hash_cache: DataFrame, run_log: DataFrame, state: ContentState | None = None) -> DataFrame:
    """``key, hash, change``: files whose newest readable scan no successful run has as its latest state.

    The cache entries of runs with status ``ok`` are taken into the content state, and the newest scans are then compared
    with it. A ``state`` kept from run to run is only brought up to date. Files that could never be read (all hashes null)
    are not pending; paths known to the cache only are not either. mtime and size decide nothing.
    """
    state = state or ContentState(file_manifest.sparkSession)
    absorb_runs(state, hash_cache, run_log)
    return state.changed(newest(file_manifest, "path", "scanned_at", "sha256"))
