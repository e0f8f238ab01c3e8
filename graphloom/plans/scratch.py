"""Shared scratch storage: where lineage is cut and where intermediate tables live.

Everything is written below ``spark.checkpoint.dir``, the folder all executors share, so a lost executor never takes
intermediate results with it. Where that setting is absent a folder of our own is used in local mode alone (tests, a
laptop); on a cluster its absence is an error. All scratch of a session lies below one folder that the file system
removes when the session's JVM ends; loops free their generations as they go.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
_roots: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; in local mode a private one if the session names none."""
    global _own
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(configured)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    if not re.fullmatch(r"local(\[[^,\]]*(,\d+)?\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


def session_root(spark: SparkSession) -> str:
    """The session's own folder below the shared one; removed at the end of the JVM."""
    base, app = shared_dir(spark), spark.sparkContext.applicationId
    if (base, app) not in _roots:
        root = f"{base}/graphloom-{app}-{uuid.uuid4().hex[:8]}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _roots[base, app] = root
    return _roots[base, app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the session's folder that nothing else uses."""
    return f"{session_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and the optimizer knows its true size."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a scratch path on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables of a fixpoint loop: ``put`` writes a generation, ``drop`` frees one that no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, fresh_path(spark, name), 0

    def put(self, df: DataFrame, label: str = "t") -> tuple[DataFrame, str]:
        self.n += 1
        path = f"{self.root}/{self.n:04d}-{label}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, path: str | None) -> None:
        if path:
            delete(self.spark, path)
