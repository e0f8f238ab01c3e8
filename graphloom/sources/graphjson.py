"""The graph document: one JSON object with nodes, edges and hyperedges."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.model import Graph, graph

SCHEMA_VERSION = "v2"
# Field names of the document.
_NODE = "ID string, Label string, SourceFile string, SourceLocation string, Community string, FileType string, ExternalURL string"
_EDGE = "Source string, Target string, Relation string, Confidence int, confidence_score double"
_HYPER = "Members array<string>, Relation string, Confidence int"
DOCUMENT = f"schema_version string, nodes array<struct<{_NODE.replace(' string', ':string')}>>, edges array<struct<Source:string, Target:string, Relation:string, Confidence:int, confidence_score:double>>, hyperedges array<struct<Members:array<string>, Relation:string, Confidence:int>>, built_at_commit string"


def check_path(path: str) -> str:
    if not path or "\0" in path or not path.endswith(".json"):
        raise ValueError(f"not a graph document: {path!r}")
    return path


def load_graph(spark: SparkSession, path: str) -> Graph:
    """Read a graph document; a missing version is v1, and later versions are read as far as they are known."""
    doc = spark.read.text(check_path(path), wholetext=True).select(F.from_json("value", DOCUMENT).alias("d"))
    lower = lambda df: df.toDF(*[c.lower() for c in df.columns])
    nodes = lower(doc.select(F.explode("d.nodes").alias("x")).select("x.*"))
    edges = lower(doc.select(F.explode("d.edges").alias("x")).select("x.*"))
    hyper = lower(doc.select(F.explode("d.hyperedges").alias("x")).select("x.*"))
    head = doc.select(F.coalesce("d.built_at_commit", F.lit("")).alias("c")).first()
    return graph(nodes, edges, hyper, head.c if head else "")


def version(spark: SparkSession, path: str) -> str:
    row = spark.read.text(check_path(path), wholetext=True).select(F.get_json_object("value", "$.schema_version").alias("v")).first()
    return (row and row.v) or "v1"
