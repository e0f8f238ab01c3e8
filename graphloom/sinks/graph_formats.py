"""Graph formats: JSON document, GraphML, Cypher and batched pushes. Lines are made and written by the executors."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalar import confidence_name, confidence_score, cypher_relation, display_label, escape_xml, quote_cypher
from graphloom.model import Graph
from graphloom.sources.graphjson import SCHEMA_VERSION

_FIELDS = (("id", "ID"), ("label", "Label"), ("sourcefile", "SourceFile"), ("sourcelocation", "SourceLocation"), ("community", "Community"))


def json_nodes(g: Graph) -> DataFrame:
    """``id, line``: every node as a JSON object; file type and external address only where set."""
    cells = [F.col(a).alias(b) for a, b in _FIELDS] + [F.nullif(F.col(a), F.lit("")).alias(b) for a, b in (("filetype", "FileType"), ("externalurl", "ExternalURL"))]
    return g.nodes.select("id", F.to_json(F.struct(*cells)).alias("line"))


def json_edges(g: Graph) -> DataFrame:
    """``source, target, relation, line``: every edge as a JSON object with its derived score."""
    cells = F.struct(F.col("source").alias("Source"), F.col("target").alias("Target"), F.col("relation").alias("Relation"), F.col("confidence").alias("Confidence"), confidence_score().alias("confidence_score"))
    return g.edges.select("source", "target", "relation", F.to_json(cells).alias("line"))


def write_json(g: Graph, path: str) -> str:
    """One graph document, nodes by id and edges by (source, target, relation, confidence); streamed row by row to ``path``.

    The document is one local file by definition; for large graphs keep nodes and edges as Parquet (:func:`write_tables`).
    """
    tmp = f"{path}.tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        f.write(f'{{"schema_version": "{SCHEMA_VERSION}",\n"nodes": [\n')
        _lines(f, json_nodes(g).orderBy("id"))
        f.write('],\n"edges": [\n')
        _lines(f, json_edges(g).orderBy("source", "target", "relation", "line"))
        f.write("]")
        if g.hyperedges is not None:
            f.write(',\n"hyperedges": [\n')
            cells = F.struct(F.col("members").alias("Members"), F.col("relation").alias("Relation"), F.col("confidence").alias("Confidence"))
            _lines(f, g.hyperedges.select(F.to_json(cells).alias("line")).orderBy("line"))
            f.write("]")
        if g.commit:
            f.write(f',\n"built_at_commit": "{g.commit}"')
        f.write("}\n")
    os.replace(tmp, path)
    return path


def _lines(f, rows: DataFrame) -> None:
    first = True
    for r in rows.select("line").toLocalIterator(prefetchPartitions=True):
        f.write(("" if first else ",\n") + r.line)
        first = False
    f.write("\n")


def write_tables(g: Graph, path: str) -> None:
    """The graph as Parquet tables, the engine's own format."""
    g.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    g.edges.write.mode("overwrite").parquet(f"{path}/edges")


def _tag(name: str, value: Column) -> Column:
    return F.when(value == "", "").otherwise(F.concat(F.lit(f'<data key="{name}">'), escape_xml(value), F.lit("</data>")))


def graphml_lines(g: Graph) -> DataFrame:
    """``part, k, line`` of a GraphML file in order: head, nodes, edges, tail."""
    spark = g.nodes.sparkSession
    keys = [("label", "node"), ("sourcefile", "node"), ("community", "node"), ("filetype", "node"), ("relation", "edge"), ("confidence", "edge")]
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    head += [f'<key id="{k}" for="{f}" attr.name="{k}" attr.type="string"/>' for k, f in keys] + ['<graph edgedefault="directed">']
    fixed = spark.createDataFrame([(0, f"{i:04d}", x) for i, x in enumerate(head)] + [(3, "0", "</graph>"), (3, "1", "</graphml>")], "part int, k string, line string")
    node = F.concat(F.lit('<node id="'), escape_xml("id"), F.lit('">'), _tag("label", F.col("label")), _tag("sourcefile", F.col("sourcefile")), _tag("community", F.col("community")), _tag("filetype", F.col("filetype")), F.lit("</node>"))
    edge = F.concat(F.lit('<edge source="'), escape_xml("source"), F.lit('" target="'), escape_xml("target"), F.lit('">'), _tag("relation", F.col("relation")), _tag("confidence", confidence_name()), F.lit("</edge>"))
    nodes = g.nodes.select(F.lit(1).alias("part"), F.col("id").alias("k"), node.alias("line"))
    edges = g.edges.select(F.lit(2).alias("part"), F.concat_ws("\u0001", "source", "target", "relation").alias("k"), edge.alias("line"))
    return fixed.unionByName(nodes).unionByName(edges)


def cypher_lines(g: Graph) -> DataFrame:
    """``part, k, line`` of a script that merges all nodes, then all edges."""
    prop = lambda name, c: F.concat(F.lit(f"n.{name} = "), quote_cypher(c))
    node = F.concat(
        F.lit("MERGE (n:Entity {id: "), quote_cypher("id"), F.lit("}) SET "), prop("label", display_label()), F.lit(", "), prop("source_file", "sourcefile"),
        F.lit(", "), prop("community", "community"), F.lit(", "), prop("file_type", "filetype"), F.lit(";"),
    )
    edge = F.concat(
        F.lit("MATCH (a:Entity {id: "), quote_cypher("source"), F.lit("}), (b:Entity {id: "), quote_cypher("target"), F.lit("}) MERGE (a)-[r:"),
        cypher_relation("relation"), F.lit("]->(b) SET r.confidence = "), quote_cypher(confidence_name()), F.lit(";"),
    )
    nodes = g.nodes.select(F.lit(1).alias("part"), F.col("id").alias("k"), node.alias("line"))
    return nodes.unionByName(g.edges.select(F.lit(2).alias("part"), F.concat_ws("\u0001", "source", "target", "relation").alias("k"), edge.alias("line")))


def write_lines(lines: DataFrame, path: str) -> None:
    """Ordered text files below ``path``; concatenated in name order they are the whole."""
    lines.orderBy("part", "k", "line").select("line").write.mode("overwrite").text(path)


def push(g: Graph, connect: Callable[[], Callable[[str, list[dict]], None]], batch: int = 500) -> None:
    """Send nodes, then edges, in batches of rows through connections opened in the tasks.

    ``connect()`` returns ``send(statement, rows)``; statements merge, so a repeated batch does no harm.
    """

    def sender(statement: str):
        def run(rows: Iterator) -> None:
            send, block = connect(), []
            for r in rows:
                block.append(r.asDict())
                if len(block) == batch:
                    send(statement, block)
                    block = []
            if block:
                send(statement, block)

        return run

    g.nodes.foreachPartition(sender("UNWIND $rows AS r MERGE (n:Entity {id: r.id}) SET n += r"))
    edges = g.edges.withColumn("type", cypher_relation("relation")).withColumn("confidence", confidence_name())
    edges.foreachPartition(sender("UNWIND $rows AS r MATCH (a:Entity {id: r.source}), (b:Entity {id: r.target}) MERGE (a)-[x:RELATED {type: r.type}]->(b) SET x.confidence = r.confidence"))
