"""The batch build: files to a resolved, deduplicated, clustered graph; updates of it; ingestion of web pages."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import NODE_FIELDS, Graph
from graphloom.operators.build import build_edges, build_nodes, incremental_merge, stored
from graphloom.operators.communities import detect, with_communities
from graphloom.operators.entity_resolution import resolve_entities
from graphloom.operators.incremental import ContentState
from graphloom.operators.resolve import resolve_all
from graphloom.plans.scratch import cut
from graphloom.sources import code, discovery, markup, web
from graphloom.sources.graphjson import load_graph


@dataclass(frozen=True)
class Options:
    """Which stages a build runs."""

    resolve: bool = True
    dedup: bool = True
    cluster: bool = True
    rationale: bool = True


def union(*graphs: Graph) -> Graph:
    """All nodes and edges of several graphs, first write per key (by content where graphs agree on the key)."""
    nodes, edges = graphs[0].nodes, graphs[0].edges
    for g in graphs[1:]:
        nodes, edges = nodes.unionByName(g.nodes), edges.unionByName(g.edges)
    return Graph(build_nodes(nodes, ["label", "sourcefile", "sourcelocation"]), build_edges(edges, ["confidence"]))


def extract_all(files: DataFrame, rationale: bool = True) -> Graph:
    """Graph of code and text documents (path, text)."""
    parts = [code.extract(files), markup.extract_documents(files)]
    if rationale:
        parts.append(markup.rationales(files.where("path rlike '\\\\.[A-Za-z0-9]+$'")))
    return union(*parts)


def finish(g: Graph, options: Options = Options()) -> Graph:
    """Resolution, entity resolution and communities over an extracted graph."""
    g = stored(g)
    if options.resolve:
        g = resolve_all(g)
    if options.dedup:
        g = stored(resolve_entities(g)[0])
    return cluster_only(g) if options.cluster else g


def cluster_only(g: Graph) -> Graph:
    """Communities of a graph that is built already."""
    return with_communities(g, detect(g))


def read_texts(spark: SparkSession, root: str) -> DataFrame:
    """``path, text`` of all files below ``root`` worth extracting."""
    exts = set(code.EXTENSIONS) | set(markup.TEXT_FORMATS)
    return discovery.scan_tree(spark, root, exts).select("path", F.decode("content", "utf-8").alias("text"))


def run(spark: SparkSession, root: str, options: Options = Options()) -> Graph:
    """The whole build of a directory."""
    g = stored(finish(extract_all(read_texts(spark, root), options.rationale), options))
    return g.with_(commit=discovery.head_commit(root))


def update(prior: Graph, files: DataFrame, state: ContentState, options: Options = Options()) -> tuple[Graph, int]:
    """Fold new and changed files (path, text) into ``prior``; the state is committed when the new graph is written.

    Files that are gone leave the graph with their nodes, and the state with their keys. With nothing changed and nothing gone the prior graph comes
    back as it is. Returns the graph and the number of files extracted.
    """
    now = files.where("path is not null and text is not null").select(F.col("path").alias("key"), F.sha2("text", 256).alias("hash"))
    todo = cut(state.changed(now).select("key", "hash"), "todo")
    n = todo.count()
    gone = prior.nodes.where("sourcefile <> ''").select(F.col("sourcefile").alias("path")).distinct().join(files.select("path"), "path", "left_anti")
    lost = state.load().select("key").join(files.select(F.col("path").alias("key")), "key", "left_anti")
    if n == 0 and gone.limit(1).count() == 0 and lost.limit(1).count() == 0:
        return prior, 0
    fresh = stored(extract_all(files.join(todo.select(F.col("key").alias("path")), "path", "left_semi"), options.rationale))
    kept = prior.nodes.join(todo.select(F.col("key").alias("sourcefile")), "sourcefile", "left_anti").select(*NODE_FIELDS)
    merged = incremental_merge(prior.with_(nodes=kept), fresh, files.select(F.col("path").alias("sourcefile")))
    done = stored(finish(merged, options))
    state.commit(todo.withColumn("seen", F.lit(state.next_run()).cast("bigint")), gone=lost)
    return done, n


def ingest(spark: SparkSession, url: str, directory: str, get: Callable[[str], bytes] = web.fetch) -> str:
    """Take in a web page as a Markdown side file with its metadata; returns the file. Done before: nothing is fetched."""
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    target = os.path.join(directory, one(web.side_file(F.lit(url))))
    if os.path.exists(target):
        return target
    page = get(url).decode("utf-8", "replace")
    tags = one(web.og_tags(F.lit(page)))
    head = "".join(f"> {k}: {v}\n" for k, v in tags.asDict().items() if v)
    body = f"---\nsource_url: {url}\n---\n\n" + (head + "\n" if head else "") + one(web.html_to_markdown(F.lit(page))) + "\n"
    os.makedirs(directory, exist_ok=True)
    with open(f"{target}.tmp", "w", encoding="utf-8") as f:
        f.write(body)
    os.replace(f"{target}.tmp", target)
    return target


def load(spark: SparkSession, path: str) -> Graph:
    """A graph document from disk."""
    return load_graph(spark, path)
