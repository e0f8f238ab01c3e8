"""Graph construction, keyed deduplication, union, merge and the store of several repositories' graphs."""

from __future__ import annotations

import functools
import hashlib
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.scalar import repo_tag_ok, sanitize_text
from graphloom.model import EDGE_FIELDS, NODE_FIELDS, Graph, is_lang_id, kind, normalise_edges, normalise_nodes
from graphloom.operators.components import undirected
from graphloom.plans.scratch import cut
from graphloom.plans.skew import crowded_keys, salted_join

EDGE_KEY = ("source", "target", "relation")


def first_per_key(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One whole row per key: the first (or last) by ``order``. An aggregate, so a key may hold any share of the rows."""
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[F.col(c) for c in order], *[F.col(c).alias(f"_{c}") for c in rest])
    pick = (F.max if last else F.min)(ranked).alias("_m")
    return df.groupBy(*keys).agg(pick).select(*[F.col(c) if c in keys else F.col(f"_m._{c}").alias(c) for c in df.columns])


def build_nodes(raw: DataFrame, order: list[str]) -> DataFrame:
    """Sanitised nodes with id and label; the first write per id (by ``order``) wins."""
    clean = raw.withColumn("label", sanitize_text("label")).withColumn("sourcefile", sanitize_text("sourcefile"))
    return normalise_nodes(first_per_key(clean.where("id <> '' and label <> ''"), ["id"], order))


def build_edges(raw: DataFrame, order: list[str]) -> DataFrame:
    """Valid edges; the first write per (source, target, relation) wins, later confidences are lost."""
    valid = raw.where("source <> '' and target <> '' and relation <> '' and confidence in (0, 1, 2)")
    return normalise_edges(first_per_key(valid, list(EDGE_KEY), order))


def index_nodes(raw: DataFrame, order: list[str]) -> DataFrame:
    """Lookup table of nodes; the last write per id wins."""
    return normalise_nodes(first_per_key(raw, ["id"], order, last=True))


def violations(g: Graph) -> DataFrame:
    """``problem, item`` for everything that makes a graph invalid."""
    n, e = g.nodes, g.edges
    text = lambda p, item: F.struct(F.lit(p).alias("problem"), item.alias("item"))
    edge_name = F.concat_ws(" ", "source", "relation", "target")
    bad_nodes = n.select(F.explode(F.filter(F.array(F.when(F.col("id") == "", text("node without id", F.col("label"))), F.when(F.col("label") == "", text("node without label", F.col("id")))), lambda x: x.isNotNull())).alias("v"))
    checks = F.array(
        F.when((F.col("source") == "") | (F.col("target") == ""), text("edge without endpoint", edge_name)),
        F.when(F.col("relation") == "", text("edge without relation", edge_name)),
        F.when(~F.col("confidence").isin(0, 1, 2), text("unknown confidence", edge_name)),
    )
    bad_edges = e.select(F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("v"))
    ids = n.select("id").distinct()
    ends = e.select(F.explode(F.array("source", "target")).alias("id")).where("id <> ''").groupBy("id").count()
    missing = ends.join(ids, "id", "left_anti").select(F.struct(F.lit("unknown endpoint").alias("problem"), F.col("id").alias("item")).alias("v"))
    return bad_nodes.unionByName(bad_edges).unionByName(missing).select("v.problem", "v.item")


def merge_all(graphs: list[Graph]) -> Graph:
    """Union of graphs: of nodes with one id the earliest graph's stays, edges are distinct with their confidence."""
    numbered = [g.nodes.withColumn("_g", F.lit(i)) for i, g in enumerate(graphs)]
    nodes = first_per_key(functools.reduce(DataFrame.unionByName, numbered), ["id"], ["_g", "label", "sourcefile"]).drop("_g")
    edges = functools.reduce(DataFrame.unionByName, [g.edges for g in graphs]).distinct()
    return Graph(nodes, edges)


def incremental_merge(prior: Graph, following: Graph, current_files: DataFrame | None = None) -> Graph:
    """Fold a partial rebuild into the graph before it.

    Prior nodes of files that are no longer current go (nodes without file stay); nodes of ``following`` win per id;
    an edge of either graph stays if both of its ends do, distinct with its confidence. ``current_files`` has
    ``sourcefile`` and defaults to the files of ``following``.
    """
    files = (following.nodes if current_files is None else current_files).select("sourcefile").where("sourcefile <> ''").distinct()
    kept = prior.nodes.where("sourcefile = ''").unionByName(prior.nodes.where("sourcefile <> ''").join(files, "sourcefile", "left_semi").select(*NODE_FIELDS))
    new_ids = following.nodes.select("id").distinct()
    nodes = kept.join(new_ids, "id", "left_anti").select(*NODE_FIELDS).unionByName(following.nodes)
    edges = between(following.edges.unionByName(prior.edges).distinct(), nodes)
    return Graph(nodes, edges)


def stored(g: Graph) -> Graph:
    """The graph written to the shared folder: what follows starts from tables, not from the plan that made them."""
    return g.with_(nodes=cut(g.nodes.select(*NODE_FIELDS), "nodes"), edges=cut(g.edges.select(*EDGE_FIELDS), "edges"))


def attach(edges: DataFrame, side: DataFrame, end: str, how: str = "inner", base: DataFrame | None = None) -> DataFrame:
    """Join ``edges`` with ``side``, keyed by the column ``end`` of both; crowded ids are spread by their other columns.

    ``base`` is the plain edge table the crowded ids are counted in, where ``edges`` is itself the result of a join.
    """
    other = [c for c in edges.columns if c != end]
    return salted_join(edges, side, end, crowded_keys(edges if base is None else base, end), F.struct(*other), how)


def between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes``."""
    ids = nodes.select("id").distinct()
    inside = attach(edges, ids.withColumnRenamed("id", "source"), "source", "left_semi")
    return attach(inside, ids.withColumnRenamed("id", "target"), "target", "left_semi", edges).select(*edges.columns)


def prefix_graph(g: Graph, tag: str) -> Graph:
    """``<tag>::`` before every id but those of external nodes (nodes without a file); unknown endpoints get it too."""
    p = lambda c: F.concat(F.lit(f"{tag}::"), c)
    outside = g.nodes.where("sourcefile = ''").select(F.col("id").alias("_x")).distinct()
    nodes = g.nodes.withColumn("id", F.when(F.col("sourcefile") == "", F.col("id")).otherwise(p(F.col("id"))))
    edges = g.edges
    for end in ("source", "target"):
        known = outside.select(F.col("_x").alias(end), F.lit(True).alias("_out"))
        edges = attach(edges, known, end, "left", g.edges).withColumn(end, F.when(F.col("_out").isNull(), p(F.col(end))).otherwise(F.col(end))).drop("_out")
    return Graph(nodes, edges.select(*EDGE_FIELDS))


def merge_external(base: Graph, added: Graph) -> Graph:
    """Add a graph, merging its external nodes by label with those known (or with the first of their own)."""
    known = base.nodes.where("sourcefile = ''").groupBy("label").agg(F.min("id").alias("_known"))
    ext = added.nodes.where("sourcefile = ''")
    own = ext.groupBy("label").agg(F.min("id").alias("_own"))
    target = ext.select("id", "label").join(known, "label", "left").join(own, "label").select("id", "label", F.coalesce("_known", "_own").alias("to"), "_known")
    fresh = ext.join(target.where("_known is null and id = to").select("id"), "id", "left_semi").select(*NODE_FIELDS)
    remap = target.where("id <> to").select(F.col("id").alias("_from"), "to").distinct()
    edges = added.edges
    for end in ("source", "target"):
        edges = attach(edges, remap.withColumnRenamed("_from", end), end, "left", added.edges).withColumn(end, F.coalesce("to", end)).drop("to")
    nodes = base.nodes.unionByName(added.nodes.where("sourcefile <> ''")).unionByName(fresh)
    return Graph(nodes, base.edges.unionByName(edges.select(*EDGE_FIELDS)).distinct())


def prune_repo(g: Graph, tag: str) -> Graph:
    """Without one repository: its nodes, every edge that touches them, and external nodes nothing refers to any more."""
    mine = lambda c: F.startswith(F.col(c), F.lit(f"{tag}::"))
    edges = g.edges.where(~mine("source") & ~mine("target"))
    used = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    rest = g.nodes.where(~mine("id"))
    nodes = rest.where("sourcefile <> ''").unionByName(rest.where("sourcefile = ''").join(used, "id", "left_semi").select(*NODE_FIELDS))
    return Graph(nodes, edges)


def prune_orphan_calls(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("call",)) -> DataFrame:
    """``nodes`` without synthetic targets of the given kinds that no edge refers to."""
    used = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    synthetic = kind("id").isin(*kinds)
    return nodes.where(~synthetic).unionByName(nodes.where(synthetic).join(used, "id", "left_semi").select(*nodes.columns))


def expand_hyperedges(hyperedges: DataFrame, cap: int = 8) -> DataFrame:
    """Pairs ``source < target`` of the members of every hyperedge of two to ``cap`` members (no cap if <= 0), distinct."""
    members = F.array_sort(F.array_distinct(F.filter("members", lambda m: m != "")))
    sized = hyperedges.select(members.alias("m")).where((F.size("m") >= 2) & (F.lit(cap <= 0) | (F.size("m") <= cap)))
    first = sized.select("m", F.posexplode("m").alias("i", "source"))
    pairs = first.select("source", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("target"))
    return pairs.distinct().select("source", "target", F.lit("co_member").alias("relation"), F.lit(1).alias("confidence"))


def community_meta_graph(g: Graph, threshold: int = 0) -> Graph:
    """One node per community (label, size) and an edge per pair of communities with the number of edges across.

    For graphs of more than ``threshold`` nodes; smaller ones come back as they are.
    """
    if threshold and g.nodes.limit(threshold + 1).count() <= threshold:
        return g
    named = g.nodes.where("community <> ''").select("id", "community")
    size = named.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    nodes = normalise_nodes(size.select(F.concat(F.lit("community:"), "community").alias("id"), F.format_string("%s (%d)", "community", "n").alias("label"), "community"))
    count = cross_community_counts(g.edges, named)
    edges = count.select(
        F.concat(F.lit("community:"), F.col("a")).alias("source"), F.concat(F.lit("community:"), F.col("b")).alias("target"),
        F.format_string("%d cross-community edges", "n").alias("relation"), F.lit(0).alias("confidence"),
    )
    return Graph(nodes, edges)


def cross_community_counts(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """``a < b, n``: edges between two different communities, in either direction. ``communities`` has id, community."""
    side = lambda end, name: communities.select(F.col("id").alias(end), F.col("community").alias(name))
    ends = edges.select("source", "target")
    joined = attach(attach(ends, side("source", "cs"), "source"), side("target", "ct"), "target", base=ends).where("cs <> ct")
    return joined.groupBy(F.least("cs", "ct").alias("a"), F.greatest("cs", "ct").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def alias_rewrite(g: Graph, rules: list[tuple[str, str]], langs: tuple[str, ...] = ("js", "ts")) -> Graph:
    """Rewrite import specifiers by path aliases: (prefix, target) pairs, ``*`` at the end of a prefix matches any rest.

    The longest matching prefix wins. Nodes ``<lang>:import:<spec>`` and edge targets follow; edge sources do not.
    """
    ordered = sorted(rules, key=lambda r: -len(r[0].rstrip("*")))

    def rewrite(id_: Column) -> Column:
        head = F.concat_ws(":", F.split_part(id_, F.lit(":"), F.lit(1)), F.lit("import"), F.lit(""))
        spec = F.substring(id_, F.length(head) + 1, F.length(id_))
        out = F.lit(None).cast("string")
        for prefix, target in reversed(ordered):
            bare = prefix.rstrip("*")
            rest = F.substring(spec, F.lit(len(bare) + 1), F.length(spec))
            if prefix.endswith("*"):
                hit, new = F.startswith(spec, F.lit(bare)), F.concat(F.lit(target.replace("*", "")), rest)
            else:
                hit = (spec == bare) | F.startswith(spec, F.lit(bare + "/"))
                new = F.concat(F.lit(target), rest)
            out = F.when(hit, new).otherwise(out)
        applies = F.split_part(id_, F.lit(":"), F.lit(1)).isin(*langs) & (kind(id_) == "import") & is_lang_id(id_) & out.isNotNull()
        return F.when(applies, F.concat(head, out))

    moved = rewrite(F.col("id"))
    nodes = g.nodes.withColumn("_to", moved)
    nodes = nodes.withColumn("label", F.when(F.col("_to").isNotNull(), F.regexp_extract("_to", r"(?s)^[^:]*:[^:]*:(.*)\z", 1)).otherwise(F.col("label")))
    nodes = nodes.withColumn("id", F.coalesce("_to", "id")).drop("_to")
    edges = g.edges.withColumn("target", F.coalesce(rewrite(F.col("target")), F.col("target")))
    return Graph(first_per_key(nodes, ["id"], ["label"]), edges)


class GraphStore:
    """Several repositories' graphs in one: Parquet tables beside a JSON manifest, replaced atomically."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        os.makedirs(root, exist_ok=True)
        self.manifest_path = os.path.join(root, "manifest.json")

    def _manifest(self) -> dict:
        if not os.path.exists(self.manifest_path):
            return {"version": 1, "tables": None, "repos": {}}
        with open(self.manifest_path, encoding="utf-8") as f:
            return json.load(f)

    def _write(self, g: Graph, manifest: dict) -> None:
        generation = hashlib.sha256(json.dumps(manifest["repos"], sort_keys=True).encode()).hexdigest()[:16]
        base = os.path.join(self.root, f"g-{generation}")
        g.nodes.write.mode("overwrite").parquet(f"{base}/nodes")
        g.edges.write.mode("overwrite").parquet(f"{base}/edges")
        manifest["tables"] = base
        with open(f"{self.manifest_path}.tmp", "w", encoding="utf-8") as f:
            json.dump(manifest, f, indent=2, sort_keys=True)
        os.replace(f"{self.manifest_path}.tmp", self.manifest_path)

    def load(self) -> Graph | None:
        base = self._manifest()["tables"]
        return base and Graph(self.spark.read.parquet(f"{base}/nodes"), self.spark.read.parquet(f"{base}/edges"))

    def list(self) -> dict:
        return dict(sorted(self._manifest()["repos"].items()))

    def add(self, tag: str, g: Graph, source_hash: str, added_at: str, source_path: str = "") -> bool:
        """Add or replace a repository; False if the same content is there already."""
        if not self.spark.range(1).select(repo_tag_ok(F.lit(tag))).first()[0]:
            raise ValueError(f"not a repository tag: {tag!r}")
        m = self._manifest()
        if m["repos"].get(tag, {}).get("source_hash") == source_hash and m["tables"] and os.path.isdir(m["tables"]):
            return False
        base = self.load()
        prefixed = prefix_graph(g, tag)
        merged = prefixed if base is None else merge_external(prune_repo(base, tag), prefixed)
        m["repos"][tag] = {"added_at": added_at, "source_path": source_path, "source_hash": source_hash, "node_count": g.nodes.count(), "edge_count": g.edges.count()}
        self._write(merged, m)
        return True

    def remove(self, tag: str) -> bool:
        m = self._manifest()
        if tag not in m["repos"]:
            return False
        del m["repos"][tag]
        self._write(prune_repo(self.load(), tag), m)
        return True


def graph_links(g: Graph) -> DataFrame:
    """Distinct undirected links between the graph's edges' different ends."""
    return undirected(g.edges, "source", "target")
