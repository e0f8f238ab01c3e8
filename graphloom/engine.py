"""The query surface over one graph snapshot: eight tools, six resources and the viewer's filters."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalar import match_score
from graphloom.model import Graph
from graphloom.operators import analyze
from graphloom.operators.build import between
from graphloom.operators.paths import shortest_path, traverse


class Engine:
    """Queries over a graph; every method returns a DataFrame unless it says otherwise."""

    def __init__(self, g: Graph):
        self.g = g

    def find(self, name: str) -> str | None:
        """Id of a node named by id or, failing that, by label (the least id of several)."""
        n = self.g.nodes.where((F.col("id") == name) | (F.col("label") == name))
        hit = n.orderBy((F.col("id") != name).cast("int"), "id").select("id").limit(1).collect()
        return hit[0].id if hit else None

    def god_nodes(self, limit: int = 10) -> DataFrame:
        return analyze.god_nodes(self.g, limit)

    def search(self, text: str, limit: int = 25) -> DataFrame:
        """``id, label, degree, score``: best matches of a text in label, id or file, the connected ones first."""
        scored = analyze.node_degrees(self.g).withColumn("m", match_score(F.lit(text))).where("m > 0")
        scored = scored.withColumn("score", F.col("m") * 10 + F.least("degree", F.lit(9).cast("bigint")))
        return scored.orderBy(F.desc("score"), "id").limit(limit).select("id", "label", "degree", "score")

    def explain(self, name: str) -> DataFrame:
        """``direction, relation, other, confidence`` of every edge of a node; a loop shows in both directions."""
        x = self.find(name) or ""
        e = self.g.edges
        out = e.where(F.col("source") == x).select(F.lit("out").alias("direction"), "relation", F.col("target").alias("other"), "confidence")
        return out.unionByName(e.where(F.col("target") == x).select(F.lit("in").alias("direction"), "relation", F.col("source").alias("other"), "confidence"))

    def collisions(self, label: str) -> DataFrame:
        """All nodes of one label."""
        return self.g.nodes.where(F.col("label") == label).select("id", "label", "sourcefile")

    def neighbors(self, name: str, relation: str | None = None) -> DataFrame:
        """``direction, relation, id, label``: adjoining nodes, by relation and direction."""
        e = self.explain(name)
        if relation:
            e = e.where(F.col("relation") == relation)
        labels = self.g.nodes.select(F.col("id").alias("other"), "label")
        return e.select("direction", "relation", "other").distinct().join(labels, "other", "left").select("direction", "relation", F.col("other").alias("id"), F.coalesce("label", "other").alias("label"))

    def community(self, name: str, limit: int = 50) -> DataFrame:
        """``id, label, members``: a community named by itself or by one of its nodes, with its full size."""
        n = self.g.nodes
        if not n.where((F.col("community") == name) & (F.col("community") != "")).limit(1).count():
            x = self.find(name)
            own = n.where(F.col("id") == (x or "")).select("community").limit(1).collect()
            name = own[0].community if own else ""
        inside = n.where((F.col("community") == name) & (F.col("community") != ""))
        size = inside.count()
        return inside.orderBy("label", "id").limit(limit).select("id", "label", F.lit(size).cast("bigint").alias("members"))

    def path(self, source: str, target: str) -> DataFrame:
        return shortest_path(self.g, self.find(source) or source, self.find(target) or target)

    def traverse(self, name: str, depth: int = 2, limit: int = 50) -> DataFrame:
        return traverse(self.g, self.find(name) or name, depth, limit)

    def stats(self) -> DataFrame:
        return analyze.graph_stats(self.g)

    def subgraph(self, label: str = "", communities: list[str] | None = None) -> Graph:
        """The viewer's filter: known ends only; with ``label`` edges with either end matching, with ``communities`` edges
        with both ends inside, and the nodes those edges leave visible."""
        nodes, edges = self.g.nodes, between(self.g.edges, self.g.nodes)
        if communities is not None:
            nodes = nodes.where(F.col("community").isin(communities))
            edges = between(edges, nodes)
        if label:
            hit = nodes.where(F.contains(F.lower("label"), F.lower(F.lit(label)))).select("id").distinct()
            out = edges.join(hit.withColumnRenamed("id", "source"), "source", "left_semi").select(*edges.columns)
            into = edges.join(hit.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)
            edges = out.unionByName(into).distinct()
            seen = edges.select(F.explode(F.array("source", "target")).alias("id")).unionByName(hit).distinct()
            nodes = nodes.join(seen, "id", "left_semi").select(*nodes.columns)
        return Graph(nodes, edges)

    def resource(self, name: str) -> str:
        """A resource as JSON text: stats, god-nodes, surprising-links, questions, audit or report."""
        made = {
            "stats": self.stats,
            "god-nodes": self.god_nodes,
            "surprising-links": lambda: analyze.surprising_links(self.g),
            "questions": lambda: analyze.questions(self.g),
            "audit": lambda: analyze.confidence_summary(self.g.edges),
        }
        if name == "report":
            from graphloom.sinks.report import report

            return json.dumps({"report": report(self.g)})
        return json.dumps([r.asDict() for r in made[name]().collect()], ensure_ascii=False, sort_keys=True)

    TOOLS = ("god_nodes", "explain", "query", "path", "get_neighbors", "get_community", "traverse", "graph_stats")
    RESOURCES = ("report", "stats", "god-nodes", "surprising-links", "questions", "audit")

    def call(self, tool: str, args: dict) -> list[dict]:
        """Run a tool by name with its JSON arguments; rows as dicts."""
        made = {
            "god_nodes": lambda: self.god_nodes(args.get("limit", 10)),
            "explain": lambda: self.explain(args["id"]),
            "query": lambda: self.search(args["text"], args.get("limit", 25)),
            "path": lambda: self.path(args["source"], args["target"]),
            "get_neighbors": lambda: self.neighbors(args["id"], args.get("relation")),
            "get_community": lambda: self.community(args["id"], args.get("limit", 50)),
            "traverse": lambda: self.traverse(args["id"], args.get("depth", 2), args.get("limit", 50)),
            "graph_stats": self.stats,
        }
        return [r.asDict() for r in made[tool]().collect()]

    def handle(self, line: str) -> str | None:
        """Answer one JSON-RPC 2.0 request line; None for notifications."""
        # The protocol's error codes.
        parse_error, no_method, bad_params, internal = -32700, -32601, -32602, -32603
        answer = lambda id_, **x: json.dumps({"jsonrpc": "2.0", "id": id_, **x}, ensure_ascii=False)
        fail = lambda id_, code, text: answer(id_, error={"code": code, "message": text})
        try:
            request = json.loads(line)
        except ValueError:
            return fail(None, parse_error, "not JSON")
        id_, method, params = request.get("id"), request.get("method"), request.get("params") or {}
        if id_ is None:
            return None
        try:
            if method == "initialize":
                return answer(id_, result={"protocolVersion": "2024-11-05", "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": "graphloom", "version": "1"}})
            if method == "tools/list":
                return answer(id_, result={"tools": [{"name": t} for t in self.TOOLS]})
            if method == "resources/list":
                return answer(id_, result={"resources": [{"uri": f"graph://{r}", "name": r} for r in self.RESOURCES]})
            if method == "tools/call":
                if params.get("name") not in self.TOOLS:
                    return fail(id_, bad_params, "unknown tool")
                rows = self.call(params["name"], params.get("arguments") or {})
                return answer(id_, result={"content": [{"type": "text", "text": json.dumps(rows, ensure_ascii=False)}]})
            if method == "resources/read":
                name = str(params.get("uri", "")).removeprefix("graph://")
                if name not in self.RESOURCES:
                    return fail(id_, bad_params, "unknown resource")
                return answer(id_, result={"contents": [{"uri": params["uri"], "text": self.resource(name)}]})
        except KeyError as e:
            return fail(id_, bad_params, f"missing argument {e}")
        except Exception as e:
            return fail(id_, internal, str(e)[:300])
        return fail(id_, no_method, f"unknown method {method}")
