"""Symbol resolution: synthetic call, type and import targets joined to the declarations they mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalar import import_segments, suffix_overlap
from graphloom.model import EDGE_FIELDS, Graph, key, kind, lang
from graphloom.operators.build import prune_orphan_calls, stored
from graphloom.plans.skew import crowded_keys, salted_join

# Kinds that declare a type.
TYPE_KINDS = ("class", "interface", "struct", "enum", "trait", "type", "protocol", "object", "mixin", "union")
INHERITANCE = ("inherits", "implements", "embeds")


def _stem(path: Column) -> Column:
    """File name without directory and last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*\z", "")


def _dir(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def import_scope(g: Graph) -> DataFrame:
    """``file, word``: every segment of what the modules of a file import."""
    imports = g.edges.where("relation = 'imports'").select("source", F.explode(import_segments(key("target"))).alias("word"))
    owner = g.nodes.where("sourcefile <> ''").select(F.col("id").alias("source"), F.col("sourcefile").alias("file"))
    return imports.join(owner, "source").select("file", "word").distinct()


def _fan_out(edges: DataFrame, candidates: DataFrame, end: str) -> DataFrame:
    """Edges with ``end`` replaced by their candidates (``_eid, to``): one INFERRED, several AMBIGUOUS, none as before."""
    count = candidates.groupBy("_eid").agg(F.count(F.lit(1)).alias("_n"))
    hit = edges.join(count, "_eid").join(candidates, "_eid")
    moved = hit.withColumn(end, F.col("to")).withColumn("confidence", F.when(F.col("_n") == 1, 1).otherwise(2)).drop("to", "_n")
    return moved.unionByName(edges.join(count, "_eid", "left_anti").select(*moved.columns))


def _named(wanted: DataFrame, declared: DataFrame) -> DataFrame:
    """References (``_eid``, l, name) joined with the declarations of that language and name; common names are spread."""
    k = F.concat_ws(":", "l", "name")
    left = wanted.withColumn("_k", k)
    return salted_join(left, declared.withColumn("_k", k).drop("l", "name"), "_k", crowded_keys(left, "_k"), F.col("_eid"))


def _with_id(edges: DataFrame) -> DataFrame:
    return edges.withColumn("_eid", F.sha2(F.concat_ws("\u0001", "source", "target", "relation", F.col("confidence").cast("string")), 256)).dropDuplicates(["_eid"])


def resolve_calls(g: Graph) -> Graph:
    """Retarget ``calls`` edges from ``<lang>:call:<name>`` to functions and methods of that language and label.

    One declaration makes the call INFERRED. Several make it AMBIGUOUS edges to each, unless the caller's file imports the
    called name: then the declarations in imported files are preferred if there are any. None leaves the edge alone.
    Call nodes no edge refers to any more are removed; an ambiguous call keeps its own as anchor.
    """
    calls = _with_id(g.edges.where((F.col("relation") == "calls") & (kind("target") == "call")))
    rest = g.edges.where(~((F.col("relation") == "calls") & (kind("target") == "call")))
    declared = g.nodes.where(kind().isin("function", "method")).select("id", lang().alias("l"), F.col("label").alias("name"), "sourcefile").distinct()
    wanted = calls.select("_eid", "source", lang("target").alias("l"), key("target").alias("name"))
    found = _named(wanted, declared).select("_eid", "source", "name", F.col("id").alias("to"), "sourcefile")

    scope = import_scope(g)
    caller = g.nodes.select(F.col("id").alias("source"), F.col("sourcefile").alias("file")).where("file <> ''").dropDuplicates(["source"])
    several = found.groupBy("_eid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_eid")
    placed = found.join(several, "_eid", "left_semi").join(caller, "source")
    named = placed.join(scope.withColumnRenamed("word", "name"), ["file", "name"], "left_semi").withColumn("word", _stem(F.col("sourcefile")))
    near = named.join(scope, ["file", "word"], "left_semi").select("_eid", "to").distinct()
    narrowed = near.select("_eid").distinct()
    candidates = near.unionByName(found.join(narrowed, "_eid", "left_anti").select("_eid", "to").distinct())

    moved = _fan_out(calls, candidates, "target")
    anchors = calls.join(candidates.groupBy("_eid").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "_eid", "left_semi").select("target").distinct()
    edges = rest.unionByName(moved.select(*EDGE_FIELDS)).distinct()
    pruned = prune_orphan_calls(g.nodes, edges)
    kept = g.nodes.join(anchors.withColumnRenamed("target", "id"), "id", "left_semi").join(pruned.select("id"), "id", "left_anti").select(*g.nodes.columns)
    return g.with_(nodes=pruned.unionByName(kept), edges=edges)


def resolve_methods(g: Graph) -> Graph:
    """Replace ``method_of`` edges (method → typeref) by type ``contains`` method within one directory and language.

    References to no known type are dropped; of several types of a name the one with the greatest id counts.
    """
    owned = g.edges.where("relation = 'method_of'")
    place = g.nodes.select(F.col("id").alias("source"), _dir(F.col("sourcefile")).alias("d")).dropDuplicates(["source"])
    types = g.nodes.where(kind().isin(*TYPE_KINDS)).groupBy(lang().alias("l"), _dir(F.col("sourcefile")).alias("d"), F.col("label").alias("name")).agg(F.max("id").alias("type"))
    wanted = owned.select("source", lang("target").alias("l"), key("target").alias("name")).join(place, "source")
    made = wanted.join(types, ["l", "d", "name"]).select(F.col("type").alias("source"), F.col("source").alias("target"), F.lit("contains").alias("relation"), F.lit(0).alias("confidence"))
    edges = g.edges.where("relation <> 'method_of'").unionByName(made).distinct()
    return g.with_(nodes=prune_orphan_calls(g.nodes, edges, ("typeref",)), edges=edges)


def resolve_inheritance(g: Graph) -> Graph:
    """Retarget inherits, implements and embeds from typerefs to types of that language and name; sources where unique."""
    mask = F.col("relation").isin(*INHERITANCE)
    types = g.nodes.where(kind().isin(*TYPE_KINDS)).select("id", lang().alias("l"), F.col("label").alias("name")).distinct()

    def candidates(edges: DataFrame, end: str) -> DataFrame:
        wanted = edges.where(kind(end) == "typeref").select("_eid", lang(end).alias("l"), key(end).alias("name"))
        return _named(wanted, types).select("_eid", F.col("id").alias("to")).distinct()

    edges = _with_id(g.edges.where(mask))
    moved = _fan_out(edges, candidates(edges, "target"), "target").select(*EDGE_FIELDS)
    again = _with_id(moved)
    single = candidates(again, "source").groupBy("_eid").agg(F.min("to").alias("to"), F.count(F.lit(1)).alias("n")).where("n = 1").select("_eid", "to")
    moved = again.join(single, "_eid", "left").withColumn("source", F.coalesce("to", "source")).select(*EDGE_FIELDS)
    out = g.edges.where(~mask).unionByName(moved).distinct()
    return g.with_(nodes=prune_orphan_calls(g.nodes, out, ("typeref",)), edges=out)


def resolve_imports(g: Graph, least: int = 2) -> Graph:
    """Add INFERRED ``imports`` edges from importers to the modules whose path an import names.

    An import path matches a module if the last segments of the path and of the module's file (without extension) or
    directory agree on at least ``least`` segments, and on all of the path for relative imports, which are first
    joined to the importer's directory. If the whole path matches nothing it is tried without its last segment.
    """
    files = g.nodes.where((kind() == "module") & (F.col("sourcefile") != "")).select("id", lang().alias("l"), "sourcefile").distinct()
    no_ext = F.regexp_replace("sourcefile", r"\.[^./]*\z", "")
    paths = files.select("id", "l", F.explode(F.array_distinct(F.array(no_ext, _dir(F.col("sourcefile"))))).alias("p"))
    modules = paths.select("id", "l", F.filter(F.split("p", "/"), lambda x: x != "").alias("segs")).where(F.size("segs") >= least)
    tail = lambda c: F.array_join(F.slice(F.col(c), -least, least), "/")
    modules = modules.withColumn("b", tail("segs"))

    home = g.nodes.select(F.col("id").alias("source"), _dir(F.col("sourcefile")).alias("d")).dropDuplicates(["source"])
    imports = g.edges.where((F.col("relation") == "imports") & (kind("target") == "import")).select("source", "target").distinct()
    imports = imports.join(home, "source", "left").withColumn("path", key("target"))
    relative = F.startswith("path", F.lit("."))
    rel_path = F.concat_ws("/", F.coalesce("d", F.lit("")), F.regexp_replace("path", r"^[./]+", ""))
    cut_ = F.filter(F.split(F.when(relative, rel_path).otherwise(F.regexp_replace("path", r"\.|::", "/")), "/"), lambda x: x != "")
    dotted = lang("target").isin("py", "java", "kotlin", "scala")
    plain = F.filter(F.split(F.when(relative, rel_path).otherwise(F.col("path")), "/"), lambda x: x != "")
    wanted = imports.select("source", "target", lang("target").alias("l"), F.when(dotted, cut_).otherwise(plain).alias("segs"), relative.alias("rel"))

    def match(w: DataFrame) -> DataFrame:
        w = w.where(F.size("segs") >= least).withColumn("b", tail("segs"))
        m = modules.select("id", "l", "b", F.col("segs").alias("m"))
        overlap = suffix_overlap("segs", "m")
        hit = w.join(m, ["l", "b"]).where(F.when(F.col("rel"), overlap == F.size("segs")).otherwise(overlap >= least))
        return hit.select("source", "target", F.col("id").alias("to"))

    full = match(wanted)
    open_ = wanted.join(full.select("source", "target").distinct(), ["source", "target"], "left_anti").where("not rel")
    shorter = match(open_.withColumn("segs", F.expr("slice(segs, 1, size(segs) - 1)")))
    made = full.unionByName(shorter).where("source <> to").select("source", F.col("to").alias("target")).distinct()
    made = made.select("source", "target", F.lit("imports").alias("relation"), F.lit(1).alias("confidence"))
    return g.with_(edges=g.edges.unionByName(made).distinct())


def resolve_all(g: Graph) -> Graph:
    """All four resolutions in order, each starting from the stored result of the one before."""
    for step in (resolve_calls, resolve_methods, resolve_inheritance, resolve_imports):
        g = stored(step(g))
    return g
