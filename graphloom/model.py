"""The graph model: nodes and edges as DataFrames, identity grammar, adapters.

The empty string is the null of string columns; ``normalise`` enforces that at every entry. Ids are
``<lang>:<kind>:<key>`` with any further colons inside the key.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.tables import table

NODE_FIELDS = ("id", "label", "sourcefile", "sourcelocation", "community", "filetype", "externalurl")
EDGE_FIELDS = ("source", "target", "relation", "confidence")
NODE_SCHEMA = ", ".join(f"{c} string" for c in NODE_FIELDS)
EDGE_SCHEMA = "source string, target string, relation string, confidence int"
HYPEREDGE_SCHEMA = "members array<string>, relation string, confidence int"


@dataclass(frozen=True)
class Graph:
    """An immutable pair of node and edge tables, with optional hyperedges and the commit it was built at."""

    nodes: DataFrame
    edges: DataFrame
    hyperedges: DataFrame | None = None
    commit: str = ""

    def with_(self, **changes) -> Graph:
        return replace(self, **changes)


def normalise_nodes(df: DataFrame) -> DataFrame:
    """The seven node columns in order, missing ones and nulls as ''."""
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in NODE_FIELDS))


def normalise_edges(df: DataFrame) -> DataFrame:
    """The four edge columns in order; null strings become '', a null confidence 0."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in EDGE_FIELDS[:3]]
    confidence = F.coalesce(F.col("confidence").cast("int"), F.lit(0)) if "confidence" in df.columns else F.lit(0)
    return df.select(*text, confidence.alias("confidence"))


def graph(nodes: DataFrame, edges: DataFrame, hyperedges: DataFrame | None = None, commit: str = "") -> Graph:
    return Graph(normalise_nodes(nodes), normalise_edges(edges), hyperedges, commit)


def lang(c: str | Column = "id") -> Column:
    return F.split_part(_c(c), F.lit(":"), F.lit(1))


def kind(c: str | Column = "id") -> Column:
    return F.split_part(_c(c), F.lit(":"), F.lit(2))


def key(c: str | Column = "id") -> Column:
    """All after the second colon; '' if there are fewer than two."""
    return F.regexp_extract(_c(c), r"(?s)^[^:]*:[^:]*:(.*)\z", 1)


def is_lang_id(c: str | Column = "id") -> Column:
    return F.length(_c(c)) - F.length(F.replace(_c(c), F.lit(":"), F.lit(""))) >= 2


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tpch_graph(spark: SparkSession, d: str) -> Graph:
    """The derived graph T: regions, nations, suppliers, customers, orders and parts with six kinds of edges."""
    t = lambda name, *c: table(spark, d, name, *c)
    region, nation = t("region", "r_regionkey", "r_name"), t("nation", "n_nationkey", "n_name", "n_regionkey")
    supplier, customer = t("supplier", "s_suppkey", "s_name", "s_nationkey"), t("customer", "c_custkey", "c_name", "c_nationkey")
    orders, part = t("orders", "o_orderkey", "o_custkey", "o_orderstatus"), t("part", "p_partkey", "p_name", "p_brand")
    items = t("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    place = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")

    def node(df: DataFrame, name: str, key_: str, label: Column, file: Column, filetype: str, community: Column) -> DataFrame:
        return df.select(
            F.concat(F.lit(f"tpch:{name}:"), F.col(key_).cast("string")).alias("id"), label.alias("label"), file.alias("sourcefile"),
            F.lit("").alias("sourcelocation"), community.alias("community"), F.lit(filetype).alias("filetype"), F.lit("").alias("externalurl"),
        )

    n_of = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    in_file = lambda f: F.concat(F.col("r_name"), F.lit(f"/{f}.tbl"))
    placed = lambda df, k: df.join(place, F.col(k) == F.col("n_nationkey"))
    cust = placed(customer, "c_nationkey")
    nodes = (
        node(region, "region", "r_regionkey", F.col("r_name"), F.lit(""), "", F.lit(""))
        .unionByName(node(place, "nation", "n_nationkey", F.col("n_name"), in_file("nation"), "code", n_of))
        .unionByName(node(placed(supplier, "s_nationkey"), "supplier", "s_suppkey", F.col("s_name"), in_file("supplier"), "code", n_of))
        .unionByName(node(cust, "customer", "c_custkey", F.col("c_name"), in_file("customer"), "document", n_of))
        .unionByName(
            node(
                orders.join(cust, orders.o_custkey == cust.c_custkey), "order", "o_orderkey",
                F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")), in_file("orders"), "paper", n_of,
            )
        )
        .unionByName(
            node(part, "part", "p_partkey", F.col("p_name"), F.concat(F.lit("PARTS/"), F.col("p_brand"), F.lit(".tbl")), "code", F.concat(F.lit("b"), F.col("p_brand")))
        )
    )

    def edge(df: DataFrame, a: str, ka: str, b: str, kb: str, relation: str, confidence: Column) -> DataFrame:
        return df.select(
            F.concat(F.lit(f"tpch:{a}:"), F.col(ka).cast("string")).alias("source"),
            F.concat(F.lit(f"tpch:{b}:"), F.col(kb).cast("string")).alias("target"),
            F.lit(relation).alias("relation"),
            confidence.cast("int").alias("confidence"),
        )

    def by_flag(a: str) -> DataFrame:
        flag = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2)
        return items.groupBy(a, "l_partkey").agg(F.min(flag).alias("c"))

    status = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    edges = (
        edge(nation, "region", "n_regionkey", "nation", "n_nationkey", "contains", F.lit(0))
        .unionByName(edge(supplier, "nation", "s_nationkey", "supplier", "s_suppkey", "contains", F.lit(0)))
        .unionByName(edge(customer, "nation", "c_nationkey", "customer", "c_custkey", "contains", F.lit(0)))
        .unionByName(edge(orders, "customer", "o_custkey", "order", "o_orderkey", "calls", status))
        .unionByName(edge(by_flag("l_orderkey"), "order", "l_orderkey", "part", "l_partkey", "references", F.col("c")))
        .unionByName(edge(by_flag("l_suppkey"), "supplier", "l_suppkey", "part", "l_partkey", "inherits", F.col("c")))
    )
    return Graph(nodes, edges)


def project_graph(spark: SparkSession, d: str) -> Graph:
    """The project's own tables as a graph: nodes still alive (first row per id by birth) and all well-formed edges."""
    rows = table(spark, d, "nodes").where("id is not null and id <> '' and removed_at is null")
    nodes = rows.groupBy("id").agg(F.min(F.struct("built_at", "label", "sourcefile", "sourcelocation", "community", "filetype", "externalurl")).alias("m"))
    nodes = nodes.select("id", "m.label", "m.sourcefile", "m.sourcelocation", "m.community", "m.filetype", "m.externalurl")
    edges = table(spark, d, "edges", "source", "target", "relation", "confidence").where("source <> '' and target <> '' and confidence in (0, 1, 2)")
    return graph(nodes, edges)
