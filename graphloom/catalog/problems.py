"""Queries of the general problems: crowded keys (p1), incremental processing (p4), orphan references (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.eager_agg import crowded_endpoints, eager_join_aggregate, endpoint_counts
from graphloom.operators.incremental import ContentState, pending_paths
from graphloom.operators.references import ForeignKey, Table, graph_orphans, orphan_cascade, project_keys
from graphloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query(
    "p1_found",
    """
WITH t AS (SELECT count(*) AS n FROM edges)
SELECT 'source' AS endpoint, source AS node_id FROM edges, t WHERE source <> '' GROUP BY source, t.n HAVING count(*) >= 0.02 * t.n
UNION ALL
SELECT 'target', target FROM edges, t WHERE target <> '' GROUP BY target, t.n HAVING count(*) >= 0.02 * t.n
""",
)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return crowded_endpoints(table(spark, d, "edges", "source", "target"))


@query(
    "p1_counts",
    """
SELECT node_id, relation, sum(o)::BIGINT AS out_n, sum(i)::BIGINT AS in_n FROM (
  SELECT source AS node_id, relation, 1 AS o, 0 AS i FROM edges WHERE source <> ''
  UNION ALL SELECT target, relation, 0, 1 FROM edges WHERE target <> '') GROUP BY ALL
""",
)
def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return endpoint_counts(table(spark, d, "edges", "source", "target", "relation"))


@query(
    "p1_walks",
    """
SELECT a.relation AS l_relation, b.relation AS r_relation, sum(a.n * b.n)::DECIMAL(38,0) AS pairs FROM
  (SELECT target AS k, relation, count(*)::HUGEINT AS n FROM edges WHERE target <> '' GROUP BY ALL) a JOIN
  (SELECT source AS k, relation, count(*)::HUGEINT AS n FROM edges WHERE source <> '' GROUP BY ALL) b USING (k) GROUP BY ALL
""",
)
def p1_walks(spark: SparkSession, d: str) -> DataFrame:
    """Two-step walks per pair of relations: edges joined with edges over their middle node."""
    edges = table(spark, d, "edges", "source", "target", "relation")
    return eager_join_aggregate(edges.where("target <> ''"), edges.where("source <> ''"), "target", "source", ["relation"], ["relation"])


_P4 = """
SELECT key AS path FROM (
  SELECT path AS key, max(struct_pack(s := scanned_at, v := lower(sha256))).v AS hash FROM file_manifest WHERE sha256 IS NOT NULL AND path IS NOT NULL GROUP BY path) m
LEFT JOIN (
  SELECT path AS key, max(struct_pack(s := run_id, v := lower(hash))).v AS old FROM hash_cache
  WHERE run_id IN (SELECT run_id FROM run_log WHERE status = 'ok') AND path IS NOT NULL GROUP BY path) c USING (key)
WHERE NOT coalesce(hash = old, false)
"""


@query("p4_found", _P4)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _pending(spark, d).select(F.col("key").alias("path"))


def _pending(spark: SparkSession, d: str) -> DataFrame:
    return pending_paths(
        table(spark, d, "file_manifest", "path", "scanned_at", "sha256"),
        table(spark, d, "hash_cache", "path", "hash", "run_id"),
        table(spark, d, "run_log", "run_id", "status"),
    )


@query(
    "p4_second_run",
    """
WITH half AS (SELECT min(scanned_at) + (max(scanned_at) - min(scanned_at)) / 2 AS t FROM file_manifest),
early AS (SELECT path AS key, max(struct_pack(s := scanned_at, v := lower(sha256))).v AS hash FROM file_manifest, half WHERE sha256 IS NOT NULL AND path IS NOT NULL AND scanned_at < half.t GROUP BY path),
late AS (SELECT path AS key, max(struct_pack(s := scanned_at, v := lower(sha256))).v AS hash FROM file_manifest WHERE sha256 IS NOT NULL AND path IS NOT NULL GROUP BY path),
cached AS (SELECT path AS key, max(struct_pack(s := run_id, v := lower(hash))).v AS hash FROM hash_cache WHERE run_id IN (SELECT run_id FROM run_log WHERE status = 'ok') AND path IS NOT NULL GROUP BY path)
SELECT key AS path, CASE WHEN early.key IS NULL AND cached.key IS NULL THEN 'new' ELSE 'changed' END AS change
FROM late LEFT JOIN early USING (key) LEFT JOIN cached USING (key) WHERE NOT coalesce(late.hash = coalesce(early.hash, cached.hash), false)
""",
)
def p4_second_run(spark: SparkSession, d: str) -> DataFrame:
    """A run over the scans of the first half of the time, committed, then the run after it over all scans."""
    state = ContentState(spark)
    manifest = table(spark, d, "file_manifest", "path", "scanned_at", "sha256")
    cache, runs = table(spark, d, "hash_cache", "path", "hash", "run_id"), table(spark, d, "run_log", "run_id", "status")
    ends = manifest.agg(F.min("scanned_at").alias("a"), F.max("scanned_at").alias("b")).first()
    if ends.a is not None:
        todo = pending_paths(manifest.where(F.col("scanned_at") < F.lit(ends.a + (ends.b - ends.a) / 2)), cache, runs, state)
        state.commit(todo.select("key", "hash", F.lit(state.next_run()).alias("seen")))
    return pending_paths(manifest, cache, runs, state).select(F.col("key").alias("path"), "change")


_P6 = """
SELECT DISTINCT edge_id, endpoint FROM (
  SELECT edge_id, 'source' AS endpoint, source AS id, built_at FROM edges UNION ALL
  SELECT edge_id, 'target', target, built_at FROM edges) r
WHERE id <> '' AND split_part(id, ':', 2) <> 'link' AND NOT EXISTS (
  SELECT 1 FROM nodes n WHERE n.id = r.id AND n.built_at <= r.built_at AND (n.removed_at IS NULL OR n.removed_at > r.built_at))
"""


def _graph_orphans(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "edges", "edge_id", "source", "target", "built_at")
    return graph_orphans(edges, table(spark, d, "nodes", "id", "sourcefile", "built_at", "removed_at"), _files(spark, d))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files", "path").unionByName(table(spark, d, "documents", "path"))


@query("p6_found", _P6)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _graph_orphans(spark, d).select("edge_id", "endpoint")


@query(
    "p6_by_month",
    f"""SELECT f.endpoint, strftime(e.built_at, '%Y-%m') AS month, count(*) AS n FROM ({_P6}) f
JOIN (SELECT DISTINCT edge_id, built_at FROM edges) e USING (edge_id) GROUP BY ALL""",
)
def p6_by_month(spark: SparkSession, d: str) -> DataFrame:
    return _graph_orphans(spark, d).groupBy("endpoint", F.date_format("built_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def _cascade_sql() -> str:
    files = "(SELECT path FROM source_files UNION SELECT path FROM documents)"
    bad_nodes = f"(SELECT DISTINCT id FROM nodes WHERE sourcefile <> '' AND id IS NOT NULL AND sourcefile NOT IN (SELECT path FROM {files} WHERE path IS NOT NULL))"
    none = "(SELECT '' AS id WHERE false)"

    def part(tbl: str, col: str, period: str, parent: str, key: str, bad: str, where: str = "true", alive: str = "true") -> str:
        there = f"EXISTS (SELECT 1 FROM {parent} p WHERE CAST(p.{key} AS VARCHAR) = c.v AND {alive})"
        return (
            f"SELECT '{tbl}' AS tbl, '{col}' AS \"column\", month, count(*) FILTER (NOT there)::BIGINT AS direct, "
            f"count(*) FILTER (there AND b.id IS NOT NULL)::BIGINT AS inherited, count(*) AS \"references\" FROM ("
            f"SELECT v, {period} AS month, {there} AS there FROM (SELECT *, CAST({col} AS VARCHAR) AS v FROM {tbl} WHERE {where}) c WHERE v <> '') x "
            f"LEFT JOIN {bad} b ON x.v = b.id GROUP BY ALL"
        )

    ym = lambda c: f"strftime(c.{c}, '%Y-%m')"
    lived = "p.built_at <= c.built_at AND (p.removed_at IS NULL OR p.removed_at > c.built_at)"
    no_link = "split_part({0}, ':', 2) <> 'link'"
    return " UNION ALL ".join(
        [
            part("nodes", "sourcefile", ym("built_at"), files, "path", none),
            part("edges", "source", ym("built_at"), "nodes", "id", bad_nodes, no_link.format("source"), lived),
            part("edges", "target", ym("built_at"), "nodes", "id", bad_nodes, no_link.format("target"), lived),
            part("match_pairs", "left_id", ym("matched_at"), "nodes", "id", bad_nodes),
            part("match_pairs", "right_id", ym("matched_at"), "nodes", "id", bad_nodes),
            part("entities", "doc_id", ym("extracted_at"), "documents", "doc_id", none),
            part("hash_cache", "run_id", "CAST(NULL AS VARCHAR)", "run_log", "run_id", none),
        ]
    )


@query("p6_cascade", _cascade_sql())
def p6_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited orphans over the whole foreign-key graph of the project's tables."""
    edges = Table(table(spark, d, "edges", "source", "target", "built_at"), None, "built_at")
    nodes = Table(table(spark, d, "nodes", "id", "sourcefile", "built_at", "removed_at"), "id", "built_at", "built_at", "removed_at")
    tables, keys = project_keys(edges, nodes, Table(_files(spark, d), "path"))
    tables |= {
        "documents": Table(table(spark, d, "documents", "doc_id"), "doc_id"),
        "run_log": Table(table(spark, d, "run_log", "run_id"), "run_id"),
        "match_pairs": Table(table(spark, d, "match_pairs", "left_id", "right_id", "matched_at"), None, "matched_at"),
        "entities": Table(table(spark, d, "entities", "doc_id", "extracted_at"), None, "extracted_at"),
        "hash_cache": Table(table(spark, d, "hash_cache", "run_id"), None, None),
    }
    keys += [
        ForeignKey("match_pairs", "left_id", "nodes"),
        ForeignKey("match_pairs", "right_id", "nodes"),
        ForeignKey("entities", "doc_id", "documents"),
        ForeignKey("hash_cache", "run_id", "run_log"),
    ]
    return orphan_cascade(tables, keys)
