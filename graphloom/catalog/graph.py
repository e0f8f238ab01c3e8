"""Queries of the graph operators over graph T (derived from the star schema) and the project graph P."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.model import Graph, project_graph, tpch_graph
from graphloom.operators import analyze, build, diff
from graphloom.operators.centrality import betweenness, bridge_nodes
from graphloom.operators.communities import detect, split_communities
from graphloom.operators.components import components
from graphloom.operators.entity_resolution import exact_links, fuzzy_matches, resolve_entities
from graphloom.operators.paths import bounded_levels, k_hop
from graphloom.operators.resolve import resolve_calls, resolve_imports, resolve_inheritance, resolve_methods
from graphloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

T = """
place AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
n AS (
  SELECT 'tpch:region:' || r_regionkey AS id, r_name AS label, '' AS sourcefile, '' AS community, '' AS filetype FROM region
  UNION ALL SELECT 'tpch:nation:' || n_nationkey, n_name, r_name || '/nation.tbl', 'n' || n_nationkey, 'code' FROM place
  UNION ALL SELECT 'tpch:supplier:' || s_suppkey, s_name, r_name || '/supplier.tbl', 'n' || s_nationkey, 'code' FROM supplier JOIN place ON s_nationkey = n_nationkey
  UNION ALL SELECT 'tpch:customer:' || c_custkey, c_name, r_name || '/customer.tbl', 'n' || c_nationkey, 'document' FROM customer JOIN place ON c_nationkey = n_nationkey
  UNION ALL SELECT 'tpch:order:' || o_orderkey, 'Order#' || o_orderkey, r_name || '/orders.tbl', 'n' || c_nationkey, 'paper' FROM orders JOIN customer ON o_custkey = c_custkey JOIN place ON c_nationkey = n_nationkey
  UNION ALL SELECT 'tpch:part:' || p_partkey, p_name, 'PARTS/' || p_brand || '.tbl', 'b' || p_brand, 'code' FROM part),
e AS (
  SELECT 'tpch:region:' || n_regionkey AS source, 'tpch:nation:' || n_nationkey AS target, 'contains' AS relation, 0 AS confidence FROM nation
  UNION ALL SELECT 'tpch:nation:' || s_nationkey, 'tpch:supplier:' || s_suppkey, 'contains', 0 FROM supplier
  UNION ALL SELECT 'tpch:nation:' || c_nationkey, 'tpch:customer:' || c_custkey, 'contains', 0 FROM customer
  UNION ALL SELECT 'tpch:customer:' || o_custkey, 'tpch:order:' || o_orderkey, 'calls', CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END FROM orders
  UNION ALL SELECT 'tpch:order:' || l_orderkey, 'tpch:part:' || l_partkey, 'references', min(CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END) FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT 'tpch:supplier:' || l_suppkey, 'tpch:part:' || l_partkey, 'inherits', min(CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END) FROM lineitem GROUP BY l_suppkey, l_partkey),
deg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY id),
nd AS (SELECT n.*, coalesce(degree, 0) AS degree FROM n LEFT JOIN deg USING (id))"""
P = """
n AS (SELECT id, coalesce(m.label, '') AS label, coalesce(m.sourcefile, '') AS sourcefile, coalesce(m.community, '') AS community, coalesce(m.filetype, '') AS filetype, coalesce(m.externalurl, '') AS externalurl, coalesce(m.sourcelocation, '') AS sourcelocation FROM (
  SELECT id, min(struct_pack(built_at := built_at, label := label, sourcefile := sourcefile, sourcelocation := sourcelocation, community := community, filetype := filetype, externalurl := externalurl)) AS m
  FROM nodes WHERE id <> '' AND removed_at IS NULL GROUP BY id)),
e AS (SELECT source, target, coalesce(relation, '') AS relation, confidence FROM edges WHERE source <> '' AND target <> '' AND confidence IN (0, 1, 2)),
deg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY id),
nd AS (SELECT n.*, coalesce(degree, 0) AS degree FROM n LEFT JOIN deg USING (id))"""
STUB = "(split_part(id, ':', 2) = 'module' OR (label LIKE '.%()') OR (label LIKE '%()' AND degree <= 1))"
NAME = "coalesce(nullif(label, ''), id)"


def query(name: str, sql: str | None = None, base: str = T, recursive: bool = False):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = f"WITH {'RECURSIVE ' if recursive else ''}{base}{', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().removeprefix('+')}" if base else sql
        return f

    return add


def stored_tpch(spark: SparkSession, d: str) -> Graph:
    """Graph T written once, for queries that pass over it several times."""
    return build.stored(tpch_graph(spark, d))


@query("degree", "SELECT id, degree FROM deg")
def degree(spark: SparkSession, d: str) -> DataFrame:
    return analyze.degrees(tpch_graph(spark, d).edges)


_GOD = f"""+ real AS (SELECT id, label, degree FROM nd WHERE NOT {STUB} AND degree > 0),
r AS (SELECT row_number() OVER (ORDER BY degree DESC, id)::INT AS rank, id, label, degree FROM real)
SELECT * FROM r WHERE rank <= 10 AND rank <= (SELECT greatest(1, count(*) // 5) FROM real)"""


@query("god_nodes", _GOD)
def god_nodes(spark: SparkSession, d: str) -> DataFrame:
    return analyze.god_nodes(tpch_graph(spark, d))


@query("god_nodes_project", _GOD, P)
def god_nodes_project(spark: SparkSession, d: str) -> DataFrame:
    return analyze.god_nodes(project_graph(spark, d))


@query("confidence_summary", "SELECT CASE confidence WHEN 0 THEN 'EXTRACTED' WHEN 1 THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS confidence, count(*) AS n FROM e GROUP BY 1")
def confidence_summary(spark: SparkSession, d: str) -> DataFrame:
    return analyze.confidence_summary(tpch_graph(spark, d).edges)


@query(
    "graph_stats",
    """SELECT 'total' AS section, 'nodes' AS name, count(*) AS n FROM n UNION ALL SELECT 'total', 'edges', count(*) FROM e
UNION ALL SELECT 'total', 'communities', count(DISTINCT community) FROM n WHERE community <> ''
UNION ALL SELECT 'filetype', filetype, count(*) FROM n WHERE filetype <> '' GROUP BY filetype UNION ALL SELECT 'relation', relation, count(*) FROM e GROUP BY relation""",
)
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return analyze.graph_stats(tpch_graph(spark, d))


_ENDS = """+ x AS (SELECT e.*, coalesce(s.community, '') AS sc, coalesce(t.community, '') AS tc, coalesce(s.filetype, '') AS sf, coalesce(t.filetype, '') AS tf,
  coalesce(s.sourcefile, '') AS ss, coalesce(t.sourcefile, '') AS ts, coalesce(s.degree, 0) AS sd, coalesce(t.degree, 0) AS td
  FROM e LEFT JOIN nd s ON e.source = s.id LEFT JOIN nd t ON e.target = t.id)"""
_TOP = "CASE WHEN {0} LIKE '%/%' THEN split_part({0}, '/', 1) ELSE '' END"
_SURPRISE = _ENDS + f""", p AS (SELECT *, CASE WHEN confidence = 1 AND relation = 'calls' AND source LIKE '%:%' AND target LIKE '%:%' AND split_part(source, ':', 1) <> split_part(target, ':', 1) THEN 0
    WHEN confidence = 2 THEN 3 WHEN confidence = 1 THEN 2 ELSE 1 END + CASE WHEN sf <> '' AND tf <> '' AND sf <> tf THEN 2 ELSE 0 END
    + CASE WHEN ss <> '' AND ts <> '' AND ({_TOP.format('ss')}) <> ({_TOP.format('ts')}) THEN 2 ELSE 0 END AS raw FROM x WHERE sc <> '' AND tc <> '' AND sc <> tc),
q AS (SELECT *, (CASE WHEN relation = 'semantically_similar_to' THEN raw * 3 // 2 ELSE raw END + CASE WHEN least(sd, td) <= 2 AND greatest(sd, td) >= 5 THEN 1 ELSE 0 END)::INT AS score,
  1.0::DOUBLE / (log2(sd + 2) * log2(td + 2)) AS rarity FROM p)
SELECT row_number() OVER (ORDER BY score DESC, rarity DESC, source, target, relation, confidence)::INT AS rank, source, target, relation, confidence, score FROM q ORDER BY rank LIMIT 10"""


@query("surprising_links", _SURPRISE)
def surprising_links(spark: SparkSession, d: str) -> DataFrame:
    return analyze.surprising_links(stored_tpch(spark, d))


_INSIDE = """+ c AS (SELECT id, community FROM n WHERE community <> ''), size AS (SELECT community, count(*) AS size FROM c GROUP BY 1),
links AS (SELECT a.community, count(*) AS links FROM (SELECT DISTINCT least(source, target) AS u, greatest(source, target) AS v FROM e WHERE source <> target) x
  JOIN c a ON x.u = a.id JOIN c b ON x.v = b.id WHERE a.community = b.community GROUP BY 1),
coh AS (SELECT community, size, CASE WHEN size <= 1 THEN 1.0 ELSE coalesce(links, 0)::DOUBLE / (size * (size - 1) // 2) END::DOUBLE AS cohesion FROM size LEFT JOIN links USING (community))"""


@query("cohesion", _INSIDE + "SELECT * FROM coh")
def cohesion(spark: SparkSession, d: str) -> DataFrame:
    return analyze.cohesion(stored_tpch(spark, d))


@query("low_cohesion", _INSIDE + "SELECT * FROM coh WHERE size >= 5 AND cohesion < 0.05")
def low_cohesion(spark: SparkSession, d: str) -> DataFrame:
    return analyze.low_cohesion(stored_tpch(spark, d))


_HUB = f"""+ h AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY degree DESC, {NAME}, id) AS i FROM nd WHERE community <> '')"""


@query("community_hubs", _HUB + f"SELECT community, id, {NAME} AS label, degree FROM h WHERE i = 1 AND degree > 0 ORDER BY degree DESC, community LIMIT 25")
def community_hubs(spark: SparkSession, d: str) -> DataFrame:
    return analyze.community_hubs(tpch_graph(spark, d))


@query("community_labels", _HUB + f"SELECT community, {NAME} AS name FROM h WHERE i = 1")
def community_labels(spark: SparkSession, d: str) -> DataFrame:
    return analyze.community_labels(tpch_graph(spark, d))


@query(
    "community_members",
    f"""+ m AS (SELECT community, {NAME} AS label, id, row_number() OVER (PARTITION BY community ORDER BY {NAME}, id) AS i, count(*) OVER (PARTITION BY community) AS size FROM n WHERE community <> '')
SELECT community, any_value(size) AS size, string_agg(label, ', ' ORDER BY i) AS members FROM m WHERE i <= 5 GROUP BY community""",
)
def community_members(spark: SparkSession, d: str) -> DataFrame:
    return analyze.community_members(tpch_graph(spark, d))


@query(
    "community_audit",
    _ENDS
    + """, y AS (SELECT confidence, sc AS community FROM x WHERE sc <> '' UNION ALL SELECT confidence, tc FROM x WHERE tc <> '' AND tc <> sc),
z AS (SELECT community, count(*) FILTER (confidence = 0) AS extracted, count(*) FILTER (confidence = 1) AS inferred, count(*) FILTER (confidence = 2) AS ambiguous, count(*) AS total FROM y GROUP BY 1)
SELECT *, extracted * 100 // total AS extracted_pct, inferred * 100 // total AS inferred_pct, ambiguous * 100 // total AS ambiguous_pct FROM z""",
)
def community_audit(spark: SparkSession, d: str) -> DataFrame:
    return analyze.community_audit(stored_tpch(spark, d))


_CROSS = "SELECT least(s.community, t.community) AS a, greatest(s.community, t.community) AS b, count(*) AS n FROM e JOIN n s ON e.source = s.id JOIN n t ON e.target = t.id WHERE s.community <> '' AND t.community <> '' AND s.community <> t.community GROUP BY 1, 2"


@query("cross_community", _CROSS)
def cross_community(spark: SparkSession, d: str) -> DataFrame:
    return analyze.cross_community(stored_tpch(spark, d))


@query(
    "meta_graph",
    f"SELECT 'community:' || a AS source, 'community:' || b AS target, n || ' cross-community edges' AS relation, 0 AS confidence FROM ({_CROSS})",
)
def meta_graph(spark: SparkSession, d: str) -> DataFrame:
    return build.community_meta_graph(stored_tpch(spark, d)).edges


@query(
    "corpus_figures",
    """+ f AS (SELECT sourcefile, min(filetype) AS filetype FROM n WHERE sourcefile <> '' GROUP BY 1)
SELECT 'files' AS section, 'total' AS name, count(*) AS n FROM f UNION ALL SELECT 'files', 'tiny', CASE WHEN count(*) < 3 THEN 1 ELSE 0 END FROM f
UNION ALL SELECT 'files', 'extensions', count(DISTINCT regexp_extract(sourcefile, '(\\.[^./]*)$', 1)) FROM f WHERE regexp_extract(sourcefile, '(\\.[^./]*)$', 1) <> ''
UNION ALL SELECT 'filetype', filetype, count(*) FROM f GROUP BY filetype""",
    P,
)
def corpus_figures(spark: SparkSession, d: str) -> DataFrame:
    return analyze.corpus_figures(project_graph(spark, d))


@query(
    "knowledge_gaps",
    "SELECT (SELECT count(*) FROM nd WHERE degree = 0) AS isolated, (SELECT count(*) FROM (SELECT community FROM n WHERE community <> '' GROUP BY 1 HAVING count(*) < 2)) AS thin_communities, (SELECT count(*) FROM e WHERE confidence = 2) AS ambiguous",
    P,
)
def knowledge_gaps(spark: SparkSession, d: str) -> DataFrame:
    return analyze.knowledge_gaps(project_graph(spark, d))


@query("isolated_nodes", "SELECT id, label FROM nd WHERE degree = 0", P)
def isolated_nodes(spark: SparkSession, d: str) -> DataFrame:
    return analyze.isolated_nodes(project_graph(spark, d))


@query("ambiguous_edges", "SELECT source, target, relation, confidence FROM e WHERE confidence = 2 ORDER BY source, target, relation LIMIT 25")
def ambiguous_edges(spark: SparkSession, d: str) -> DataFrame:
    return analyze.ambiguous_edges(tpch_graph(spark, d))


_CNAME = "CASE confidence WHEN 0 THEN 'EXTRACTED' WHEN 1 THEN 'INFERRED' ELSE 'AMBIGUOUS' END"


@query(
    "dominant_confidence",
    f"""+ y AS (SELECT source AS id, {_CNAME} AS c FROM e UNION ALL SELECT target, {_CNAME} FROM e WHERE target <> source), k AS (SELECT id, c, count(*) AS n FROM y GROUP BY 1, 2)
SELECT id, c AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, c) AS i FROM k) WHERE i = 1""",
)
def dominant_confidence(spark: SparkSession, d: str) -> DataFrame:
    return analyze.dominant_confidence(tpch_graph(spark, d))


@query(
    "sections",
    """+ s AS (SELECT CASE community WHEN '' THEN 'uncategorized' ELSE community END AS section, coalesce(list_extract(string_split(sourcefile, '/'), -2), '') AS dir FROM n),
m AS (SELECT section, dir, row_number() OVER (PARTITION BY section ORDER BY count(*) DESC, dir) AS i FROM s WHERE dir <> '' GROUP BY section, dir)
SELECT a.section, a.size, coalesce(m.dir, a.section) AS name FROM (SELECT section, count(*) AS size FROM s GROUP BY 1) a LEFT JOIN m ON a.section = m.section AND m.i = 1 ORDER BY a.size DESC, a.section LIMIT 15""",
)
def sections(spark: SparkSession, d: str) -> DataFrame:
    return analyze.sections(tpch_graph(spark, d))


@query(
    "section_flow",
    _ENDS
    + """, y AS (SELECT CASE sc WHEN '' THEN 'uncategorized' ELSE sc END AS a, CASE tc WHEN '' THEN 'uncategorized' ELSE tc END AS b, relation FROM x),
k AS (SELECT a, b, relation, count(*) AS c FROM y WHERE a <> b GROUP BY ALL)
SELECT a, b, n::BIGINT AS n, relation FROM (SELECT *, sum(c) OVER (PARTITION BY a, b) AS n, row_number() OVER (PARTITION BY a, b ORDER BY c DESC, relation) AS i FROM k) WHERE i = 1""",
)
def section_flow(spark: SparkSession, d: str) -> DataFrame:
    return analyze.section_flow(stored_tpch(spark, d))


@query(
    "section_diagram",
    _ENDS
    + """, y AS (SELECT sc AS section, source AS id FROM x WHERE sc = tc AND sc <> '' UNION ALL SELECT sc, target FROM x WHERE sc = tc AND sc <> '')
SELECT section, id, rank FROM (SELECT section, id, row_number() OVER (PARTITION BY section ORDER BY count(*) DESC, id)::INT AS rank FROM y GROUP BY section, id) WHERE rank <= 18""",
)
def section_diagram(spark: SparkSession, d: str) -> DataFrame:
    return analyze.section_diagram(stored_tpch(spark, d))


@query(
    "questions",
    _INSIDE
    + f""", parts AS (
  SELECT 0 AS seq, row_number() OVER (ORDER BY degree DESC, id) AS i, 2 AS most, 'hub' AS kind, 'Why do ' || degree || ' links meet at ' || {NAME} || '?' AS question FROM nd WHERE NOT {STUB} AND degree > 0
  UNION ALL SELECT 1, row_number() OVER (ORDER BY source, target, relation), 2, 'ambiguous', 'Which is meant where ' || source || ' ' || relation || ' ' || target || '?' FROM e WHERE confidence = 2
  UNION ALL SELECT 2, row_number() OVER (ORDER BY source, target, relation), 2, 'inferred', 'Is it true that ' || source || ' ' || relation || ' ' || target || '?' FROM e WHERE confidence = 1
  UNION ALL SELECT 3, row_number() OVER (ORDER BY id), 2, 'isolated', 'What should ' || {NAME} || ' be connected to?' FROM nd WHERE NOT {STUB} AND degree = 0
  UNION ALL SELECT 4, row_number() OVER (ORDER BY community), 10, 'cohesion', 'Is ' || community || ' one subject or several?' FROM coh WHERE size >= 5 AND cohesion < 0.05)
SELECT rank, kind, question FROM (SELECT row_number() OVER (ORDER BY seq, i)::INT AS rank, kind, question FROM parts WHERE i <= most) WHERE rank <= 10""",
)
def questions(spark: SparkSession, d: str) -> DataFrame:
    return analyze.questions(stored_tpch(spark, d))


# The query tools.
_SCORE = "CASE WHEN lower(label) = 'europe' THEN 100 WHEN starts_with(lower(label), 'europe') THEN 50 WHEN contains(lower(label), 'europe') THEN 25 WHEN contains(lower(id), 'europe') THEN 15 WHEN contains(lower(sourcefile), 'europe') THEN 10 ELSE 0 END"


@query("search", f"SELECT id, label, degree, {_SCORE} * 10 + least(degree, 9) AS score FROM nd WHERE {_SCORE} > 0 ORDER BY score DESC, id LIMIT 25")
def search(spark: SparkSession, d: str) -> DataFrame:
    return Engine(tpch_graph(spark, d)).search("EUROPE")


@query(
    "explain_edges",
    "SELECT 'out' AS direction, relation, target AS other, confidence FROM e WHERE source = 'tpch:supplier:3' UNION ALL SELECT 'in', relation, source, confidence FROM e WHERE target = 'tpch:supplier:3'",
)
def explain_edges(spark: SparkSession, d: str) -> DataFrame:
    return Engine(tpch_graph(spark, d)).explain("tpch:supplier:3")


@query(
    "neighbors",
    """+ y AS (SELECT DISTINCT 'out' AS direction, relation, target AS id FROM e WHERE source = 'tpch:nation:7' UNION SELECT 'in', relation, source FROM e WHERE target = 'tpch:nation:7')
SELECT direction, relation, y.id, coalesce(n.label, y.id) AS label FROM y LEFT JOIN n USING (id)""",
)
def neighbors(spark: SparkSession, d: str) -> DataFrame:
    return Engine(stored_tpch(spark, d)).neighbors("tpch:nation:7")


@query("community_of", "SELECT id, label, (SELECT count(*) FROM n WHERE community = 'n7') AS members FROM n WHERE community = 'n7' ORDER BY label, id LIMIT 50")
def community_of(spark: SparkSession, d: str) -> DataFrame:
    return Engine(stored_tpch(spark, d)).community("tpch:nation:7")


_ARCS = "+ arc AS (SELECT source AS x, target AS y FROM e UNION SELECT target, source FROM e), r AS (SELECT 'tpch:nation:7' AS id, 0 AS hop UNION SELECT y, hop + 1 FROM r JOIN arc ON r.id = arc.x WHERE hop < {0}), near AS (SELECT id, min(hop) AS hop FROM r GROUP BY id)"


@query("traverse_2hop", _ARCS.format(2) + " SELECT hop, id, label FROM near JOIN n USING (id) ORDER BY hop, label, id LIMIT 50", recursive=True)
def traverse_2hop(spark: SparkSession, d: str) -> DataFrame:
    return Engine(stored_tpch(spark, d)).traverse("tpch:nation:7")


@query("k_hop_levels", _ARCS.format(3) + " SELECT hop, count(*) AS n FROM near GROUP BY hop", recursive=True)
def k_hop_levels(spark: SparkSession, d: str) -> DataFrame:
    return bounded_levels(tpch_graph(spark, d), "tpch:nation:7", 3)


@query(
    "k_hop_tree",
    _ARCS.format(2) + " SELECT v.id, v.hop, coalesce(min(u.id) FILTER (v.hop > 0), '') AS via FROM near v LEFT JOIN arc ON arc.y = v.id LEFT JOIN near u ON arc.x = u.id AND u.hop = v.hop - 1 GROUP BY v.id, v.hop",
    recursive=True,
)
def k_hop_tree(spark: SparkSession, d: str) -> DataFrame:
    return k_hop(tpch_graph(spark, d), ["tpch:nation:7"], 2)


@query(
    "shortest_path",
    """+ arc AS (SELECT source AS x, target AS y FROM e UNION SELECT target, source FROM e),
r AS (SELECT ['tpch:region:0'] AS p, 'tpch:region:0' AS id UNION ALL SELECT list_append(p, y), y FROM r JOIN arc ON r.id = arc.x WHERE len(p) < 5 AND NOT list_contains(p, y)
  AND split_part(y, ':', 2) = CASE len(p) WHEN 1 THEN 'nation' WHEN 2 THEN 'customer' WHEN 3 THEN 'order' ELSE '' END),
best AS (SELECT min(p) AS p FROM r WHERE id = 'tpch:order:0')
SELECT (generate_subscripts(p, 1) - 1)::INT AS step, unnest(p) AS id FROM best""",
    recursive=True,
)
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    return Engine(stored_tpch(spark, d)).path("tpch:region:0", "tpch:order:0")


@query(
    "viewer_filter",
    """SELECT DISTINCT source, target, relation, confidence FROM e WHERE (source IN (SELECT id FROM n WHERE community IN ('n7', 'n8') AND contains(lower(label), 'order#1')) OR target IN (SELECT id FROM n WHERE community IN ('n7', 'n8') AND contains(lower(label), 'order#1')))
AND source IN (SELECT id FROM n WHERE community IN ('n7', 'n8')) AND target IN (SELECT id FROM n WHERE community IN ('n7', 'n8'))""",
)
def viewer_filter(spark: SparkSession, d: str) -> DataFrame:
    return Engine(stored_tpch(spark, d)).subgraph("order#1", ["n7", "n8"]).edges


# Construction, merge, diff.
def _halves(g: Graph) -> tuple[Graph, Graph]:
    """T in two overlapping snapshots: the second lacks orders ending in 7 and names parts in upper case."""
    old = g.with_(nodes=g.nodes.where("not (id like 'tpch:order:%5')"))
    new = g.with_(
        nodes=g.nodes.where("not (id like 'tpch:order:%7')").withColumn("label", F.when(F.col("id").like("tpch:part:%"), F.upper("label")).otherwise(F.col("label"))),
        edges=g.edges.where("not (relation = 'calls' and target like 'tpch:order:%7')"),
    )
    return old, new


_HALVES = """+ n1 AS (SELECT * FROM n WHERE id NOT LIKE 'tpch:order:%5'), n2 AS (SELECT id, CASE WHEN id LIKE 'tpch:part:%' THEN upper(label) ELSE label END AS label, sourcefile, community, filetype FROM n WHERE id NOT LIKE 'tpch:order:%7'),
e2 AS (SELECT * FROM e WHERE NOT (relation = 'calls' AND target LIKE 'tpch:order:%7'))"""


@query("merge_all", _HALVES + " SELECT id, label FROM n1 UNION ALL SELECT id, label FROM n2 WHERE id NOT IN (SELECT id FROM n1)")
def merge_all(spark: SparkSession, d: str) -> DataFrame:
    return build.merge_all(list(_halves(tpch_graph(spark, d)))).nodes.select("id", "label")


@query("merge_all_edges", "SELECT DISTINCT source, target, relation, confidence FROM e")
def merge_all_edges(spark: SparkSession, d: str) -> DataFrame:
    return build.merge_all(list(_halves(tpch_graph(spark, d)))).edges


_FOLD = _HALVES + """, nx AS (SELECT * FROM n2 WHERE sourcefile LIKE 'EUROPE/%'), files AS (SELECT DISTINCT sourcefile FROM n2 WHERE sourcefile NOT LIKE 'ASIA/%' AND sourcefile <> ''),
fold AS (SELECT id, label FROM n1 WHERE (sourcefile = '' OR sourcefile IN (SELECT sourcefile FROM files)) AND id NOT IN (SELECT id FROM nx) UNION ALL SELECT id, label FROM nx)"""


def _fold(spark: SparkSession, d: str) -> Graph:
    old, new = _halves(tpch_graph(spark, d))
    files = new.nodes.where("sourcefile not like 'ASIA/%'").select("sourcefile")
    return build.incremental_merge(old, new.with_(nodes=new.nodes.where("sourcefile like 'EUROPE/%'")), files)


@query("incremental_merge", _FOLD + " SELECT id, label FROM fold")
def incremental_merge(spark: SparkSession, d: str) -> DataFrame:
    return _fold(spark, d).nodes.select("id", "label")


@query("incremental_merge_edges", _FOLD + " SELECT DISTINCT source, target, relation, confidence FROM e WHERE source IN (SELECT id FROM fold) AND target IN (SELECT id FROM fold)")
def incremental_merge_edges(spark: SparkSession, d: str) -> DataFrame:
    return _fold(spark, d).edges


@query(
    "graph_diff",
    _HALVES
    + """ SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM n1 a FULL JOIN n2 b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.label <> b.label""",
)
def graph_diff(spark: SparkSession, d: str) -> DataFrame:
    return diff.diff_nodes(*_halves(tpch_graph(spark, d)))


@query(
    "graph_diff_edges",
    "SELECT *, 'removed' AS change FROM (SELECT source, target, relation FROM e EXCEPT SELECT source, target, relation FROM e WHERE NOT (relation = 'calls' AND target LIKE 'tpch:order:%7'))",
)
def graph_diff_edges(spark: SparkSession, d: str) -> DataFrame:
    return diff.diff_edges(*_halves(tpch_graph(spark, d)))


@query(
    "ci_gate",
    _HALVES
    + """, dn AS (SELECT CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM n1 a FULL JOIN n2 b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.label <> b.label)
SELECT (SELECT count(*) FROM dn WHERE change = 'added') AS nodes_added, (SELECT count(*) FROM dn WHERE change = 'removed') AS nodes_removed, (SELECT count(*) FROM dn WHERE change = 'changed') AS nodes_changed,
0::BIGINT AS edges_added, (SELECT count(*) FROM e) - (SELECT count(*) FROM e2) AS edges_removed, 0::BIGINT AS new_ambiguous, (SELECT count(*) FROM dn WHERE change = 'added') <= 1000000 AND (SELECT count(*) FROM dn WHERE change = 'removed') <= 10 AS passed""",
)
def ci_gate(spark: SparkSession, d: str) -> DataFrame:
    return diff.gate(*_halves(stored_tpch(spark, d)), max_added=1_000_000, max_removed=10, max_ambiguous=0)


@query(
    "prefix_graph",
    "SELECT CASE WHEN s.sourcefile = '' THEN e.source ELSE 'r1::' || e.source END AS source, CASE WHEN t.sourcefile = '' THEN e.target ELSE 'r1::' || e.target END AS target, relation, confidence FROM e LEFT JOIN n s ON e.source = s.id LEFT JOIN n t ON e.target = t.id",
)
def prefix_graph(spark: SparkSession, d: str) -> DataFrame:
    return build.prefix_graph(tpch_graph(spark, d), "r1").edges


@query(
    "external_merge",
    "SELECT CASE WHEN sourcefile = '' THEN id ELSE 'r1::' || id END AS id, label FROM n UNION ALL SELECT 'r2::' || id, label FROM n WHERE sourcefile <> ''",
)
def external_merge(spark: SparkSession, d: str) -> DataFrame:
    g = tpch_graph(spark, d)
    return build.merge_external(build.prefix_graph(g, "r1"), build.prefix_graph(g, "r2")).nodes.select("id", "label")


@query("prune_repo", "SELECT CASE WHEN sourcefile = '' THEN id ELSE 'r1::' || id END AS id FROM n")
def prune_repo(spark: SparkSession, d: str) -> DataFrame:
    g = tpch_graph(spark, d)
    both = build.merge_external(build.prefix_graph(g, "r1"), build.prefix_graph(g, "r2"))
    return build.prune_repo(both, "r2").nodes.select("id")


@query("build_nodes")
def build_nodes(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "nodes").withColumn("_seq", F.struct("built_at", "label", F.coalesce("removed_at", F.lit("9999-01-01").cast("timestamp_ntz"))))
    # No SQL: its trim knows other white space; tested on fixtures.
    return build.build_nodes(raw, ["_seq"]).select("id", "label")


@query("build_edges", "SELECT source, target, relation, arg_min(confidence, (loaded_at, edge_id)) AS confidence FROM edges WHERE source <> '' AND target <> '' AND relation <> '' AND confidence IN (0, 1, 2) GROUP BY ALL", base="")
def build_edges(spark: SparkSession, d: str) -> DataFrame:
    return build.build_edges(table(spark, d, "edges"), ["loaded_at", "edge_id"])


@query(
    "violations",
    """SELECT 'node without label' AS problem, id AS item FROM n WHERE label = '' UNION ALL SELECT 'edge without relation', source || ' ' || relation || ' ' || target FROM e WHERE relation = ''
UNION ALL SELECT 'unknown endpoint', id FROM deg WHERE id NOT IN (SELECT id FROM n)""",
    P,
)
def violations(spark: SparkSession, d: str) -> DataFrame:
    return build.violations(project_graph(spark, d))


@query(
    "hyperedge_pairs",
    """+ h AS (SELECT l_orderkey, list_sort(list_distinct(list('tpch:part:' || l_partkey))) AS m FROM lineitem GROUP BY 1), u AS (SELECT l_orderkey, m, unnest(m) AS a FROM h WHERE len(m) BETWEEN 2 AND 8)
SELECT DISTINCT a AS source, b AS target, 'co_member' AS relation, 1 AS confidence FROM (SELECT a, unnest(m) AS b FROM u) WHERE a < b""",
)
def hyperedge_pairs(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "lineitem", "l_orderkey", "l_partkey").groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit("tpch:part:"), F.col("l_partkey").cast("string"))).alias("members"))
    return build.expand_hyperedges(h.select("members"))


# Resolution on the project graph.
_PART = "split_part({0}, ':', {1})"
_KEY = "substr({0}, length(split_part({0}, ':', 1)) + length(split_part({0}, ':', 2)) + 3)"
_SEGMENTS = "list_filter(regexp_split_to_array({0}, '/|::|\\.'), lambda x: x <> '')"


def _resolved(where: str, declared: str, narrowed: bool) -> str:
    """SQL that retargets the edges of ``where`` to what their targets name among ``declared``."""
    scope = f"""scope AS (SELECT DISTINCT n.sourcefile AS file, unnest({_SEGMENTS.format(_KEY.format('target'))}) AS word FROM e JOIN n ON e.source = n.id WHERE relation = 'imports' AND n.sourcefile <> ''),
near AS (SELECT DISTINCT f.eid, f.to_ FROM f JOIN (SELECT eid FROM f GROUP BY eid HAVING count(*) > 1) USING (eid) JOIN n ON f.source = n.id JOIN scope a ON a.file = n.sourcefile AND a.word = f.name
  JOIN scope b ON b.file = n.sourcefile AND b.word = regexp_replace(list_extract(string_split(f.sourcefile, '/'), -1), '^(.+)\\.[^.]*$', '\\1')),"""
    none = "near AS (SELECT eid, to_ FROM f WHERE false),"
    return f"""+ c AS (SELECT row_number() OVER () AS eid, * FROM (SELECT DISTINCT * FROM e WHERE {where})),
decl AS (SELECT DISTINCT id, {_PART.format('id', 1)} AS l, label AS name, sourcefile FROM n WHERE {_PART.format('id', 2)} IN ({declared})),
f AS (SELECT c.eid, c.source, d.name, d.id AS to_, d.sourcefile FROM c JOIN decl d ON {_PART.format('c.target', 1)} = d.l AND {_KEY.format('c.target')} = d.name),
{scope if narrowed else none}
cand AS (SELECT * FROM near UNION SELECT DISTINCT eid, to_ FROM f WHERE eid NOT IN (SELECT eid FROM near)), k AS (SELECT eid, count(*) AS n FROM cand GROUP BY 1),
moved AS (SELECT DISTINCT source, to_ AS target, relation, CASE k.n WHEN 1 THEN 1 ELSE 2 END AS confidence FROM c JOIN k USING (eid) JOIN cand USING (eid)
  UNION SELECT source, target, relation, confidence FROM c WHERE eid NOT IN (SELECT eid FROM k))
SELECT * FROM moved UNION SELECT DISTINCT source, target, relation, confidence FROM e WHERE NOT ({where})"""


@query("resolve_calls", _resolved("relation = 'calls' AND split_part(target, ':', 2) = 'call'", "'function', 'method'", True), P)
def q_resolve_calls(spark: SparkSession, d: str) -> DataFrame:
    return resolve_calls(project_graph(spark, d)).edges


@query(
    "resolve_methods",
    f"""+ d AS (SELECT {_PART.format('id', 1)} AS l, regexp_replace(sourcefile, '/?[^/]*$', '') AS d, label AS name, max(id) AS type FROM n WHERE {_PART.format('id', 2)} IN ('class', 'interface', 'struct', 'enum', 'trait', 'type', 'protocol', 'object', 'mixin', 'union') GROUP BY ALL)
SELECT DISTINCT source, target, relation, confidence FROM e WHERE relation <> 'method_of'
UNION SELECT d.type, e.source, 'contains', 0 FROM e JOIN n ON e.source = n.id JOIN d ON d.l = {_PART.format('e.target', 1)} AND d.name = {_KEY.format('e.target')} AND d.d = regexp_replace(n.sourcefile, '/?[^/]*$', '') WHERE relation = 'method_of'""",
    P,
)
def q_resolve_methods(spark: SparkSession, d: str) -> DataFrame:
    return resolve_methods(project_graph(spark, d)).edges


_TYPES = "'class', 'interface', 'struct', 'enum', 'trait', 'type', 'protocol', 'object', 'mixin', 'union'"


@query(
    "resolve_inheritance",
    _resolved("relation IN ('inherits', 'implements', 'embeds') AND split_part(target, ':', 2) = 'typeref'", _TYPES, False),
    P,
)
def q_resolve_inheritance(spark: SparkSession, d: str) -> DataFrame:
    return resolve_inheritance(project_graph(spark, d)).edges


@query("resolve_imports")
def q_resolve_imports(spark: SparkSession, d: str) -> DataFrame:
    return resolve_imports(project_graph(spark, d)).edges


@query("alias_rewrite", "SELECT DISTINCT CASE WHEN id LIKE 'js:import:panel%' THEN 'js:import:/src/panel' || substr(id, 16) ELSE id END AS id FROM n", P)
def alias_rewrite(spark: SparkSession, d: str) -> DataFrame:
    return build.alias_rewrite(project_graph(spark, d), [("panel*", "/src/panel*")]).nodes.select("id")


# Entity resolution.
_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_BUCKET = "CASE WHEN split_part(id, ':', 2) IN ('module', 'section', 'import', 'call', 'typeref', 'link', 'key') THEN 'k:' || split_part(id, ':', 2) ELSE 'entity' END"


@query(
    "dedup_exact",
    f"""+ k AS (SELECT DISTINCT id, {_BUCKET} AS b, {_NORM.format(NAME)} AS l FROM n), f AS (SELECT b, l, min(id) AS u FROM k WHERE l <> '' GROUP BY 1, 2)
SELECT u, id AS v FROM k JOIN f USING (b, l) WHERE id <> u""",
    P,
)
def dedup_exact(spark: SparkSession, d: str) -> DataFrame:
    return exact_links(project_graph(spark, d).nodes)


@query(
    "dedup_fuzzy",
    f"""+ x AS (SELECT id, {_BUCKET} AS b, {NAME} AS l, community FROM n), ch AS (SELECT l, c, count(*) AS k FROM (SELECT l, unnest(regexp_split_to_array(l, '')) AS c FROM (SELECT DISTINCT l FROM x)) WHERE c <> '' GROUP BY ALL),
ent AS (SELECT l FROM ch GROUP BY l HAVING -sum(k::DOUBLE / strlen(l) * log2(k::DOUBLE / strlen(l))) >= 2.5), y AS (SELECT id, b, {_NORM.format('l')} AS w FROM x JOIN ent USING (l)),
z AS (SELECT b, w, min(id) AS id, replace(w, ' ', '') AS t FROM y WHERE w <> '' GROUP BY b, w),
g AS (SELECT b, w, id, CASE WHEN length(t) < 3 THEN [t] ELSE list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) END AS s FROM z),
inv AS (SELECT b, id, unnest(s) AS gram, len(s) AS size FROM g),
pr AS (SELECT p.id AS u, q.id AS v FROM inv p JOIN inv q ON p.b = q.b AND p.gram = q.gram AND p.id < q.id GROUP BY p.id, q.id, p.size, q.size HAVING count(*) >= 0.7 * greatest(p.size, q.size))
SELECT u, v FROM pr JOIN x a ON pr.u = a.id JOIN x c ON pr.v = c.id
WHERE jaro_winkler_similarity({_NORM.format('a.l')}, {_NORM.format('c.l')}) * 100 + CASE WHEN a.community = c.community THEN 5 ELSE 0 END >= 92""",
    P,
)
def dedup_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return fuzzy_matches(project_graph(spark, d).nodes).select("u", "v")


@query("dedup_graph")
def dedup_graph(spark: SparkSession, d: str) -> DataFrame:
    return resolve_entities(project_graph(spark, d))[1]


# Iterative algorithms.
def _orders(spark: SparkSession, d: str, where: str = "l_quantity < 2") -> Graph:
    """Orders and their parts; at small quantity alone these are many small components, which SQL can follow."""
    rows = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_quantity").where(where)
    edges = rows.select(F.concat(F.lit("o:"), "l_orderkey").alias("source"), F.concat(F.lit("p:"), "l_partkey").alias("target"), F.lit("has").alias("relation"), F.lit(0).alias("confidence")).distinct()
    nodes = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    from graphloom.model import graph

    return graph(nodes.withColumn("label", F.col("id")), edges)


_SMALL = """WITH RECURSIVE a AS (SELECT DISTINCT 'o:' || l_orderkey AS x, 'p:' || l_partkey AS y FROM lineitem WHERE l_quantity < 2), arc AS (SELECT x, y FROM a UNION SELECT y, x FROM a),
r AS (SELECT x, x AS y FROM arc UNION SELECT r.x, arc.y FROM r JOIN arc ON r.y = arc.x), c AS (SELECT x AS id, min(y) AS root FROM r GROUP BY x)"""


@query("components", _SMALL + " SELECT id, root FROM c", base="")
def q_components(spark: SparkSession, d: str) -> DataFrame:
    g = _orders(spark, d)
    return components(g.nodes, build.graph_links(g))


@query("components_whole")
def components_whole(spark: SparkSession, d: str) -> DataFrame:
    """All of graph T, with its giant component and crowded vertices."""
    g = stored_tpch(spark, d)
    return components(g.nodes, build.graph_links(g))


@query("components_orders")
def components_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders and parts over all lineitem rows."""
    g = _orders(spark, d, "true")
    return components(g.nodes, build.graph_links(g))


def _tree(spark: SparkSession, d: str) -> Graph:
    """Regions, nations, suppliers and customers: a forest, whose betweenness SQL has in closed form."""
    g = tpch_graph(spark, d)
    return Graph(g.nodes.where("split_part(id, ':', 2) in ('region', 'nation', 'supplier', 'customer')"), g.edges.where("relation = 'contains'"))


_TREE = """+ f AS (SELECT n_nationkey, n_regionkey, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS k FROM nation),
r AS (SELECT n_regionkey, count(*) AS m, sum(k + 1) AS below, sum((k + 1) * (k + 1)) AS sq FROM f GROUP BY 1)
SELECT id, coalesce(v, 0)::DOUBLE AS score FROM (SELECT id FROM n WHERE split_part(id, ':', 2) IN ('region', 'nation', 'supplier', 'customer')) LEFT JOIN (
  SELECT 'tpch:region:' || n_regionkey AS id, (below * below - sq) / 2.0 AS v FROM r
  UNION ALL SELECT 'tpch:nation:' || n_nationkey, k * (k - 1) / 2.0 + k * (r.below - k - 1 + 1) FROM f JOIN r USING (n_regionkey)) USING (id)"""


@query("betweenness", _TREE)
def q_betweenness(spark: SparkSession, d: str) -> DataFrame:
    return betweenness(_tree(spark, d))


@query("bridge_nodes", _TREE.replace("SELECT id, coalesce(v", ", b AS (SELECT id, coalesce(v", 1) + ") SELECT b.id, n.label, b.score FROM b JOIN n USING (id) WHERE score > 0 ORDER BY score DESC, b.id LIMIT 3")
def q_bridge_nodes(spark: SparkSession, d: str) -> DataFrame:
    return bridge_nodes(_tree(spark, d))


@query("betweenness_whole")
def betweenness_whole(spark: SparkSession, d: str) -> DataFrame:
    """All of graph T: one source per node over every edge."""
    return betweenness(stored_tpch(spark, d))


@query("bridge_nodes_whole")
def bridge_nodes_whole(spark: SparkSession, d: str) -> DataFrame:
    return bridge_nodes(stored_tpch(spark, d))


@query("louvain")
def louvain(spark: SparkSession, d: str) -> DataFrame:
    return detect(stored_tpch(spark, d))


@query("leiden")
def leiden(spark: SparkSession, d: str) -> DataFrame:
    return detect(stored_tpch(spark, d), method="leiden")


@query("split_communities")
def q_split(spark: SparkSession, d: str) -> DataFrame:
    g = stored_tpch(spark, d)
    return split_communities(g, detect(g), largest=0.1)
