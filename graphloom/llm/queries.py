"""Queries of the training-data operators: copies (p2), hand-written source (p3), groups (p5), packing (p7),
leaked evaluation items (p8) and subjects (p9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.components import components, links, node_groups
from graphloom.llm.copies import collapse, copy_members, entity_records, node_records
from graphloom.llm.handwritten import KEYWORDS, foreign_files
from graphloom.llm.leakage import leaked_spans
from graphloom.llm.packing import fill_report, pack, pack_documents, packing_faults, token_count
from graphloom.llm.subjects import subject_areas
from graphloom.plans.scratch import cut
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


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return entity_records(table(spark, d, "entities", "entity_key", "type", "label", "props"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return node_records(table(spark, d, "nodes", "id", "label", "sourcefile"))


def _bare(x: str) -> str:
    return f"replace(lower(upper(regexp_replace(coalesce({x}, ''), '[^\\p{{L}}\\p{{N}}]+', '', 'g'))), 'ß', 'ss')"


_CANON = f"""
canon AS (
  SELECT DISTINCT 'entities' AS tbl, entity_key AS key, {_bare('type')} || chr(1) || {_bare('label')} || chr(1) || CASE WHEN props IS NULL THEN '' ELSE
    array_to_string(list_sort(list_transform(json_keys(props), lambda k: {_bare('k')} || '=' || {_bare("json_extract_string(props, '$.' || k)")})), '&') END AS canon
  FROM entities WHERE {_bare('label')} <> ''
  UNION
  SELECT DISTINCT 'nodes', id, split_part(id, ':', 2) || chr(1) || coalesce(sourcefile, '') || chr(1) || {_bare('label')}
  FROM nodes WHERE split_part(id, ':', 2) IN ('entity', 'section') AND {_bare('label')} <> ''
)"""


@query(
    "p2_found",
    f"""WITH {_CANON}, grouped AS (SELECT tbl, canon, min(key) AS first_key FROM canon GROUP BY ALL HAVING count(*) > 1)
SELECT DISTINCT tbl, first_key, key AS copy_key FROM canon JOIN grouped USING (tbl, canon) WHERE key > first_key""",
)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    part = lambda name, records: copy_members(records).select(F.lit(name).alias("tbl"), "first_key", "copy_key").distinct()
    return part("entities", _entities(spark, d)).unionByName(part("nodes", _nodes(spark, d)))


@query(
    "p2_collapsed",
    f"""WITH {_CANON} SELECT tbl, min(key) AS key, count(*) AS copies FROM canon GROUP BY tbl, canon
UNION ALL SELECT 'entities', entity_key, 1 FROM (SELECT DISTINCT entity_key FROM entities WHERE {_bare('label')} = '')
UNION ALL SELECT 'nodes', id, 1 FROM (SELECT DISTINCT id FROM nodes WHERE split_part(id, ':', 2) IN ('entity', 'section') AND {_bare('label')} = '')""",
)
def p2_collapsed(spark: SparkSession, d: str) -> DataFrame:
    part = lambda name, records: collapse(records).select(F.lit(name).alias("tbl"), "key", "copies")
    return part("entities", _entities(spark, d)).unionByName(part("nodes", _nodes(spark, d)))


_GROUPS = """
WITH RECURSIVE e AS (
  SELECT DISTINCT left_id AS a, right_id AS b FROM match_pairs WHERE score >= 92 AND left_id <> right_id
  UNION SELECT DISTINCT right_id, left_id FROM match_pairs WHERE score >= 92 AND left_id <> right_id),
r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
g AS (SELECT a AS node_id, min(b) AS group_id FROM r GROUP BY a)
"""


@query("p5_found", _GROUPS + "SELECT group_id, node_id FROM g WHERE group_id < node_id")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "match_pairs", "left_id", "right_id", "score")
    found = components(links(pairs.where("score >= 92"), "left_id", "right_id"))
    return found.where("group_id < node_id").select("group_id", "node_id")


@query(
    "p5_groups",
    _GROUPS + "SELECT DISTINCT n.id, n.label, coalesce(g.group_id, n.id) AS group_id FROM nodes n LEFT JOIN g ON n.id = g.node_id WHERE n.id IS NOT NULL",
)
def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return node_groups(table(spark, d, "nodes", "id", "label"), table(spark, d, "match_pairs", "left_id", "right_id", "score"))


@query("p7_pack")
def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(table(spark, d, "documents", "doc_id", "text"), 2048)


@query("p7_pack_8192")
def p7_pack_8192(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(table(spark, d, "documents", "doc_id", "text"), 8192)


@query(
    "p7_faults",
    "SELECT c.capacity::INT AS capacity, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0::BIGINT AS missing, 0::BIGINT AS repeated, 0::BIGINT AS cut_without_need, 0::BIGINT AS overfull, 0::BIGINT AS incomplete, true AS tight FROM (VALUES (2048), (8192)) c(capacity)",
)
def p7_faults(spark: SparkSession, d: str) -> DataFrame:
    """What a packing of all documents owes at both capacities: every document once and whole, no container above its capacity."""
    documents = table(spark, d, "documents", "doc_id", "text")
    sized = cut(documents.select("doc_id", token_count(F.col("text")).alias("tokens")), "sized")
    part = lambda c: packing_faults(documents, cut(pack(sized, c), "packed"), c).select(F.lit(c).alias("capacity"), "*")
    return part(2048).unionByName(part(8192))


@query("p7_fill")
def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    sized = cut(table(spark, d, "documents", "doc_id", "text").select("doc_id", token_count(F.col("text")).alias("tokens")), "sized")
    return fill_report(pack(sized, 2048), 2048).unionByName(fill_report(pack(sized, 8192), 8192))


@query("p8_spans")
def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return leaked_spans(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"))


@query(
    "p8_found",
    r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM eval_items),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM d),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM i)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
""",
)
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_spans(spark, d).select("doc_id", "item_id").distinct()


_KEYWORDS = ", ".join(f"'{k}'" for k in sorted(KEYWORDS))
#: Every file judged by itself, in the gaps between the families of these tables, and every pair of files compared.
_P3 = rf"""
WITH f AS (SELECT DISTINCT path, repo, text FROM source_files WHERE path IS NOT NULL AND text IS NOT NULL AND trim(text) <> ''),
b AS (SELECT *, replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)/\*.*?\*/', ' ', 'g'),
  '(?m)^([ \t]*)#[ \t]*(include|define|if|endif|else|pragma)\b', '\1' || chr(1) || '\2', 'g'), '(?m)^[ \t]*(//|#|--[ \t])[^\n]*$', '', 'g'), chr(1), '#') AS body FROM f),
t AS (SELECT path, repo, text, body, regexp_extract_all(body, '[A-Za-z_][A-Za-z0-9_$]*|(?s:"{{3}}.*?"{{3}})|(?s:''{{3}}.*?''{{3}})|`[^`]*`?|"(?:[^"\\\n]|\\.)*"?|''(?:[^''\\\n]|\\.)*''?|[0-9][0-9A-Za-z_.]*|\$[A-Za-z0-9_$]*|[^\sA-Za-z0-9_]') AS w FROM b),
m AS (SELECT *, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '^["''`0-9]') THEN 'L' WHEN NOT regexp_matches(x, '^[A-Za-z_$]') THEN x WHEN lower(x) IN ({_KEYWORDS}) THEN lower(x) ELSE 'I' END) AS k FROM t WHERE len(w) > 0),
d AS (SELECT path, repo, text, w, len(w) AS n,
  len(list_distinct(list_transform(range(1, greatest(2, len(k) - 3)), lambda i: array_to_string(k[i:i + 4], ' ')))) / len(w) AS repeats,
  list_sum(list_transform(list_filter(w, lambda x: regexp_matches(x, '^["''`0-9]')), lambda x: length(regexp_replace(x, '\s', '', 'g')))) / length(regexp_replace(body, '\s', '', 'g')) AS literal,
  list_avg(list_transform(list_filter(string_split(body, chr(10)), lambda x: trim(x) <> ''), lambda x: length(trim(x)))) AS line,
  list_avg(list_transform(list_filter(w, lambda x: regexp_matches(x, '^[A-Za-z_$]') AND lower(x) NOT IN ({_KEYWORDS})), lambda x: length(x))) AS name FROM m),
g AS (SELECT path, repo, unnest(list_distinct(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i + 4], chr(2))))) AS s FROM d),
size AS (SELECT path, repo, count(*) AS n FROM g GROUP BY ALL),
pairs AS (SELECT a.path AS p, c.path AS q, any_value(x.n) AS m, any_value(y.n) AS n, count(*) AS both_ FROM g a JOIN g c ON a.s = c.s AND a.repo < c.repo
  JOIN size x ON x.path = a.path AND x.repo = a.repo JOIN size y ON y.path = c.path AND y.repo = c.repo GROUP BY a.path, a.repo, c.path, c.repo),
copies AS (SELECT unnest([p, q]) AS path FROM pairs WHERE both_ >= 0.8 * (m + n - both_)),
lead AS (SELECT path, regexp_extract(text, '(?s)^\s*(?:(?:(?:#|//|--)[^\n]*(?:\n|$)\s*)|/\*.*?\*/\s*)+') AS head FROM f),
r AS (SELECT path, CASE WHEN literal >= 0.55 THEN 'data' WHEN line >= 150 AND name < 3 THEN 'minified' WHEN repeats < 0.08 THEN 'generated' END AS reason FROM d
  UNION SELECT path, 'vendored' FROM copies
  UNION SELECT path, 'vendored' FROM lead WHERE regexp_matches(head, '(?im)^\W*[\w.\-]+ - version \d|^\W*[\w.\-]+ v?\d+\.\d+\.\d+\b|\b(imported|copied) (\w+ )?from\b|\bvendored from\b|^\W*upstream:\s|\bredistribution and use in source\b')
  UNION SELECT path, 'vendored' FROM f WHERE regexp_matches(path, '/(vendor|vendored|third_party|third-party|3rdparty|node_modules|bower_components|external|deps|Pods)/[^/]+/'))
"""


@query("p3_reasons", _P3 + "SELECT DISTINCT path, reason FROM r WHERE reason IS NOT NULL")
def p3_reasons(spark: SparkSession, d: str) -> DataFrame:
    return foreign_files(table(spark, d, "source_files", "path", "repo", "text"))


@query("p3_found", _P3 + "SELECT DISTINCT path FROM r WHERE reason IS NOT NULL")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_reasons(spark, d).select("path").distinct()


def _subject_tables(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    return (
        table(spark, d, "documents", "doc_id", "text", "source"),
        table(spark, d, "subject_labels", "doc_id", "subject"),
        table(spark, d, "subjects", "subject"),
        table(spark, d, "eval_items", "text"),
    )


@query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return subject_areas(*_subject_tables(spark, d)).distinct()


@query("p9_composition")
def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents per subject, source and language; documents without subject count under ''."""
    documents = table(spark, d, "documents", "doc_id", "source", "lang")
    found = documents.join(subject_areas(*_subject_tables(spark, d)), "doc_id", "left")
    cell = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return found.groupBy(cell("subject"), cell("source"), F.lower(cell("lang")).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
