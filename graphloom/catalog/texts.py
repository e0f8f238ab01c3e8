"""Queries of scalar functions, text and file operators, semantic replies, streams and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.catalog.graph import NAME, P, T
from graphloom.functions import scalar as fn
from graphloom.model import is_lang_id, key, kind, lang, project_graph, tpch_graph
from graphloom.operators import analyze, diff, files, semantic
from graphloom.sinks import graph_formats, pages
from graphloom.sources import code, discovery, markup, web
from graphloom.sources.tables import table
from graphloom.streaming.watch import debounced, event_rates

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_KEY = "CASE WHEN length(id) - length(replace(id, ':', '')) >= 2 THEN substr(id, length(split_part(id, ':', 1)) + length(split_part(id, ':', 2)) + 3) ELSE '' END"


@query(
    "fn_ids",
    f"""SELECT DISTINCT id, split_part(id, ':', 1) AS lang, split_part(id, ':', 2) AS kind, {_KEY} AS key, length(id) - length(replace(id, ':', '')) >= 2 AS valid,
CASE WHEN split_part(id, ':', 2) IN ('module', 'section', 'import', 'call', 'typeref', 'link', 'key') THEN 'k:' || split_part(id, ':', 2) ELSE 'entity' END AS bucket FROM nodes WHERE id IS NOT NULL""",
)
def fn_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "nodes", "id").where("id is not null").distinct()
    return ids.select("id", lang().alias("lang"), kind().alias("kind"), key().alias("key"), is_lang_id().alias("valid"), fn.merge_bucket().alias("bucket"))




@query(
    "fn_labels",
    f"""WITH x AS (SELECT DISTINCT coalesce(label, '') AS l FROM nodes)
SELECT l, trim(regexp_replace(lower(l), '[^a-z0-9]+', ' ', 'g')) AS normalized, regexp_replace(regexp_replace(lower(l), '[^a-z0-9]+', '-', 'g'), '-$', '') AS slug, greatest(1, strlen(l) // 4)::INT AS tokens,
list_sort(list_filter(regexp_split_to_array(lower(l), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) >= 3)) AS words FROM x""",
)
def fn_labels(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "nodes", "label").select(F.coalesce("label", F.lit("")).alias("l")).distinct()
    return x.select("l", fn.normalize_label("l").alias("normalized"), fn.slugify("l").alias("slug"), fn.estimate_tokens("l").alias("tokens"), F.array_sort(fn.tokenize("l")).alias("words"))


@query(
    "fn_entropy",
    """WITH x AS (SELECT DISTINCT label AS l FROM nodes WHERE label <> ''), c AS (SELECT l, ch, count(*) AS c FROM (SELECT l, unnest(regexp_split_to_array(l, '')) AS ch FROM x) WHERE ch <> '' GROUP BY ALL)
SELECT l, round(-sum(c::DOUBLE / strlen(l) * log2(c::DOUBLE / strlen(l))), 9) + 0.0 AS bits FROM c GROUP BY l""",
)
def fn_entropy(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "nodes", "label").where("label <> ''").distinct()
    return x.select(F.col("label").alias("l"), F.round(fn.entropy("label"), 9).alias("bits"))


@query(
    "fn_shingles",
    """WITH x AS (SELECT DISTINCT trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS n FROM nodes WHERE label <> ''), y AS (SELECT n, replace(n, ' ', '') AS t FROM x)
SELECT n, CASE WHEN length(t) < 3 THEN [t] ELSE list_sort(list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)))) END AS grams FROM y""",
)
def fn_shingles(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "nodes", "label").where("label <> ''").select(fn.normalize_label("label").alias("n")).distinct()
    return x.select("n", F.array_sort(fn.shingles("n")).alias("grams"))


@query(
    "fn_jaro_winkler",
    """WITH p AS (SELECT DISTINCT trim(regexp_replace(lower(a.label), '[^a-z0-9]+', ' ', 'g')) AS a, trim(regexp_replace(lower(b.label), '[^a-z0-9]+', ' ', 'g')) AS b
FROM match_pairs m JOIN nodes a ON m.left_id = a.id JOIN nodes b ON m.right_id = b.id WHERE a.label <> '' AND b.label <> '')
SELECT a, b, round(jaro_winkler_similarity(a, b), 6) AS jw FROM p WHERE a <> '' AND b <> ''""",
)
def fn_jaro_winkler(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes", "id", "label").where("label <> ''").select("id", fn.normalize_label("label").alias("n"))
    pairs = table(spark, d, "match_pairs", "left_id", "right_id").join(n.toDF("left_id", "a"), "left_id").join(n.toDF("right_id", "b"), "right_id")
    return pairs.select("a", "b").where("a <> '' and b <> ''").distinct().select("a", "b", F.round(fn.jaro_winkler("a", "b"), 6).alias("jw"))


@query(
    "fn_paths",
    """SELECT path, CASE WHEN path LIKE '%/%' THEN split_part(path, '/', 1) ELSE '' END AS top, coalesce(list_extract(string_split(path, '/'), -2), '') AS parent, regexp_extract(path, '(\\.[^./]*)$', 1) AS ext,
CASE lower(regexp_extract(path, '(\\.[^./]*)$', 1)) WHEN '.md' THEN 'document' WHEN '.rst' THEN 'document' WHEN '.txt' THEN 'document' WHEN '.html' THEN 'document' ELSE 'code' END AS filetype
FROM (SELECT path FROM source_files UNION SELECT path FROM documents WHERE lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN ('.md', '.rst', '.txt', '.html'))""",
)
def fn_paths(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "path").where(F.lower(discovery.extension("path")).isin(".md", ".rst", ".txt", ".html"))
    p = table(spark, d, "source_files", "path").unionByName(docs).distinct()
    return p.select("path", fn.top_level_dir("path").alias("top"), fn.parent_dir_name("path").alias("parent"), discovery.extension("path").alias("ext"), discovery.classify("path").alias("filetype"))


@query(
    "fn_sensitive",
    """SELECT DISTINCT path FROM source_files WHERE regexp_matches(path, '(?i)(^|[^0-9A-Za-z_])(credential|secret|passwd|password|token|private_key)s?($|[^0-9A-Za-z_])')
OR regexp_matches(path, '(?i)(aws_credentials|gcloud_credentials|service.account)') OR regexp_matches(path, '(?i)(^|[^0-9A-Za-z_])(api[-_]?key|access[-_]?token|client[-_]?secret)s?($|[^0-9A-Za-z_])')""",
)
def fn_sensitive(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files", "path").where(discovery.is_sensitive("path")).distinct()


@query("fn_minified", "SELECT path FROM source_files WHERE regexp_matches(lower(path), '\\.min\\.(js|css)$') OR len(list_filter(string_split(text, chr(10)), lambda l: strlen(l) > 5000)) > 0")
def fn_minified(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files", "path", "text").where(discovery.is_minified("path", F.encode("text", "utf-8"))).select("path")


@query(
    "fn_numbers",
    """SELECT o_orderkey, rint_ / 10 AS one, (octets + 2) // 3 AS tokens_in, greatest(least(((octets + 2) // 3) // 8, 4096), 64) AS tokens_out FROM (
SELECT o_orderkey, round_even(o_totalprice * 10, 0) AS rint_, floor(o_totalprice)::BIGINT AS octets FROM orders)""",
)
def fn_numbers(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice").withColumn("octets", F.floor("o_totalprice").cast("bigint"))
    return o.select("o_orderkey", fn.round_one("o_totalprice").alias("one"), fn.approx_input_tokens("octets").alias("tokens_in"), fn.approx_output_tokens(fn.approx_input_tokens("octets")).alias("tokens_out"))


@query(
    "fn_escapes",
    """SELECT DISTINCT l, '''' || replace(replace(replace(replace(l, '\\', '\\\\'), '''', '\\'''), chr(10), '\\n'), chr(13), '\\r') || '''' AS cypher,
replace(replace(replace(replace(replace(l, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS xml FROM (SELECT coalesce(label, '') AS l FROM nodes)""",
)
def fn_escapes(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "nodes", "label").select(F.coalesce("label", F.lit("")).alias("l")).distinct()
    return x.select("l", fn.quote_cypher("l").alias("cypher"), fn.escape_xml("l").alias("xml"))


@query(
    "fn_import_segments",
    """WITH x AS (SELECT DISTINCT substr(target, length(split_part(target, ':', 1)) + 9) AS p FROM edges WHERE split_part(target, ':', 2) = 'import'), s AS (SELECT p, list_filter(regexp_split_to_array(p, '/|::|\\.'), lambda t: t <> '') AS seg FROM x)
SELECT p, coalesce(seg[1], '') AS head, CASE WHEN len(seg) = 0 THEN '' WHEN regexp_matches(seg[-1], '^v[0-9]+$') AND len(seg) > 1 THEN seg[-2] ELSE seg[-1] END AS tail FROM s""",
)
def fn_import_segments(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "edges", "target").where(kind("target") == "import").select(key("target").alias("p")).distinct()
    return p.select("p", fn.first_import_segment("p").alias("head"), fn.last_import_segment("p").alias("tail"))


@query("fn_urls", "SELECT doc_id, list_transform(regexp_extract_all(text, 'https?://[^\\s<>\"\\[\\]]+'), lambda u: regexp_replace(u, '[.,)\\];:!?]+$', '')) AS urls FROM documents WHERE regexp_matches(text, 'https?://[^\\s<>\"\\[\\]]+')")
def fn_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", markup.urls("text").alias("urls")).where("size(urls) > 0")


@query(
    "inverted_index",
    """SELECT token, list_sort(list(DISTINCT doc_id)) AS pages FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: length(t) >= 3)) AS token FROM documents) GROUP BY token""",
)
def q_inverted_index(spark: SparkSession, d: str) -> DataFrame:
    return analyze.inverted_index(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


@query(
    "site_search",
    """WITH q AS (SELECT unnest(['database', 'compiler', 'zzzz']) AS token), p AS (SELECT doc_id AS page, path AS title, list_distinct(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS w FROM documents),
h AS (SELECT page, title, count(*) AS score FROM p JOIN q ON list_contains(w, token) GROUP BY ALL)
SELECT page, score FROM h ORDER BY score DESC, title, page LIMIT 50""",
)
def site_search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text", "path")
    return analyze.site_search(docs.select(F.col("doc_id").alias("page"), F.col("path").alias("title")), analyze.inverted_index(docs, "doc_id", "text"), "Database compiler zzzz")


@query(
    "tree_rollup",
    """WITH f AS (SELECT path, size, list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM source_files)
SELECT dir, count(*) AS files, sum(size)::BIGINT AS total FROM (SELECT path, size, unnest(list_transform(range(0, len(p)), lambda i: array_to_string(p[1:i], '/'))) AS dir FROM f) GROUP BY dir""",
)
def tree_rollup(spark: SparkSession, d: str) -> DataFrame:
    return analyze.tree_rollup(table(spark, d, "source_files", "path", "size"), "path", F.col("size"))


# Files over time.
_LATEST = "(SELECT path, max(struct_pack(scanned_at := scanned_at, mtime := mtime, sha256 := sha256)) AS m FROM file_manifest GROUP BY path)"
_CACHE = "(SELECT path, max(struct_pack(run_id := run_id, mtime := mtime, hash := hash)) AS m FROM hash_cache GROUP BY path)"


def _latest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "file_manifest", "path", "scanned_at", "mtime", "sha256")
    return rows.groupBy("path").agg(F.max(F.struct("scanned_at", "mtime", "sha256")).alias("m")).select("path", "m.mtime", "m.sha256")


def _cache(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "hash_cache", "path", "run_id", "mtime", "hash")
    return rows.groupBy("path").agg(F.max(F.struct("run_id", "mtime", "hash")).alias("m")).select("path", "m.mtime", "m.hash")


@query(
    "changed_files",
    f"SELECT l.path FROM {_LATEST} l LEFT JOIN {_CACHE} c USING (path) WHERE c.path IS NULL OR NOT (coalesce(l.m.mtime = c.m.mtime AND l.m.mtime <> 0, false) OR coalesce(lower(l.m.sha256) = lower(c.m.hash), false))",
)
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    return files.changed_files(_latest(spark, d), _cache(spark, d))


@query("save_cache", f"SELECT coalesce(l.path, c.path) AS path, CASE WHEN l.path IS NULL THEN c.m.mtime ELSE l.m.mtime END AS mtime, CASE WHEN l.path IS NULL THEN c.m.hash ELSE l.m.sha256 END AS hash FROM {_LATEST} l FULL JOIN {_CACHE} c ON l.path = c.path")
def save_cache(spark: SparkSession, d: str) -> DataFrame:
    return files.save_cache(_cache(spark, d), _latest(spark, d).withColumnRenamed("sha256", "hash"))


@query(
    "manifest_diff",
    f"""WITH a AS {_CACHE.replace("hash_cache", "hash_cache WHERE path IS NOT NULL")}, b AS {_LATEST}
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.path = b.path
WHERE a.path IS NULL OR b.path IS NULL OR a.m.hash IS DISTINCT FROM b.m.sha256""",
)
def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    return diff.diff_manifests(_cache(spark, d).select("path", F.col("hash").alias("sha256")), _latest(spark, d))


@query("cache_stats", "SELECT count(*) AS entries, coalesce(sum(size), 0)::BIGINT AS bytes, min(mtime) AS oldest, max(mtime) AS newest FROM file_manifest")
def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    return files.cache_stats(table(spark, d, "file_manifest", "size", "mtime"))


@query(
    "build_manifest",
    f"""SELECT s.path, 0::BIGINT AS mtime, s.size, CASE WHEN m.sha256 IS NOT NULL AND m.size = s.size THEN m.sha256 ELSE sha256(s.text) END AS sha256, regexp_extract(s.path, '(\\.[^./]*)$', 1) AS ext
FROM source_files s LEFT JOIN (SELECT path, max(struct_pack(scanned_at := scanned_at, size := size, sha256 := sha256)).size AS size, max(struct_pack(scanned_at := scanned_at, size := size, sha256 := sha256)).sha256 AS sha256 FROM file_manifest GROUP BY path) m USING (path)""",
)
def build_manifest(spark: SparkSession, d: str) -> DataFrame:
    prior = table(spark, d, "file_manifest", "path", "scanned_at", "size", "sha256").groupBy("path").agg(F.max(F.struct("scanned_at", "size", "sha256")).alias("m"))
    prior = prior.select("path", F.lit(0).cast("bigint").alias("mtime"), "m.size", "m.sha256")
    listing = table(spark, d, "source_files", "path", "size", "text").withColumn("mtime", F.lit(0).cast("bigint"))
    return files.build_manifest(listing, prior, F.sha2("text", 256))


# Extraction.
@query("code_graph_nodes")
def code_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return code.extract(table(spark, d, "source_files", "path", "text")).nodes


@query("code_graph_edges")
def code_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return code.extract(table(spark, d, "source_files", "path", "text")).edges


@query("document_graph_nodes")
def document_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return markup.extract_documents(table(spark, d, "documents", "path", "text")).nodes


@query("document_graph_edges")
def document_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return markup.extract_documents(table(spark, d, "documents", "path", "text")).edges


@query(
    "document_sections",
    r"""WITH l AS (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS ls FROM documents), x AS (SELECT doc_id AS doc, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS line FROM l)
SELECT doc, line::INT AS line, length(regexp_extract(l, '^ {0,3}(#+)', 1))::INT AS level, regexp_extract(l, '^ {0,3}#{1,3}\s+(.*?)\s*#*\s*$', 1) AS title FROM x WHERE regexp_matches(l, '^ {0,3}#{1,3}\s+\S')""",
)
def document_sections(spark: SparkSession, d: str) -> DataFrame:
    return markup.section_rows(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


@query(
    "rationale_comments",
    r"""WITH l AS (SELECT path, string_split(text, chr(10)) AS ls FROM source_files), x AS (SELECT path, unnest(ls) AS l, generate_subscripts(ls, 1) AS line FROM l)
SELECT path AS sourcefile, 'L' || line AS sourcelocation, trim(regexp_replace(regexp_extract(l, '^\s*(?:#|//|--|/\*)\s*((?:NOTE|IMPORTANT|HACK|WHY|RATIONALE|TODO|FIXME|XXX|WARNING)(?::|\s).*)$', 1), '\s*\*/\s*$', '')) AS label
FROM x WHERE regexp_matches(l, '^\s*(?:#|//|--|/\*)\s*(?:NOTE|IMPORTANT|HACK|WHY|RATIONALE|TODO|FIXME|XXX|WARNING)(?::|\s)')""",
)
def rationale_comments(spark: SparkSession, d: str) -> DataFrame:
    return markup.rationales(table(spark, d, "source_files", "path", "text")).nodes.select("sourcefile", "sourcelocation", "label")


@query("rationale_edges")
def rationale_edges(spark: SparkSession, d: str) -> DataFrame:
    return markup.rationales(table(spark, d, "source_files", "path", "text")).edges


def _page(title: str, text: str):
    """A page made of a table's columns."""
    return F.concat(F.lit("<html><head><meta property=\"og:title\" content=\""), F.col(title), F.lit("\"><script>x</script></head><body><nav>menu</nav><article><h1>"), F.col(title), F.lit("</h1><p>"), F.col(text), F.lit("</p><ul><li>one</li></ul></article></body></html>"))


@query("html_to_markdown", "SELECT p_partkey, '# ' || p_name || chr(10) || chr(10) || p_type || chr(10) || chr(10) || '- one' AS md FROM part")
def html_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part", "p_partkey", "p_name", "p_type").select("p_partkey", web.html_to_markdown(_page("p_name", "p_type")).alias("md"))


@query("og_tags", "SELECT p_partkey, p_name AS title, '' AS description, '' AS image, '' AS site_name FROM part")
def og_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part", "p_partkey", "p_name", "p_type").select("p_partkey", web.og_tags(_page("p_name", "p_type")).alias("t")).select("p_partkey", "t.*")


_LINK = "SELECT DISTINCT substr(target, length(split_part(target, ':', 1)) + 7) AS url FROM edges WHERE split_part(target, ':', 2) = 'link'"


@query("side_files", f"SELECT url, rtrim(substr(regexp_replace(replace(h || '-' || CASE WHEN l = '' THEN h ELSE l END, '.', '-'), '[^A-Za-z0-9_-]+', '-', 'g'), 1, 60)) || '-' || substr(sha1(url), 1, 16) || '.md' AS file FROM (SELECT url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h, list_extract(string_split(rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), '/'), -1) AS l FROM ({_LINK}))")
def side_files(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "edges", "target").where(kind("target") == "link").select(key("target").alias("url")).distinct()
    return u.select("url", web.side_file("url").alias("file"))


@query("url_routes", f"SELECT url, CASE WHEN regexp_matches(lower(url), '\\.pdf$') THEN 'pdf' WHEN regexp_matches(lower(url), '\\.(png|jpe?g|gif|webp|svg)$') THEN 'image' ELSE 'page' END AS route FROM ({_LINK})")
def url_routes(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "edges", "target").where(kind("target") == "link").select(key("target").alias("url")).distinct()
    return u.select("url", web.route("url").alias("route"))


# Model replies, made of the entities table: one reply per document.
def _replies(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entities", "doc_id", "id", "type", "label").where("doc_id is not null and id is not null").distinct()
    one = F.struct("id", "type", "label")
    grouped = e.groupBy("doc_id").agg(F.array_sort(F.collect_set(one)).alias("entities"))
    return grouped.select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("Here it is: "), F.to_json(F.struct("entities"))).alias("reply"))


@query("semantic_edges", "SELECT DISTINCT 'doc:module:' || doc_id AS source, 'doc:entity:' || doc_id || ':' || id AS target, 'mentions' AS relation, 1 AS confidence FROM entities WHERE doc_id IS NOT NULL AND id <> '' AND label <> ''")
def semantic_edges(spark: SparkSession, d: str) -> DataFrame:
    return semantic.parse_replies(_replies(spark, d)).edges


@query("semantic_preflight", "SELECT count(*) AS jobs, sum((strlen(coalesce(text, '')) + 2) // 3)::BIGINT AS input_tokens, sum(greatest(least(((strlen(coalesce(text, '')) + 2) // 3) // 8, 4096), 64))::BIGINT AS output_tokens FROM documents")
def semantic_preflight(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "text")
    jobs = semantic.estimates(docs, F.octet_length(F.coalesce("text", F.lit(""))), 3.0, 15.0)
    return semantic.preflight(jobs).select("jobs", "input_tokens", "output_tokens")


@query(
    "similar_embeddings",
    """WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0)
SELECT q.vec_id AS a, e.vec_id AS b FROM q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) >= 0.8""",
)
def similar_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Similarity edges of the query set (ids divisible by 50) against all rows, in blocks of the query set."""
    import numpy as np
    import pandas as pd

    e = table(spark, d, "embeddings", "vec_id", "embedding")
    asked = e.where("vec_id % 50 = 0").withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, e.count() // 250_000))))
    blocks = [r.b for r in asked.select("b").distinct().collect()]
    out = None
    for b in blocks:
        rows = asked.where(F.col("b") == b).select("vec_id", "embedding").collect()
        ids, m = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        shared = spark.sparkContext.broadcast((ids, m))

        def run(batches, shared=shared):
            names, q = shared.value
            for pdf in batches:
                x = np.stack(pdf["embedding"].to_numpy()).astype(float)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                i, j = np.nonzero(x @ q.T >= 0.8)
                own = pdf["vec_id"].to_numpy()[i]
                keep = own != names[j]
                yield pd.DataFrame({"a": names[j][keep], "b": own[keep]})

        part = e.mapInPandas(run, "a bigint, b bigint")
        out = part if out is None else out.unionByName(part)
    return out


# Streams run as tables here; tests run them as streams.
@query(
    "debounce_batches",
    """WITH g AS (SELECT event_type, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 SECOND THEN 0 ELSE 1 END AS first FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
s AS (SELECT *, sum(first) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM g)
SELECT event_type AS key, min(ts) AS start, max(ts) + INTERVAL 30 SECOND AS "end", count(*) AS n FROM s GROUP BY event_type, b""",
)
def debounce_batches(spark: SparkSession, d: str) -> DataFrame:
    return debounced(table(spark, d, "events", "ts", "event_type"), "ts", "event_type", "30 seconds")


@query("event_rates", "SELECT event_type AS kind, time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def q_event_rates(spark: SparkSession, d: str) -> DataFrame:
    return event_rates(table(spark, d, "events", "ts", "event_type", "value"), "ts", "event_type")


# Sinks as rows.
@query("export_cypher_edges", f"WITH {T} SELECT 'MATCH (a:Entity {{id: ''' || source || '''}}), (b:Entity {{id: ''' || target || '''}}) MERGE (a)-[r:' || upper(relation) || ']->(b) SET r.confidence = ''' || CASE confidence WHEN 0 THEN 'EXTRACTED' WHEN 1 THEN 'INFERRED' ELSE 'AMBIGUOUS' END || ''';' AS line FROM e")
def export_cypher_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph_formats.cypher_lines(tpch_graph(spark, d)).where("part = 2").select("line")


@query("export_graphml_edges", f"WITH {T} SELECT '<edge source=\"' || source || '\" target=\"' || target || '\"><data key=\"relation\">' || relation || '</data><data key=\"confidence\">' || CASE confidence WHEN 0 THEN 'EXTRACTED' WHEN 1 THEN 'INFERRED' ELSE 'AMBIGUOUS' END || '</data></edge>' AS line FROM e")
def export_graphml_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph_formats.graphml_lines(tpch_graph(spark, d)).where("part = 2").select("line")


@query("export_json_nodes")
def export_json_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph_formats.json_nodes(project_graph(spark, d)).select("line")


@query("wiki_pages")
def wiki_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.wiki(tpch_graph(spark, d))


@query("vault_notes")
def vault_notes(spark: SparkSession, d: str) -> DataFrame:
    return pages.vault(project_graph(spark, d))


@query("display_labels", f"WITH {P} SELECT id, {NAME} AS label FROM n")
def display_labels(spark: SparkSession, d: str) -> DataFrame:
    return project_graph(spark, d).nodes.select("id", fn.display_label().alias("label"))
