"""Graph analytics: degrees, hubs, surprising links, cohesion, audits, corpus figures, questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalar import confidence_name, cross_language, display_label, is_hub_or_stub, sanitize_text, tokenize, top_level_dir
from graphloom.model import Graph, kind
from graphloom.operators.build import attach, cross_community_counts


def degrees(edges: DataFrame) -> DataFrame:
    """``id, degree``: ends of edges at every id; parallel edges count each, a self-loop twice."""
    return edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def node_degrees(g: Graph) -> DataFrame:
    """The nodes with their degree, 0 where no edge ends."""
    return g.nodes.join(degrees(g.edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("bigint")))


def confidence_summary(edges: DataFrame) -> DataFrame:
    return edges.groupBy(confidence_name().alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


def graph_stats(g: Graph) -> DataFrame:
    """``section, name, n``: counts of nodes, edges, hyperedges, communities, file types and relations."""
    one = lambda section, name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(section).alias("section"), F.lit(name).alias("name"), "n")
    each = lambda section, df, c: df.groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(section).alias("section"), "name", "n")
    out = one("total", "nodes", g.nodes).unionByName(one("total", "edges", g.edges))
    if g.hyperedges is not None:
        out = out.unionByName(one("total", "hyperedges", g.hyperedges))
    out = out.unionByName(one("total", "communities", g.nodes.where("community <> ''").select("community").distinct()))
    return out.unionByName(each("filetype", g.nodes.where("filetype <> ''"), "filetype")).unionByName(each("relation", g.edges, "relation"))


def god_nodes(g: Graph, limit: int = 10) -> DataFrame:
    """``rank, id, label, degree`` of the most connected nodes that are neither file hubs nor stubs.

    At most a fifth of the connected ones (but one at least) and at most ``limit``.
    """
    real = node_degrees(g).where(~is_hub_or_stub("id", "label", "degree")).where("degree > 0").select("id", "label", "degree")
    top = real.orderBy(F.desc("degree"), "id").limit(limit)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("degree"), "id")))
    share = real.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 5)).alias("most"))
    return ranked.join(F.broadcast(share), F.col("rank") <= F.col("most")).select("rank", "id", "label", "degree")


def surprise_score(e: DataFrame) -> Column:
    """Points of an edge joined with both ends (columns ``s_`` and ``t_`` for filetype, sourcefile, degree)."""
    same_lang_rule = (F.col("confidence") == 1) & (F.col("relation") == "calls") & cross_language("source", "target")
    base = F.when(same_lang_rule, 0).when(F.col("confidence") == 2, 3).when(F.col("confidence") == 1, 2).otherwise(1)
    types = F.when((F.col("s_filetype") != "") & (F.col("t_filetype") != "") & (F.col("s_filetype") != F.col("t_filetype")), 2).otherwise(0)
    files = (F.col("s_sourcefile") != "") & (F.col("t_sourcefile") != "")
    dirs = F.when(files & (top_level_dir("s_sourcefile") != top_level_dir("t_sourcefile")), 2).otherwise(0)
    raw = base + types + dirs
    scaled = F.when(F.col("relation") == "semantically_similar_to", F.floor(raw * 3 / 2).cast("int")).otherwise(raw)
    small, large = F.least("s_degree", "t_degree"), F.greatest("s_degree", "t_degree")
    return scaled + F.when((small <= 2) & (large >= 5), 1).otherwise(0)


def with_ends(g: Graph, *columns: str) -> DataFrame:
    """Edges with the named node columns of both ends, prefixed ``s_`` and ``t_``; '' (degree 0) for unknown ends."""
    nodes = node_degrees(g).select("id", *columns)
    out = g.edges
    for end, p in (("source", "s_"), ("target", "t_")):
        side = nodes.select(F.col("id").alias(end), *(F.col(c).alias(p + c) for c in columns))
        out = attach(out, side, end, "left", g.edges)
    blank = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint") if c.endswith("degree") else F.lit(""))
    return out.select("source", "target", "relation", "confidence", *(blank(p + c).alias(p + c) for p in ("s_", "t_") for c in columns))


def surprising_links(g: Graph, limit: int = 10) -> DataFrame:
    """``rank, source, target, relation, confidence, score`` of the links least to be expected.

    Candidates cross two communities, or two files where the graph has fewer than two communities. Equal scores rank by
    rarity of both ends, then by the edge itself.
    """
    communities = g.nodes.where("community <> ''").select("community").distinct().limit(2).count()
    e = with_ends(g, "community", "filetype", "sourcefile", "degree")
    if communities >= 2:
        e = e.where("s_community <> '' and t_community <> '' and s_community <> t_community")
    else:
        e = e.where("s_sourcefile <> '' and t_sourcefile <> '' and s_sourcefile <> t_sourcefile")
    rarity = F.lit(1.0) / (F.log2(F.col("s_degree") + 2) * F.log2(F.col("t_degree") + 2))
    order = [F.desc("score"), F.desc("rarity"), "source", "target", "relation", "confidence"]
    top = e.withColumn("score", surprise_score(e).cast("int")).withColumn("rarity", rarity).orderBy(*order).limit(limit)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.select("rank", "source", "target", "relation", "confidence", "score")


def intra_pairs(g: Graph, communities: DataFrame | None = None) -> DataFrame:
    """``community, size, pairs, links``: members, possible pairs and distinct undirected links inside each community."""
    c = (g.nodes.select("id", "community") if communities is None else communities).where("community <> ''")
    size = c.groupBy("community").agg(F.countDistinct("id").alias("size"))
    side = lambda end, name: c.select(F.col("id").alias(end), F.col("community").alias(name))
    inside = g.edges.where("source <> target").select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).distinct()
    inside = attach(attach(inside, side("u", "community"), "u"), side("v", "_c"), "v", base=inside).where("community = _c").groupBy("community").agg(F.count(F.lit(1)).alias("links"))
    zero = F.coalesce("links", F.lit(0).cast("bigint"))
    return size.join(inside, "community", "left").select("community", "size", F.expr("size * (size - 1) div 2").alias("pairs"), zero.alias("links"))


def cohesion(g: Graph, communities: DataFrame | None = None) -> DataFrame:
    """``community, size, cohesion``: links over possible pairs; 1 for a single member."""
    score = F.when(F.col("size") <= 1, F.lit(1.0)).otherwise(F.col("links") / F.col("pairs"))
    return intra_pairs(g, communities).select("community", "size", score.alias("cohesion"))


def low_cohesion(g: Graph, least: int = 5, below: float = 0.05) -> DataFrame:
    return cohesion(g).where((F.col("size") >= least) & (F.col("cohesion") < below))


def community_hubs(g: Graph, limit: int = 25) -> DataFrame:
    """``community, id, label, degree`` of the best connected member of each community, the least label winning ties."""
    named = node_degrees(g).where("community <> ''").withColumn("label", display_label())
    hub = named.groupBy("community").agg(F.min(F.struct((-F.col("degree")).alias("d"), "label", "id")).alias("m"))
    hub = hub.select("community", "m.id", "m.label", (-F.col("m.d")).alias("degree")).where("degree > 0")
    return hub.orderBy(F.desc("degree"), "community").limit(limit)


def community_labels(g: Graph) -> DataFrame:
    """``community, name``: sanitised label of each community's best connected member."""
    named = node_degrees(g).where("community <> ''").withColumn("label", display_label())
    hub = named.groupBy("community").agg(F.min(F.struct((-F.col("degree")).alias("d"), "label", "id")).alias("m"))
    return hub.select("community", sanitize_text("m.label").alias("name"))


def community_members(g: Graph, sample: int = 5) -> DataFrame:
    """``community, size, members``: number of members and the first few labels."""
    named = g.nodes.where("community <> ''").select("community", F.struct(display_label().alias("label"), "id").alias("m"))
    position = F.row_number().over(Window.partitionBy("community").orderBy("m"))
    size = named.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    first = named.withColumn("i", position).where(F.col("i") <= sample).groupBy("community").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    return size.join(first, "community").select("community", "size", F.array_join(F.transform("ms", lambda m: m["label"]), ", ").alias("members"))


def community_audit(g: Graph) -> DataFrame:
    """``community, extracted, inferred, ambiguous, total`` and whole percentages; an edge across counts for both sides."""
    e = with_ends(g, "community").select(
        "confidence", F.explode(F.array_distinct(F.filter(F.array("s_community", "t_community"), lambda c: c != ""))).alias("community")
    )
    names = ("extracted", "inferred", "ambiguous")
    out = e.groupBy("community").agg(*(F.count_if(F.col("confidence") == i).alias(n) for i, n in enumerate(names)), F.count(F.lit(1)).alias("total"))
    return out.select("*", *(F.expr(f"{n} * 100 div total").alias(f"{n}_pct") for n in names))


def cross_community(g: Graph) -> DataFrame:
    """``a, b, n`` for every pair of communities with edges between them."""
    return cross_community_counts(g.edges, g.nodes.where("community <> ''").select("id", "community"))


def corpus_figures(g: Graph) -> DataFrame:
    """``section, name, n``: files, their extensions and types (each file counted once), and a warning for tiny corpora."""
    files = g.nodes.where("sourcefile <> ''").groupBy("sourcefile").agg(F.min("filetype").alias("filetype"))
    ext = files.select(F.regexp_extract("sourcefile", r"(\.[^./]*)\z", 1).alias("x")).where("x <> ''").distinct()
    total = files.agg(F.count(F.lit(1)).alias("n"))
    return (
        total.select(F.lit("files").alias("section"), F.lit("total").alias("name"), "n")
        .unionByName(total.select(F.lit("files").alias("section"), F.lit("tiny").alias("name"), F.when(F.col("n") < 3, 1).otherwise(0).cast("bigint").alias("n")))
        .unionByName(ext.agg(F.count(F.lit(1)).alias("n")).select(F.lit("files").alias("section"), F.lit("extensions").alias("name"), "n"))
        .unionByName(files.groupBy("filetype").agg(F.count(F.lit(1)).alias("n")).select(F.lit("filetype").alias("section"), F.col("filetype").alias("name"), "n"))
    )


def knowledge_gaps(g: Graph, thin: int = 2) -> DataFrame:
    """One row ``isolated, thin_communities, ambiguous``."""
    isolated = node_degrees(g).agg(F.count_if(F.col("degree") == 0).alias("isolated"))
    sizes = g.nodes.where("community <> ''").groupBy("community").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") < thin).alias("thin_communities"))
    ambiguous = g.edges.agg(F.count_if(F.col("confidence") == 2).alias("ambiguous"))
    return isolated.join(F.broadcast(sizes)).join(F.broadcast(ambiguous))


def isolated_nodes(g: Graph) -> DataFrame:
    return g.nodes.join(degrees(g.edges), "id", "left_anti").select("id", "label")


def ambiguous_edges(g: Graph, limit: int = 25) -> DataFrame:
    return g.edges.where("confidence = 2").orderBy("source", "target", "relation").limit(limit)


def dominant_confidence(g: Graph) -> DataFrame:
    """``id, confidence`` most frequent among a node's edges, the least name winning ties."""
    ends = g.edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id"), confidence_name().alias("c"))
    counted = ends.groupBy("id", "c").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "c")).alias("m")).select("id", F.col("m.c").alias("confidence"))


def sections(g: Graph, limit: int = 15) -> DataFrame:
    """``section, size, name``: communities by size with the commonest directory of their members' files."""
    from graphloom.functions.scalar import parent_dir_name

    named = g.nodes.select(F.when(F.col("community") == "", "uncategorized").otherwise(F.col("community")).alias("section"), parent_dir_name("sourcefile").alias("dir"))
    size = named.groupBy("section").agg(F.count(F.lit(1)).alias("size"))
    modal = named.where("dir <> ''").groupBy("section", "dir").agg(F.count(F.lit(1)).alias("n"))
    modal = modal.groupBy("section").agg(F.min(F.struct((-F.col("n")).alias("n"), "dir")).alias("m")).select("section", F.col("m.dir").alias("name"))
    out = size.join(modal, "section", "left").select("section", "size", F.coalesce("name", "section").alias("name"))
    return out.orderBy(F.desc("size"), "section").limit(limit)


def section_flow(g: Graph) -> DataFrame:
    """``a, b, n, relation``: directed edges between sections and the commonest relation among them (exact)."""
    e = with_ends(g, "community")
    s = lambda c: F.when(F.col(c) == "", "uncategorized").otherwise(F.col(c))
    per = e.select(s("s_community").alias("a"), s("t_community").alias("b"), "relation").where("a <> b").groupBy("a", "b", "relation").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy("a", "b").agg(F.sum("k").alias("n"), F.min(F.struct((-F.col("k")).alias("k"), "relation")).alias("m")).select("a", "b", "n", "m.relation")


def section_diagram(g: Graph, nodes: int = 18) -> DataFrame:
    """``section, id, rank``: per section the members with most links inside it."""
    e = with_ends(g, "community").where("s_community = t_community and s_community <> ''")
    inner = e.select(F.col("s_community").alias("section"), F.explode(F.array("source", "target")).alias("id")).groupBy("section", "id").agg(F.count(F.lit(1)).alias("d"))
    rank = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("d"), "id"))
    return inner.withColumn("rank", rank).where(F.col("rank") <= nodes).select("section", "id", "rank")


def inverted_index(pages: DataFrame, id_: str, text: str) -> DataFrame:
    """``token, pages``: sorted distinct page ids per token of three letters or more."""
    tokens = pages.select(F.col(id_).alias("page"), F.explode(F.array_distinct(tokenize(text))).alias("token"))
    return tokens.groupBy("token").agg(F.array_sort(F.collect_set("page")).alias("pages"))


def site_search(pages: DataFrame, index: DataFrame, question: str, limit: int = 50) -> DataFrame:
    """``page, score``: one point per token for every page indexed under it, or, for a token without postings, for every
    page whose title contains it; without tokens, pages whose title contains the question. ``pages`` has page, title."""
    spark = pages.sparkSession
    asked = spark.range(1).select(F.explode(F.array_distinct(tokenize(F.lit(question)))).alias("token"))
    if not asked.limit(1).count():
        hits = pages.where(F.contains(F.lower("title"), F.lower(F.lit(question)))).select("page", "title", F.lit(1).cast("bigint").alias("score"))
    else:
        words = [r.token for r in asked.collect()]
        posted = index.where(F.col("token").isin(words))
        found = posted.select("token", F.explode("pages").alias("page"))
        lacking = [w for w in words if w not in {r.token for r in posted.select("token").collect()}]
        titled = pages.select("page", F.explode(F.filter(F.array(*map(F.lit, lacking)) if lacking else F.array().cast("array<string>"), lambda t: F.contains(F.lower("title"), t))).alias("token"))
        scored = found.select("page", "token").unionByName(titled.select("page", "token")).groupBy("page").agg(F.count(F.lit(1)).alias("score"))
        hits = scored.join(pages, "page").select("page", "title", "score")
    return hits.orderBy(F.desc("score"), "title", "page").limit(limit).select("page", "score")


def tree_rollup(files: DataFrame, path: str, weight: Column | None = None) -> DataFrame:
    """``dir, files, total``: files below every directory and the sum of their weights; '' is the root."""
    parts = F.filter(F.split(F.col(path), "/"), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    rows = files.where(F.col(path) != "").select(F.explode(prefixes).alias("dir"), (weight if weight is not None else F.lit(1)).alias("w"))
    return rows.groupBy("dir").agg(F.count(F.lit(1)).alias("files"), F.sum("w").alias("total"))


def questions(g: Graph, limit: int = 10, per_kind: int = 2, bridges: DataFrame | None = None) -> DataFrame:
    """``rank, kind, question``: what the graph itself suggests to ask.

    Two of each of: most connected nodes, ambiguous edges, inferred edges, isolated nodes; then communities of low
    cohesion and bridging nodes (``bridges``: id, label, score), up to ``limit`` in all. Empty where nothing stands out.
    """
    deg = node_degrees(g).where(~is_hub_or_stub("id", "label", "degree"))
    shown = deg.withColumn("label", display_label())

    def ranked(df: DataFrame, seq: int, name: str, order: list, text: Column, budget: int) -> DataFrame:
        top = df.orderBy(*order).limit(budget).withColumn("i", F.row_number().over(Window.orderBy(*order)))
        return top.select(F.lit(seq).alias("seq"), "i", F.lit(name).alias("kind"), text.alias("question"))

    edge_text = lambda t: F.format_string(t, "source", "relation", "target")
    order_e = ["source", "target", "relation"]
    parts = [
        ranked(shown.where("degree > 0"), 0, "hub", [F.desc("degree"), "id"], F.format_string("Why do %2$d links meet at %1$s?", "label", "degree"), per_kind),
        ranked(g.edges.where("confidence = 2"), 1, "ambiguous", order_e, edge_text("Which is meant where %s %s %s?"), per_kind),
        ranked(g.edges.where("confidence = 1"), 2, "inferred", order_e, edge_text("Is it true that %s %s %s?"), per_kind),
        ranked(shown.where("degree = 0"), 3, "isolated", ["id"], F.format_string("What should %s be connected to?", "label"), per_kind),
        ranked(low_cohesion(g), 4, "cohesion", ["community"], F.format_string("Is %s one subject or several?", "community"), limit),
    ]
    if bridges is not None:
        parts.append(ranked(bridges, 5, "bridge", [F.desc("score"), "id"], F.format_string("What would come apart without %s?", "label"), limit))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("rank", F.row_number().over(Window.orderBy("seq", "i"))).where(F.col("rank") <= limit).select("rank", "kind", "question")


def token_benchmark(g: Graph, asked: list[str], words: int = 0, depth: int = 3, seeds: int = 3, per_token: int = 4) -> DataFrame:
    """``question, query_tokens, reduction``: size of the neighbourhood each question needs, against the whole corpus.

    A question's seeds are the nodes whose labels hit most of its terms; its text is what lies within ``depth`` steps.
    The corpus has ``words`` words (50 per node if not given) at 0.75 words a token.
    """
    from graphloom.functions.scalar import question_terms, round_one
    from graphloom.operators.paths import k_hop

    spark, n = g.nodes.sparkSession, g.nodes.count()
    corpus = (words or 50 * n) * 100 // 75
    rows = []
    for q in asked:
        terms = spark.range(1).select(question_terms(F.lit(q)).alias("t")).first().t
        hits = sum((F.contains(F.lower("label"), F.lit(t)).cast("int") for t in terms), F.lit(0))
        start = [r.id for r in g.nodes.select("id", hits.alias("h")).where("h > 0").orderBy(F.desc("h"), "id").limit(seeds).collect()]
        if not start:
            continue
        near = k_hop(g, start, depth)
        text = near.join(g.nodes.select("id", "label", "sourcefile"), "id").agg(F.sum(F.octet_length(F.concat_ws(" ", "label", "sourcefile")) + 1).alias("b")).first().b or 0
        edges = g.edges.join(near.select(F.col("id").alias("source")), "source", "left_semi").join(near.select(F.col("id").alias("target")), "target", "left_semi")
        linked = edges.agg(F.sum(F.octet_length(F.concat_ws(" ", "source", "relation", "target")) + 1).alias("b")).first().b or 0
        rows.append((q, max(1, (text + linked) // per_token)))
    df = spark.createDataFrame(rows, "question string, query_tokens bigint")
    return df.select("question", "query_tokens", round_one(F.lit(float(corpus)) / F.col("query_tokens")).alias("reduction"))


def kinds(g: Graph) -> DataFrame:
    return g.nodes.groupBy(kind().alias("kind")).agg(F.count(F.lit(1)).alias("n"))
