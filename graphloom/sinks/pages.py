"""Pages: wiki, static site, vault, tree, call-flow diagram, viewer and drawing of a graph.

Page bodies are built as rows (path, body) by the executors; only rendering of one fixed-size page runs on the driver.
"""

from __future__ import annotations

import html
import json
import math
import os
import re
import shutil

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalar import community_hue, confidence_name, display_label, slugify
from graphloom.model import Graph
from graphloom.operators import analyze
from graphloom.plans.rank import rank_within

MARKER = ".graphloom-pages"


def unique_slugs(df: DataFrame, label: str, order: str) -> DataFrame:
    """``df`` with ``slug``: slug of the label, the n-th of equal ones (by ``order``, case aside) suffixed ``_n``."""
    base = F.when(slugify(label) == "", "page").otherwise(slugify(label))
    ranked = rank_within(df.withColumn("_b", base), "_b", order, "_n")
    return ranked.withColumn("slug", F.when(F.col("_n") == 1, F.col("_b")).otherwise(F.concat("_b", F.lit("_"), F.col("_n").cast("string")))).drop("_b", "_n")


def community_pages(g: Graph, concepts: int = 25, related: int = 12, sources: int = 20) -> DataFrame:
    """``path, title, body``: a page per community with key nodes, related communities, sources and confidence."""
    deg = analyze.node_degrees(g).where("community <> ''").withColumn("label", display_label())
    top = lambda df, order, n, part="community": df.withColumn("i", F.row_number().over(Window.partitionBy(part).orderBy(*order))).where(F.col("i") <= n)
    bullets = lambda df, text, name: df.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", text.alias("t")))), lambda x: x["t"]), "\n").alias(name))
    key = bullets(top(deg, [F.desc("degree"), "id"], concepts), F.format_string("- %s (%d links)", "label", "degree"), "keys")
    across = analyze.cross_community(g)
    both = across.select(F.explode(F.array(F.struct(F.col("a").alias("community"), F.col("b").alias("other")), F.struct(F.col("b").alias("community"), F.col("a").alias("other")))).alias("x"), "n").select("x.*", "n")
    rel = bullets(top(both, [F.desc("n"), "other"], related), F.format_string("- %s: %d links", "other", "n"), "rels")
    files = deg.where("sourcefile <> ''").groupBy("community", "sourcefile").agg(F.count(F.lit(1)).alias("n"))
    src = bullets(top(files, [F.desc("n"), "sourcefile"], sources), F.format_string("- %s", "sourcefile"), "srcs")
    audit = analyze.community_audit(g).select("community", F.format_string("extracted %d%%, inferred %d%%, ambiguous %d%%", "extracted_pct", "inferred_pct", "ambiguous_pct").alias("audit"))
    names = analyze.community_labels(g)
    page = names.join(key, "community").join(rel, "community", "left").join(src, "community", "left").join(audit, "community", "left")
    body = F.concat(
        F.lit("# "), F.col("name"), F.lit("\n\n## Key nodes\n\n"), "keys", F.lit("\n\n## Related\n\n"), F.coalesce("rels", F.lit("None.")),
        F.lit("\n\n## Sources\n\n"), F.coalesce("srcs", F.lit("None.")), F.lit("\n\n## Confidence\n\n"), F.coalesce("audit", F.lit("no edges")), F.lit("\n"),
    )
    return unique_slugs(page, "name", "community").select(F.concat(F.lit("communities/"), "slug", F.lit(".md")).alias("path"), F.col("name").alias("title"), body.alias("body"))


def god_pages(g: Graph, limit: int = 10, connections: int = 30) -> DataFrame:
    """``path, title, body``: a page per most connected node with its connections."""
    gods = analyze.god_nodes(g, limit).select("id", "label", "degree")
    out = g.edges.select(F.col("source").alias("id"), "relation", F.col("target").alias("other"))
    arcs = out.unionByName(g.edges.select(F.col("target").alias("id"), "relation", F.col("source").alias("other")))
    near = arcs.join(F.broadcast(gods.select("id")), "id").distinct().join(analyze.node_degrees(g).select(F.col("id").alias("other"), display_label().alias("name"), F.col("degree").alias("d")), "other")
    ranked = near.withColumn("i", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("d"), "other", "relation"))).where(F.col("i") <= connections)
    lines = ranked.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.format_string("- %s: %s", "relation", "name").alias("t")))), lambda x: x["t"]), "\n").alias("lines"))
    page = unique_slugs(gods.join(lines, "id", "left"), "label", "id")
    body = F.concat(F.lit("# "), "label", F.format_string("\n\n%d links.\n\n", "degree"), F.coalesce("lines", F.lit("")), F.lit("\n"))
    return page.select(F.concat(F.lit("nodes/"), "slug", F.lit(".md")).alias("path"), F.col("label").alias("title"), body.alias("body"))


def wiki(g: Graph) -> DataFrame:
    """All wiki pages and their index."""
    pages = community_pages(g).unionByName(god_pages(g))
    listed = pages.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "title"))), lambda p: F.concat(F.lit("- ["), p["title"], F.lit("]("), p["path"], F.lit(")"))), "\n").alias("l"))
    return pages.unionByName(listed.select(F.lit("index.md").alias("path"), F.lit("Index").alias("title"), F.concat(F.lit("# Index\n\n"), "l", F.lit("\n")).alias("body")))


def vault(g: Graph) -> DataFrame:
    """``path, title, body``: a note per node with front matter, tags and links to its neighbours' notes."""
    nodes = unique_slugs(g.nodes.withColumn("label", display_label()), "label", "id")
    mode = analyze.dominant_confidence(g)
    link = nodes.select(F.col("id").alias("other"), F.col("slug").alias("to"))
    arcs = g.edges.select(F.col("source").alias("id"), "relation", F.col("target").alias("other")).distinct().join(link, "other")
    lines = arcs.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set(F.format_string("- %s [[%s]]", "relation", "to"))), "\n").alias("lines"))
    tag = F.regexp_replace(F.lower("filetype"), "[^a-z0-9/_-]+", "-")
    body = F.concat(
        F.lit("---\nid: "), F.to_json(F.struct("id")), F.lit("\nconfidence: "), F.coalesce("confidence", F.lit("")), F.lit("\ntags: ["), tag, F.lit("]\n---\n\n# "), "label",
        F.lit("\n\n"), F.coalesce("lines", F.lit("")), F.lit("\n"),
    )
    return nodes.join(mode, "id", "left").join(lines, "id", "left").select(F.concat("slug", F.lit(".md")).alias("path"), F.col("label").alias("title"), body.alias("body"))


def canvas(g: Graph, width: int = 260, height: int = 120) -> str:
    """A vault canvas: communities as groups on a square grid, their most connected members inside."""
    hubs = analyze.community_hubs(g, 100).collect()
    side = max(1, math.ceil(math.sqrt(len(hubs))))
    cells = [{"id": f"c{i}", "type": "text", "text": f"{r.community}: {r.label}", "x": (i % side) * (width + 40), "y": (i // side) * (height + 40), "width": width, "height": height} for i, r in enumerate(hubs)]
    at = {r.community: f"c{i}" for i, r in enumerate(hubs)}
    links = [{"id": f"e{i}", "fromNode": at[r.a], "toNode": at[r.b], "label": str(r.n)} for i, r in enumerate(analyze.cross_community(g).where(F.col("a").isin(list(at)) & F.col("b").isin(list(at))).orderBy("a", "b").collect())]
    return json.dumps({"nodes": cells, "edges": links}, ensure_ascii=False, indent=1)


def site(g: Graph) -> tuple[DataFrame, DataFrame]:
    """HTML pages (path, title, body) of the wiki, and the search index (token, pages)."""
    pages = wiki(g)
    para = F.array_join(F.transform(F.split("body", "\n\n"), lambda p: F.concat(F.lit("<p>"), F.replace(F.replace(F.replace(p, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("<br>")), F.lit("</p>"))), "\n")
    body = F.concat(F.lit("<!doctype html><meta charset=utf-8><title>"), "title", F.lit("</title>\n"), para)
    out = pages.select(F.regexp_replace("path", r"\.md\z", ".html").alias("path"), "title", body.alias("body"))
    return out, analyze.inverted_index(pages.select("path", F.concat_ws(" ", "title", "body").alias("text")), "path", "text")


def write_pages(pages: DataFrame, directory: str) -> int:
    """Write pages below a local directory that is empty, new, or was written by this function before."""
    if os.path.isdir(directory) and os.listdir(directory) and not os.path.exists(os.path.join(directory, MARKER)):
        raise FileExistsError(f"{directory} holds files of someone else")
    shutil.rmtree(directory, ignore_errors=True)
    os.makedirs(directory)
    open(os.path.join(directory, MARKER), "w").close()
    n = 0
    for r in pages.select("path", "body").toLocalIterator():
        target = os.path.join(directory, r.path)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "w", encoding="utf-8") as f:
            f.write(r.body)
        n += 1
    return n


def tree_page(g: Graph, most: int = 200) -> str:
    """Nested HTML list of directories with file and symbol counts, at most ``most`` children shown each."""
    files = g.nodes.where("sourcefile <> ''").groupBy("sourcefile").agg(F.count(F.lit(1)).alias("n"))
    dirs = {r.dir: (r.files, r.total) for r in analyze.tree_rollup(files, "sourcefile", F.col("n")).collect()}
    below: dict[str, list[str]] = {}
    for d in sorted(dirs):
        if d:
            below.setdefault(d.rpartition("/")[0], []).append(d)

    def show(d: str) -> str:
        kids = below.get(d, [])
        inner = "".join(show(k) for k in kids[:most]) + (f"<li>(+{len(kids) - most} more)</li>" if len(kids) > most else "")
        return f"<li>{html.escape(d.rpartition('/')[2] or '/')} ({dirs[d][0]} files, {dirs[d][1]} symbols)<ul>{inner}</ul></li>"

    return f"<!doctype html><meta charset=utf-8><title>Tree</title><ul>{show('') if '' in dirs else ''}</ul>"


def mermaid_id(text: str) -> str:
    """Letters, digits and underscores, with a 32-bit FNV hash where anything was replaced."""
    safe = re.sub(r"[^A-Za-z0-9_]", "_", text)
    if safe == text and text:
        return safe
    h = 2166136261
    for b in text.encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return f"{safe[:40]}_{h:08x}"


def callflow_page(g: Graph, overview: int = 12) -> str:
    """Call-flow diagram of the largest sections."""
    sections = {r.section: r for r in analyze.sections(g).collect()}
    flows = analyze.section_flow(g).where(F.col("a").isin(list(sections)) & F.col("b").isin(list(sections))).orderBy(F.desc("n"), "a", "b").limit(overview).collect()
    clean = lambda s: re.sub(r"[\"\[\]{}<>|]", " ", str(s))
    lines = ["flowchart LR"] + [f'  {mermaid_id(s)}["{clean(r.name)} ({r.size})"]' for s, r in sections.items()]
    lines += [f"  {mermaid_id(r.a)} -->|{clean(r.relation)} {r.n}| {mermaid_id(r.b)}" for r in flows]
    return "<!doctype html><meta charset=utf-8><title>Call flow</title><pre class=mermaid>\n" + html.escape("\n".join(lines), quote=False) + "\n</pre>"


def viewer_page(g: Graph, threshold: int = 1000) -> str:
    """Self-contained page with the graph as data (its communities only, beyond ``threshold`` nodes) and a filter box."""
    from graphloom.operators.build import between, community_meta_graph

    small = community_meta_graph(g, threshold)
    nodes = [r.asDict() for r in small.nodes.select("id", display_label().alias("label"), "community", community_hue("community").alias("hue")).orderBy("id").collect()]
    edges = [r.asDict() for r in between(small.edges, small.nodes).select("source", "target", "relation", confidence_name().alias("confidence")).orderBy("source", "target", "relation").collect()]
    data = json.dumps({"nodes": nodes, "edges": edges}, ensure_ascii=False).replace("</", "<\\/")
    script = "const show=q=>{q=q.toLowerCase();const on=new Set(G.nodes.filter(n=>n.label.toLowerCase().includes(q)).map(n=>n.id));L.innerHTML='';for(const e of G.edges)if(on.has(e.source)||on.has(e.target)){const i=document.createElement('li');i.textContent=e.source+' '+e.relation+' '+e.target;L.append(i)}};Q.oninput=()=>show(Q.value);show('')"
    return f"<!doctype html><meta charset=utf-8><title>Graph</title><input id=Q placeholder=filter><ul id=L></ul><script>const G={data};{script}</script>"


def drawing(g: Graph, size: int = 1000, rounds: int = 120, most: int = 2000) -> str:
    """Static SVG by force-directed placement of a graph of at most ``most`` nodes (larger ones by their communities)."""
    from graphloom.operators.build import between, community_meta_graph

    small = community_meta_graph(g, most)
    nodes = small.nodes.select("id", display_label().alias("label"), community_hue("community").alias("hue")).orderBy("id").collect()
    index = {r.id: i for i, r in enumerate(nodes)}
    pairs = np.array([(index[r.source], index[r.target]) for r in between(small.edges, small.nodes).select("source", "target").distinct().collect() if r.source != r.target]).reshape(-1, 2)
    n = len(nodes)
    at = np.random.default_rng(1).random((n, 2)) * size
    k = size / math.sqrt(max(1, n))
    for step in range(rounds if n > 1 else 0):
        gap = at[:, None] - at[None]
        dist = np.maximum(np.sqrt((gap**2).sum(-1)), 0.01)
        force = (gap * (k * k / dist**2)[..., None]).sum(1)
        if len(pairs):
            d = at[pairs[:, 0]] - at[pairs[:, 1]]
            pull = d * (np.sqrt((d**2).sum(-1)) / k)[:, None]
            np.add.at(force, pairs[:, 0], -pull)
            np.add.at(force, pairs[:, 1], pull)
        length = np.maximum(np.sqrt((force**2).sum(-1)), 0.01)
        at += force / length[:, None] * np.minimum(length, size / 10 * (1 - step / rounds))[:, None]
        at = np.clip(at, 0, size)
    lines = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="-20 -20 {size + 40} {size + 40}">']
    lines += [f'<line x1="{at[a, 0]:.1f}" y1="{at[a, 1]:.1f}" x2="{at[b, 0]:.1f}" y2="{at[b, 1]:.1f}" stroke="#999"/>' for a, b in pairs]
    lines += [f'<circle cx="{x:.1f}" cy="{y:.1f}" r="5" fill="hsl({r.hue},60%,50%)"><title>{html.escape(r.label)}</title></circle>' for r, (x, y) in zip(nodes, at)]
    return "\n".join([*lines, "</svg>"])
