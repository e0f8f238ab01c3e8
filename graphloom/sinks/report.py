"""The graph report: figures and findings as Markdown, from small aggregated results."""

from __future__ import annotations

import re

from graphloom.model import Graph
from graphloom.operators import analyze


def escape(text: str) -> str:
    """Markdown's special characters as text, on one line."""
    return re.sub(r"([\\`*_{}\[\]<>()#+!|])", r"\\\1", " ".join(str(text).split()))


def _table(title: str, names: list[str], rows: list, empty: str = "None.") -> str:
    if not rows:
        return f"## {title}\n\n{empty}\n"
    head = f"| {' | '.join(names)} |\n|{'---|' * len(names)}\n"
    return f"## {title}\n\n{head}" + "\n".join("| " + " | ".join(escape(c) for c in r) + " |" for r in rows) + "\n"


def report(g: Graph, title: str = "Graph report") -> str:
    """Sections in fixed order; every number is an aggregate, so only what is printed reaches the driver."""
    part = lambda df, *c: [tuple(r) for r in df.select(*c).collect()]
    stats = part(analyze.graph_stats(g).orderBy("section", "name"), "section", "name", "n")
    gaps = analyze.knowledge_gaps(g).first()
    sections = [
        f"# {escape(title)}\n" + (f"\nBuilt at commit {g.commit}.\n" if g.commit else ""),
        _table("Figures", ["what", "name", "count"], stats),
        _table("Corpus", ["what", "name", "count"], part(analyze.corpus_figures(g).orderBy("section", "name"), "section", "name", "n")),
        _table("Confidence", ["level", "edges"], part(analyze.confidence_summary(g.edges).orderBy("confidence"), "confidence", "n")),
        _table("Most connected", ["rank", "node", "links"], part(analyze.god_nodes(g).orderBy("rank"), "rank", "label", "degree")),
        _table("Hubs of communities", ["community", "node", "links"], part(analyze.community_hubs(g), "community", "label", "degree")),
        _table("Surprising links", ["rank", "from", "relation", "to", "points"], part(analyze.surprising_links(g).orderBy("rank"), "rank", "source", "relation", "target", "score")),
        _table("Communities", ["community", "members", "some of them"], part(analyze.community_members(g).orderBy("community"), "community", "size", "members")),
        _table("Ambiguous", ["from", "relation", "to"], part(analyze.ambiguous_edges(g), "source", "relation", "target")),
        f"## Gaps\n\n- isolated nodes: {gaps.isolated}\n- communities of one: {gaps.thin_communities}\n- ambiguous edges: {gaps.ambiguous}\n",
        _table("Questions", ["rank", "kind", "question"], part(analyze.questions(g).orderBy("rank"), "rank", "kind", "question"), "Nothing stands out."),
    ]
    return "\n".join(sections)
