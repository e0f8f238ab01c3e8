import os
import random

import pytest
from pyspark.sql import functions as F

from graphloom.catalog.graph import QUERIES
from graphloom.engine import Engine
from graphloom.functions import scalar as fn
from graphloom.model import EDGE_SCHEMA, HYPEREDGE_SCHEMA, Graph, graph, tpch_graph
from graphloom.operators import analyze, build, centrality, diff, entity_resolution
from graphloom.operators.centrality import betweenness
from graphloom.operators.communities import detect, modularity, split_communities, with_communities
from graphloom.operators.components import components
from graphloom.operators.entity_resolution import fuzzy_candidates, fuzzy_matches, resolve_entities, scored_pairs
from graphloom.operators.paths import shortest_path
from graphloom.operators.resolve import resolve_calls, resolve_imports, resolve_inheritance, resolve_methods

SMALL = "/root/testdata/sf0.001"


def g_of(spark, nodes, edges):
    """Nodes as id or (id, label, sourcefile, community, filetype); edges as (source, target, relation, confidence)."""
    full = [(n, n) if isinstance(n, str) else n for n in nodes]
    full = [(*n, *[""] * (5 - len(n))) for n in full]
    e = [(*x, *["calls", 0][len(x) - 2 :]) for x in edges]
    return graph(spark.createDataFrame(full, "id string, label string, sourcefile string, community string, filetype string"), spark.createDataFrame(e, EDGE_SCHEMA))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("text, want", [("Hello World", "hello world"), ("  Spaces  ", "spaces"), ("Punctuation!!!", "punctuation"), ("a-b_c.d", "a b c d"), ("", "")])
def test_normalize(spark, text, want):
    assert spark.range(1).select(fn.normalize_label(F.lit(text))).first()[0] == want


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(fn.entropy(F.lit(x))) for x in ("aaa", "ab", "")] == [0, 1.0, 0]
    assert [one(fn.shingles(F.lit(x))) for x in ("hello", "he llo", "ab")] == [["hel", "ell", "llo"], ["hel", "ell", "llo"], ["ab"]]
    assert [one(fn.round_one(F.lit(x))) for x in (2.25, 2.75, 2.15, 2.24, 2.26, 0.25)] == [2.2, 2.8, 2.2, 2.2, 2.3, 0.2]
    assert [one(fn.estimate_tokens(F.lit(x))) for x in ("", "abcd", "abcdefghij")] == [1, 1, 2]
    assert one(fn.sanitize_text(F.lit("\x1b[  a\u0007b　"))) == "[  ab"
    assert round(fn.jaro_winkler_pair("martha", "marhta"), 4) == 0.9611 and round(fn.jaro_winkler_pair("dwayne", "duane"), 2) == 0.84
    assert one(fn.suffix_overlap(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "xbc")))) == 2
    assert one(fn.community_hue(F.lit("c1"))) == ((ord("c") * 131 + ord("1")) % 2**32) % 360
    assert one(fn.repo_tag_ok(F.lit("a::b"))) is False and one(fn.repo_tag_ok(F.lit("ab"))) is True
    assert one(fn.cypher_relation(F.lit("is-a"))) == "IS_A" and one(fn.slugify(F.lit("A b!"))) == "a-b"


def test_god_nodes(spark):
    assert [r.id for r in analyze.god_nodes(g_of(spark, ["hub", "a", "b", "c"], [("hub", x) for x in "abc"])).collect()] == ["hub"]
    g = g_of(spark, ["hub", "hub2", "a", "b", "c", "d"], [("hub", x) for x in "abc"] + [("hub2", x) for x in "abd"])
    assert [r.id for r in analyze.god_nodes(g).collect()] == ["hub"]
    g = g_of(spark, [("go:module:x", "x"), ("go:method:y", ".run()"), "a", "b"], [("go:module:x", "a"), ("go:module:x", "b"), ("go:method:y", "a"), ("go:method:y", "b")])
    assert {r.id for r in analyze.god_nodes(g).collect()} == {"a"}


@pytest.mark.parametrize(
    "edge, ends, degrees, want",
    [
        (("semantically_similar_to", 0), (("a/x", "code"), ("b/y", "document")), 0, 7),
        (("calls", 2), (("a/x", "code"), ("b/y", "document")), 9, 8),
        (("calls", 0), (("a/x", "code"), ("", "code")), 0, 1),
        (("calls", 0), (("a/x", "code"), ("b/y", "")), 0, 3),
    ],
)
def test_surprise_score(spark, edge, ends, degrees, want):
    (f1, t1), (f2, t2) = ends
    nodes = [("u", "u", f1, "A", t1), ("v", "v", f2, "B", t2)]
    g = g_of(spark, nodes, [("u", "v", *edge)] + [("v", f"x{i}", "calls", 0) for i in range(degrees)])
    e = analyze.with_ends(g, "community", "filetype", "sourcefile", "degree").where("target = 'v'")
    assert e.select(analyze.surprise_score(e)).first()[0] == want


def test_cohesion(spark):
    def score(nodes, edges):
        g = g_of(spark, [(n, n, "", "c") for n in nodes], edges)
        return analyze.cohesion(g).first()

    assert score("abcd", [("a", "b"), ("b", "c"), ("c", "d")]).cohesion == 0.5
    assert score("abc", [("a", "b"), ("b", "c"), ("c", "a")]).cohesion == 1.0
    assert score("a", []).cohesion == 1.0 and score("ab", [("a", "b"), ("b", "a")]).cohesion == 1.0


def test_betweenness(spark):
    line = g_of(spark, list("abcde"), [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")])
    assert dict(rows(betweenness(line))) == {"a": 0, "b": 3, "c": 4, "d": 3, "e": 0}
    assert dict(rows(betweenness(line, block=2, broadcast_links=0))) == {"a": 0, "b": 3, "c": 4, "d": 3, "e": 0}
    assert {r.score for r in betweenness(g_of(spark, list("abc"), [("a", "b"), ("b", "c"), ("c", "a")])).collect()} == {0.0}
    assert {r.score for r in betweenness(g_of(spark, list("abc"), [])).collect()} == {0.0}


def test_betweenness_with_cycles_against_brute_force(spark):
    r = random.Random(5)
    names = [f"n{i:02d}" for i in range(24)]
    edges = [(a, b) for a, b in (r.sample(names[:20], 2) for _ in range(40))] + [("n20", "n21"), ("n21", "n22"), ("n22", "n20")]
    near = {x: {b if a == x else a for a, b in edges if x in (a, b)} for x in names}

    def paths(a, b):
        layer = [[a]]
        while layer and not any(p[-1] == b for p in layer):
            seen = {x for p in layer for x in p}
            layer = [p + [y] for p in layer for y in near[p[-1]] if y not in seen]
        return [p for p in layer if p[-1] == b]

    want = dict.fromkeys(names, 0.0)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            found = paths(a, b)
            for p in found:
                for x in p[1:-1]:
                    want[x] += 1 / len(found)
    g = g_of(spark, names, edges)
    for limit in (0, 1000):
        assert dict(rows(betweenness(g, block=5, broadcast_links=limit))) == pytest.approx(want)


def test_betweenness_of_a_forest_needs_no_search(spark, monkeypatch):
    """Two trees of three levels and a pair, named so that leaves come before and after what they hang on."""

    def search(*_):
        raise AssertionError("an adjacency was made for searches")

    monkeypatch.setattr(centrality, "_index", search)
    edges = [("m", x) for x in ("a", "n", "z")] + [("a", f"a{i}") for i in range(3)] + [("z", f"b{i}") for i in range(4)]
    got = dict(rows(betweenness(g_of(spark, sorted({x for e in edges for x in e}) + ["p", "q", "lone"], [*edges, ("p", "q")]))))
    assert {k: v for k, v in got.items() if v} == {"m": 5 * 4 + 4 + 5, "a": 3 + 3 * 7, "z": 6 + 4 * 6}
    assert set(got) >= {"p", "q", "lone", "a0", "b3"}


def test_bridge_nodes_of_a_forest_need_no_search(spark, monkeypatch):
    monkeypatch.setattr(centrality, "_index", None)
    g = g_of(spark, ["m", "a", "n", "z", "a0", "a1"], [("m", x) for x in "anz"] + [("a", "a0"), ("a", "a1")])
    assert [tuple(r) for r in centrality.bridge_nodes(g).collect()] == [("a", "a", 7.0), ("m", "m", 7.0)]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
@pytest.mark.parametrize("name", ["betweenness_whole", "leiden"])
def test_registered_on_the_whole_graph(spark, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert sorted(got["id"]) == sorted(r.id for r in tpch_graph(spark, SMALL).nodes.select("id").collect())
    if name == "betweenness_whole":
        assert {"order", "part"} <= set(got["id"][got["score"] > 0].str.split(":").str[1])


def test_louvain(spark):
    tri = lambda a, b, c: [(a, b), (b, c), (c, a)]
    g = g_of(spark, list("abcxyz") + ["lone"], tri(*"abc") + tri(*"xyz") + [("c", "x"), ("a", "phantom"), ("b", "b")])
    for method in ("louvain", "leiden"):
        found = detect(g, method=method)
        groups = {}
        for r in found.collect():
            groups.setdefault(r.community, set()).add(r.id)
        assert sorted(map(sorted, groups.values())) == [["a", "b", "c"], ["lone"], ["x", "y", "z"]]
        assert modularity(g, found) > 0.3
    assert {r.community for r in with_communities(g, detect(g)).nodes.collect()} == {"0", "1", "2"}
    assert detect(g_of(spark, list("ab"), [])).count() == 2
    assert split_communities(g, g.nodes.select("id", F.lit("0").alias("community")), largest=0.3, least=2).select("community").distinct().count() >= 2


def test_components(spark):
    r = random.Random(7)
    edges = [(f"n{r.randrange(60):02d}", f"n{r.randrange(60):02d}") for _ in range(45)]
    g = g_of(spark, [f"n{i:02d}" for i in range(60)], edges)
    root = {f"n{i:02d}": f"n{i:02d}" for i in range(60)}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert dict(rows(components(g.nodes, build.graph_links(g)))) == root


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
@pytest.mark.parametrize("name", ["components_whole", "components_orders"])
def test_components_of_all_rows_against_brute_force(spark, name):
    if name == "components_whole":
        g = tpch_graph(spark, SMALL)
        links, root = g.edges.select("source", "target").collect(), {r.id: r.id for r in g.nodes.select("id").collect()}
    else:
        links = spark.read.parquet(f"{SMALL}/lineitem.parquet").selectExpr("'o:' || l_orderkey", "'p:' || l_partkey").collect()
        root = {x: x for ends in links for x in ends}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert dict(rows(QUERIES[name](spark, SMALL))) == {x: find(x) for x in root}


def test_shortest_path_is_least(spark):
    g = g_of(spark, list("abcdef"), [("a", "c"), ("a", "b"), ("c", "d"), ("b", "d"), ("d", "e")])
    assert [r.id for r in shortest_path(g, "a", "e").orderBy("step").collect()] == list("abde")
    assert shortest_path(g, "a", "f").count() == 0 and [tuple(r) for r in shortest_path(g, "a", "a").collect()] == [(0, "a")]


def test_shortest_path_is_found_however_long(spark):
    names = [f"n{i:02d}" for i in range(68)]
    assert [r.id for r in shortest_path(g_of(spark, names, list(zip(names, names[1:]))), "n00", "n67").orderBy("step").collect()] == names


def test_hyperedges(spark):
    h = lambda *m: spark.createDataFrame([(list(m), "r", 1)], HYPEREDGE_SCHEMA)
    many = [f"m{i:02d}" for i in range(20)]
    assert [build.expand_hyperedges(h(*x), cap).count() for x, cap in ((("a", "b", "c"), 8), (many, 8), (many, 0), (("a", "", "a"), 8))] == [3, 0, 190, 0]


def test_dedup(spark):
    fn_ = lambda n, label: (f"go:function:{n}", label)
    g, remap = resolve_entities(g_of(spark, [fn_("a", "Main"), fn_("b", "main"), fn_("c", "Helper")], [("go:function:a", "go:function:c"), ("go:function:b", "go:function:c")]))
    assert (g.nodes.count(), remap.count(), g.edges.count()) == (2, 1, 1)
    g, _ = resolve_entities(g_of(spark, [fn_("a", "Main"), fn_("b", "main")], [("go:function:a", "go:function:b")]))
    assert g.edges.count() == 0
    g, _ = resolve_entities(g_of(spark, [fn_("a", "GraphExtractor"), fn_("b", "Graph Extractor"), fn_("c", "SomethingElse")], [("go:function:a", "go:function:c"), ("go:function:b", "go:function:c")]))
    assert (g.nodes.count(), g.edges.count()) == (2, 1)
    g, _ = resolve_entities(g_of(spark, [fn_("a", "Foo"), fn_("b", "Bar"), fn_("c", "Baz")], [("go:function:a", "go:function:b"), ("go:function:b", "go:function:c")]))
    assert (g.nodes.count(), g.edges.count()) == (3, 2)


def test_dedup_links_equals_without_components(spark, monkeypatch):
    """Chains of equals and alike labels end in one winner; stars are given the links between distinct labels alone."""
    given = []
    stars = entity_resolution.star_roots
    monkeypatch.setattr(entity_resolution, "star_roots", lambda links: given.append(links.count()) or stars(links))
    labels = ["extractGraphNodes"] * 20 + ["extract_graph_nodes"] * 20 + ["extractGraphNodes2"] * 20 + ["somethingElse"] * 5 + ["!!"] * 2
    _, remap = resolve_entities(g_of(spark, [(f"x:function:{i:02d}", x, "", "", "code") for i, x in enumerate(labels)], []))
    got = dict(rows(remap))
    assert len(given) == 1 and 0 < given[0] <= 3
    assert {k for k, v in got.items() if v == "x:function:60"} == {f"x:function:{i}" for i in range(61, 65)}
    assert set(got) & {"x:function:65", "x:function:66"} == set()
    assert {v for k, v in got.items() if k < "x:function:60"} == {"x:function:00"} and sum(k < "x:function:60" for k in got) == 59


def test_fuzzy_matches_are_the_candidates_of_enough_score(spark):
    """Labels that all share one gram, in two buckets and communities; only alike pairs leave the task that compares them."""
    r = random.Random(9)
    labels = ["zzz " + "".join(r.choice("abcdefgh") for _ in range(8)) for _ in range(150)]
    labels += [x[:-1] + "q" for x in labels[:60]]
    kinds = ("function", "module")
    nodes = g_of(spark, [(f"x:{kinds[i % 2]}:{i:03d}", x, "", f"c{i % 3}") for i, x in enumerate(labels * 2)], []).nodes
    pairs = scored_pairs(nodes, fuzzy_candidates(nodes)).collect()
    assert pairs
    for least in (92.0, 75.0):
        assert {(a.u, a.v, a.score) for a in fuzzy_matches(nodes, least).collect()} == {(a.u, a.v, a.score) for a in pairs if a.score >= least}


def test_fuzzy_candidates_against_all_pairs(spark):
    r = random.Random(4)
    labels = ["".join(r.choice("abcdef") for _ in range(r.randrange(6, 14))) for _ in range(40)]
    labels += [x[:-1] + "z" for x in labels[:15]]
    nodes = g_of(spark, [(f"x:function:{i:02d}", x) for i, x in enumerate(labels)], []).nodes
    got = {(a.u, a.v) for a in fuzzy_candidates(nodes).collect()}
    import math

    ent = lambda s: -sum(s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in set(s))
    grams = lambda s: {s[i : i + 3] for i in range(len(s) - 2)}
    first = {}
    for i, x in enumerate(labels):
        if ent(x) >= 2.5:
            first.setdefault(x, f"x:function:{i:02d}")
    want = {(a, b) for x, a in first.items() for y, b in first.items() if a < b and len(grams(x) & grams(y)) >= 0.7 * max(len(grams(x)), len(grams(y)))}
    assert got == want


def test_resolve_calls(spark):
    call = ("go:call:foo", "foo")
    bar = ("go:function:/m.go:main:bar", "bar", "/m.go")
    foo = lambda f: (f"go:function:{f}:foo", "foo", f)
    g = resolve_calls(g_of(spark, [call, bar, foo("/a.go")], [(bar[0], call[0])]))
    assert rows(g.edges) == [(bar[0], foo("/a.go")[0], "calls", 1)] and "go:call:foo" not in {r.id for r in g.nodes.collect()}
    g = resolve_calls(g_of(spark, [call, bar, foo("/a.go"), foo("/b.go")], [(bar[0], call[0])]))
    assert {r.confidence for r in g.edges.collect()} == {2} and g.edges.count() == 2 and "go:call:foo" in {r.id for r in g.nodes.collect()}
    g = resolve_calls(g_of(spark, [call, bar], [(bar[0], call[0])]))
    assert rows(g.edges) == [(bar[0], "go:call:foo", "calls", 0)]


def test_resolve_calls_narrowed_by_imports(spark):
    nodes = [("py:module:main.py", "main.py", "main.py"), ("py:function:main.py:run", "run", "main.py"), ("py:call:login", "login"), ("py:import:auth.login", "auth.login")]
    nodes += [(f"py:function:{f}:login", "login", f) for f in ("auth.py", "users.py")]
    g = resolve_calls(g_of(spark, nodes, [("py:module:main.py", "py:import:auth.login", "imports", 0), ("py:function:main.py:run", "py:call:login")]))
    assert ("py:function:main.py:run", "py:function:auth.py:login", "calls", 1) in rows(g.edges) and g.edges.count() == 2


def test_resolve_methods_and_inheritance(spark):
    nodes = [("go:type:/d/t.go:T", "T", "/d/t.go"), ("go:method:/d/m.go:T.Run", "Run", "/d/m.go"), ("go:typeref:T", "T"), ("go:method:/e/m.go:T.No", "No", "/e/m.go")]
    g = resolve_methods(g_of(spark, nodes, [("go:method:/d/m.go:T.Run", "go:typeref:T", "method_of", 0), ("go:method:/e/m.go:T.No", "go:typeref:T", "method_of", 0)]))
    assert rows(g.edges) == [("go:type:/d/t.go:T", "go:method:/d/m.go:T.Run", "contains", 0)] and g.nodes.count() == 3
    nodes = [("py:class:a.py:A", "A", "a.py"), ("py:class:b.py:B", "B", "b.py"), ("py:typeref:A", "A"), ("py:typeref:B", "B")]
    g = resolve_inheritance(g_of(spark, nodes, [("py:class:b.py:B", "py:typeref:A", "inherits", 0), ("py:typeref:B", "py:typeref:A", "implements", 0)]))
    assert rows(g.edges) == [("py:class:b.py:B", "py:class:a.py:A", "implements", 1), ("py:class:b.py:B", "py:class:a.py:A", "inherits", 1)]


@pytest.mark.parametrize(
    "lang, importer, spec, files, want",
    [
        ("go", "/repo/main.go", "github.com/x/repo/pkg/config", ["/repo/pkg/config/a.go", "/repo/pkg/config/b.go"], 2),
        ("py", "/repo/main.py", "pkg.config.Loader", ["/repo/pkg/config.py"], 1),
        ("js", "/repo/src/a.js", "./util/fmt", ["/repo/src/util/fmt.js"], 1),
        ("go", "/repo/main.go", "fmt", ["/repo/pkg/fmt.go"], 0),
        ("py", "/repo/main.py", "config", ["/repo/pkg/config.py"], 0),
    ],
)
def test_resolve_imports(spark, lang, importer, spec, files, want):
    nodes = [(f"{lang}:module:{importer}", "m", importer), (f"{lang}:import:{spec}", spec)] + [(f"{lang}:module:{f}", f, f) for f in files]
    g = resolve_imports(g_of(spark, nodes, [(f"{lang}:module:{importer}", f"{lang}:import:{spec}", "imports", 0)]))
    made = [r for r in g.edges.collect() if r.confidence == 1]
    assert len(made) == want and {r.target for r in made} <= {f"{lang}:module:{f}" for f in files}


def test_incremental_merge(spark):
    prior = g_of(spark, [("a1", "Foo (old)", "/a.go"), ("a2", "x", "/a.go"), ("b1", "y", "/b.go"), ("e", "ext", "")], [("a1", "a2"), ("a1", "b1"), ("a1", "e")])
    got = build.incremental_merge(prior, g_of(spark, [], []).with_(nodes=prior.nodes.limit(0), edges=prior.edges.limit(0)), spark.createDataFrame([("/a.go",)], "sourcefile string"))
    assert {r.id for r in got.nodes.collect()} == {"a1", "a2", "e"} and got.edges.count() == 2
    got = build.incremental_merge(prior, g_of(spark, [("a1", "Foo (new)", "/a.go")], []))
    assert [r.label for r in got.nodes.where("id = 'a1'").collect()] == ["Foo (new)"]


def test_diff_ignores_confidence(spark):
    a, b = g_of(spark, ["a", "b"], [("a", "b", "calls", 0)]), g_of(spark, ["a", "b"], [("a", "b", "calls", 2)])
    assert diff.diff_edges(a, b).count() == 0 and diff.diff_nodes(a, b).count() == 0
    gate = diff.gate(a, g_of(spark, ["a", "c"], [("a", "c", "calls", 2)]), max_ambiguous=0).first()
    assert (gate.nodes_added, gate.nodes_removed, gate.new_ambiguous, gate.passed) == (1, 1, 1, False)


def test_store(spark, tmp_path):
    store = build.GraphStore(spark, str(tmp_path / "s"))
    one = lambda r: g_of(spark, [(f"{r}1", "f", "/f.go"), (f"{r}2", "g", "/g.go"), ("ctx", "context.Context", "")], [(f"{r}1", "ctx"), (f"{r}1", f"{r}2")])
    assert store.add("r1", one("x"), "h1", "now") and store.add("r2", one("y"), "h2", "now") and not store.add("r1", one("x"), "h1", "now")
    assert store.load().nodes.where("label = 'context.Context'").count() == 1 and store.load().nodes.count() == 5
    assert store.remove("r1") and not store.remove("r1") and set(store.list()) == {"r2"} and store.load().nodes.count() == 3
    with pytest.raises(ValueError):
        store.add("a/b", one("z"), "h", "now")


def test_engine(spark):
    g = g_of(spark, [("foo", "Foo", "f.go", "core"), ("bar", "Bar", "b.go", "core"), ("hub", "Hub", "h.go", "core")], [("foo", "hub"), ("bar", "hub", "imports", 1)])
    e = Engine(g)
    assert e.find("Hub") == "hub" and e.find("none") is None
    assert [r.id for r in e.search("hub").collect()] == ["hub"]
    assert {(r.direction, r.other) for r in e.explain("Hub").collect()} == {("in", "foo"), ("in", "bar")}
    assert [r.id for r in e.neighbors("hub", "imports").collect()] == ["bar"]
    assert {r.id for r in e.community("foo").collect()} == {"foo", "bar", "hub"}
    assert [r.id for r in e.path("foo", "bar").orderBy("step").collect()] == ["foo", "hub", "bar"]
    assert {(r.hop, r.id) for r in e.traverse("foo", 1).collect()} == {(0, "foo"), (1, "hub")}
    assert e.subgraph(label="foo").edges.count() == 1
    import json

    ask = lambda **x: json.loads(e.handle(json.dumps({"jsonrpc": "2.0", "id": 1, **x})))
    assert len(ask(method="tools/list")["result"]["tools"]) == 8 and len(ask(method="resources/list")["result"]["resources"]) == 6
    assert "hub" in ask(method="tools/call", params={"name": "god_nodes", "arguments": {}})["result"]["content"][0]["text"]
    assert ask(method="nope")["error"]["code"] == -32601 and ask(method="tools/call", params={"name": "x"})["error"]["code"] == -32602
    assert json.loads(e.handle("{"))["error"]["code"] == -32700
    for r in Engine.RESOURCES:
        assert "contents" in ask(method="resources/read", params={"uri": f"graph://{r}"})["result"]


def test_violations_and_builder(spark):
    g = g_of(spark, [("a", ""), ("b", "B")], [("a", "b", "", 0), ("a", "x", "calls", 7)])
    assert {r.problem for r in build.violations(g).collect()} == {"node without label", "edge without relation", "unknown confidence", "unknown endpoint"}
    raw = spark.createDataFrame([("a", " A\x07 ", "f", 1), ("a", "later", "f", 2), ("b", "\x00", "f", 1)], "id string, label string, sourcefile string, seq int")
    assert [(r.id, r.label) for r in build.build_nodes(raw, ["seq"]).collect()] == [("a", "A")]
    assert [(r.id, r.label) for r in build.index_nodes(raw.where("id = 'a'"), ["seq"]).collect()] == [("a", "later")]


def test_token_benchmark(spark):
    g = g_of(spark, [("x:function:auth", "authHandler"), ("x:function:main", "main"), ("x:function:db", "dbPool")], [("x:function:main", "x:function:auth")])
    got = analyze.token_benchmark(g, ["how does main work", "zz qq"]).collect()
    assert len(got) == 1 and got[0].reduction > 0


def test_questions_short_circuit(spark):
    empty = Graph(g_of(spark, ["a"], []).nodes.limit(0), g_of(spark, ["a"], []).edges.limit(0))
    assert analyze.questions(empty).count() == 0


def test_diff_summary(spark):
    node = "id string, label string, community string, filetype string"
    old = graph(spark.createDataFrame([("a", "A", "1", "code"), ("b", "B", "", "")], node), spark.createDataFrame([("a", "b", "calls", 0)], EDGE_SCHEMA))
    new = graph(spark.createDataFrame([("a", "A2", "2", "code"), ("c", "", "", "")], node), spark.createDataFrame([("a", "c", "calls", 0)], EDGE_SCHEMA))
    text = diff.summary(old, new)
    assert text == (
        "# Graph diff\n\n- 1 nodes added, 1 removed, 1 changed\n- 1 edges added, 1 removed\n\n## Nodes added\n- c (c)\n\n## Nodes removed\n- B (b)\n\n## Nodes changed\n"
        '- a: label "A"→"A2" community "1"→"2"\n\n## Edges added\n- a --calls--> c\n\n## Edges removed\n- a --calls--> b\n'
    )
    assert diff.summary(old, old).count("\n") == 4


def test_number_formats_and_seed(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert [one(fn.trim_float(F.lit(x))) for x in (10.0, 2.25, 2.75, -0.5, 1234567.0)] == ["10", "2.2", "2.8", "-0.5", "1234567"]
    assert [one(fn.commas(F.lit(x))) for x in (0, 999, 1000, -1234567)] == ["0", "999", "1,000", "-1,234,567"]
    assert [one(fn.truncate(F.lit("äöü"), n)) for n in (0, 2, 9)] == ["", "äö", "äöü"]
    assert one(fn.derive_seed(F.array(F.lit("b"), F.lit("a")))) == one(fn.derive_seed(F.array(F.lit("a"), F.lit("b"))))
    assert one(fn.derive_seed(F.array().cast("array<string>"))) == 0xCBF29CE484222325 - (1 << 64)
