import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from graphloom.model import EDGE_SCHEMA, HYPEREDGE_SCHEMA, graph
from graphloom.operators import files, semantic
from graphloom.operators.incremental import ContentState
from graphloom.sinks import graph_formats, pages
from graphloom.sinks.report import report
from graphloom.sources import code, discovery, graphjson, markup, web
from graphloom.streaming.watch import debounced, event_rates, process_changed


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_classify_and_sensitive(spark):
    got = lambda f, xs: [one(spark, f(F.lit(x))) for x in xs]
    assert got(discovery.classify, ["a/B.PY", "x.md", "x.pdf", "x.PNG", "x.mp3", "Makefile", "x.htm"]) == ["code", "document", "paper", "image", "video", "", ""]
    yes = [".env", "a/.env.prod", "k.pem", "x/token-a.json", "passwords.txt", "id_rsa", "a/.aws/config", "s.tfstate", "my-api_key.txt"]
    no = ["token_handler.go", "environment.py", "étoken.md", "config", "monkey.go"]
    assert got(discovery.is_sensitive, yes) == [True] * len(yes)
    assert got(discovery.is_sensitive, no) == [False, False, True, False, False]


def test_minified(spark):
    f = lambda p, t: one(spark, discovery.is_minified(F.lit(p), F.encode(F.lit(t), "utf-8")))
    assert f("a.MIN.js", "x") and f("a.js", "y" * 5001) and not f("a.js", "y" * 5000) and not f("a.js", ("y" * 99 + "\n") * 900 + "z" * 9000)


@pytest.mark.parametrize(
    "lines, path, want",
    [
        (["*.log"], "a/b.log", True), (["/b.log"], "a/b.log", False), (["a/**/c"], "a/x/y/c", True), (["build/"], "build/x.go", True), (["build/"], "src/build/x.go", True),
        (["*.go", "!keep.go"], "keep.go", False), (["# c", "", "x?z"], "xyz", True), (["a[0-9].t"], "a5.t", True), (["doc/*.md"], "doc/x/y.md", False), (["\\#x"], "#x", True),
    ],
)
def test_ignore_rules(lines, path, want):
    assert discovery.IgnoreRules(lines).ignored(path) is want


def test_listing_and_reading(spark, tmp_path):
    for name, text in {"a.go": "x", "skip.go": "x", "sub/b.go": "y", ".hidden/c.go": "z", "sub/.env": "k", "big.go": "0" * (discovery.SIZE_CAP + 1), "t.md": "# T"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (tmp_path / ".graphignore").write_text("skip*\n")
    os.symlink(tmp_path / "sub", tmp_path / "link")
    os.symlink(tmp_path, tmp_path / "sub" / "loop")
    os.symlink("/etc", tmp_path / "outside")
    rel = [os.path.relpath(p, tmp_path) for p in discovery.list_files(str(tmp_path), {".go"})]
    assert rel == ["a.go", "link/b.go", "sub/b.go"]
    assert {os.path.basename(r.path): bytes(r.content) for r in discovery.scan_tree(spark, str(tmp_path), {".go", ".md"}).collect()}["t.md"] == b"# T"


def test_head_commit(tmp_path):
    git = tmp_path / ".git"
    (git / "refs/heads").mkdir(parents=True)
    (git / "HEAD").write_text("ref: refs/heads/main\n")
    assert discovery.head_commit(str(tmp_path)) == ""
    (git / "packed-refs").write_text("abcdef0123456 refs/heads/main\n")
    assert discovery.head_commit(str(tmp_path)) == "abcdef0"
    (git / "refs/heads/main").write_text("1234567890\n")
    assert discovery.head_commit(str(tmp_path)) == "1234567"


CASES = {
    "a.go": ('package app\nimport "fmt"\ntype T struct{}\nfunc (t *T) Run() { fmt.Println(help()) }\nfunc help() int { return 1 }\n', {"type:T", "method:T.Run", "function:help"}, {"fmt"}, {("T.Run", "help")}),
    "a.py": ("import os\nfrom a import b\nclass A(B):\n    def m(self):\n        return run(1)\n", {"class:A", "function:m"}, {"os", "a", "a.b"}, {("m", "run")}),
    "a.js": ("import x from './y';\nclass A extends B { go(a) { return call(a); } }\nfunction f() { g(); }\nconst h = (a) => k(a);\n", {"class:A", "method:go", "function:f", "function:h"}, {"./y"}, {("go", "call"), ("f", "g")}),
    "a.ts": ("import { x } from 'lib';\nexport interface I { a: number }\nexport class C implements I { run(): void { go(); } }\ntype Z = string;\n", {"interface:I", "class:C", "method:run", "type:Z"}, {"lib"}, {("run", "go")}),
    "A.java": ("import java.util.List;\npublic class A extends B implements C, D {\n  public int run(int x) { return help(x); }\n}\n", {"class:A", "method:run"}, {"java.util.List"}, {("run", "help")}),
    "a.c": ('#include <stdio.h>\nstruct s { int a; };\nint run(int x) {\n  return help(x);\n}\n', {"struct:s", "function:run"}, {"stdio.h"}, set()),
    "a.cpp": ('#include "x.h"\nnamespace n {\nclass A : public B {\n};\nint f(int x) { return g(x); }\n}\n', {"namespace:n", "class:A", "function:f"}, {"x.h"}, set()),
    "a.cs": ("using System.IO;\npublic class A : B {\n  public A() { }\n  public int Run(int x) { return Help(x); }\n}\n", {"class:A", "constructor:A", "method:Run"}, {"System.IO"}, {("Run", "Help")}),
    "a.rs": ("use a::{b, c};\nstruct S;\ntrait T {}\nimpl T for S {}\nfn run() { help(); println!(\"x\"); }\n", {"struct:S", "trait:T", "function:run"}, {"a::b", "a::c"}, {("run", "help"), ("run", "println")}),
    "a.rb": ("require 'set'\nclass A < B\n  def run\n    help(1)\n  end\nend\n", {"class:A", "method:run"}, {"set"}, {("run", "help")}),
    "a.kt": ("import a.b.C\nclass A : B() {\n  fun run() { help() }\n}\nobject O\n", {"class:A", "function:run", "object:O"}, {"a.b.C"}, {("run", "help")}),
    "a.scala": ("import a.{B, C => D}\ntrait T\nobject O extends T {\n  def run(x: Int) = { help(x) }\n}\n", {"trait:T", "object:O", "function:run"}, {"a.B", "a.C"}, {("run", "help")}),
    "a.php": ("<?php\nuse A\\B;\nclass C extends D { function run() { $this->help(); go(); } }\nfunction f() { g(); }\n", {"class:C", "method:run", "function:f"}, {"A\\B"}, {("run", "help"), ("f", "g")}),
    "a.lua": ("local m = require('mod')\nfunction run(a)\n  help(a)\nend\n", {"function:run"}, {"mod"}, {("run", "help")}),
    "a.zig": ('const std = @import("std");\nconst S = struct { x: u8 };\nfn run() void { help(); }\n', {"struct:S", "function:run"}, {"std"}, {("run", "help")}),
    "a.jl": ("module M\nusing A, B\nstruct S\nend\nfunction run(x)\n  help(x)\nend\nend\n", {"module:M", "struct:S", "function:run"}, {"A", "B"}, {("run", "help")}),
    "a.sh": (". ./lib.sh\nrun() {\n  help\n}\n", {"function:run"}, {"./lib.sh"}, set()),
    "a.hs": ("module M where\nimport Data.List\nrun :: Int -> Int\nrun x = help x\n", {"function:run"}, {"Data.List"}, {("run", "help")}),
    "a.ml": ("open List\nlet run x =\n  help x\n", {"function:run"}, {"List"}, {("run", "help")}),
    "a.svelte": ("<script>import A from './A.svelte';</script>", set(), {"./A.svelte"}, set()),
    "a.f90": ("module m\nuse iso\ncontains\nsubroutine run(x)\n  call help(x)\nend subroutine\nend module\n", {"subroutine:run"}, {"iso"}, {("run", "help")}),
    "a.ex": ("defmodule M do\n  alias A.B\n  def run(x) do\n    help(x)\n  end\nend\n", {"function:run"}, {"A.B"}, {("run", "help")}),
    "a.dart": ("import 'dart:io';\nclass A extends B implements C {\n  int run(int x) { return help(x); }\n}\nenum E { a }\n", {"class:A", "method:run", "enum:E"}, {"dart:io"}, set()),
    "a.swift": ("import UIKit\nprotocol P {}\nclass A: P {\n  func run() { help() }\n}\n", {"protocol:P", "class:A", "function:run"}, {"UIKit"}, {("run", "help")}),
    "a.r": ("library(stats)\nrun <- function(x) {\n  help(x)\n}\n", {"function:run"}, {"stats"}, {("run", "help")}),
    "a.erl": ("-module(m).\n-import(lists, [map/2]).\nrun(X) ->\n  help(X).\n", {"function:run"}, {"lists"}, {("run", "help")}),
    "a.yaml": ("a: 1\nb:\n  c: 2\n# d: 3\n", {"key:a", "key:b"}, set(), set()),
    "a.toml": ("x = 1\n[t]\ny = 2\n[[u]]\n", {"key:x", "key:t", "key:u"}, set(), set()),
}


@pytest.mark.parametrize("path", CASES)
def test_languages(path):
    text, decls, imports, calls = CASES[path]
    x = code.extract_text(path, text)
    found = {f"{i.split(':')[1]}:{i.split(':', 2)[2].removeprefix(path + ':')}" for i, n in x.nodes.items() if n[2] and not i.endswith(":module:" + path)}
    assert decls <= found, found
    assert {i.split(":", 2)[2] for i in x.nodes if ":import:" in i} == imports
    seen = {(a.rsplit(":", 1)[1], b.split(":", 2)[2]) for a, b, r in x.edges if r == "calls"}
    assert calls <= seen, seen


def test_bases_and_strings_and_comments():
    x = code.extract_text("A.java", CASES["A.java"][0])
    assert {(b.split(":")[2], r) for a, b, r in x.edges if r in ("inherits", "implements")} == {("B", "inherits"), ("C", "implements"), ("D", "implements")}
    x = code.extract_text("a.js", "// function no() {}\nconst s = 'function nor() {}';\n/* call(1) */ function yes() { real(); }\n")
    assert {i.split(":")[-1] for i in x.nodes if ":function:" in i or ":call:" in i} == {"yes", "real"}
    assert code.extract_text("x.py", "def broken(:\n").nodes.keys() == {"py:module:x.py"} and code.extract_text("x.bin", "") is None


def test_extract_graph_shares_symbols(spark):
    df = spark.createDataFrame([("a.py", "import os\ndef f():\n    g()\n"), ("b.py", "import os\n"), ("c.py", None), ("d.txt", "x"), (None, "x")], "path string, text string")
    g = code.extract(df)
    ids = {r.id for r in g.nodes.collect()}
    assert {"py:module:a.py", "py:module:b.py", "py:import:os", "py:call:g", "py:function:a.py:f"} == ids and g.edges.where("relation = 'imports'").count() == 2


def test_markdown_html_rst_text():
    d = markup.markdown("x.md", "# Top\n\nsee [a](http://a.b) and `[no](x)`\n\n## Part *two*\n\n```\n# not one\n[n](o)\n```\n<http://c.d>\n#### deep\n")
    sections = [i for i in d.nodes if ":section:" in i]
    assert sections == ["markdown:section:x.md:n1:top", "markdown:section:x.md:n2:part-two"] and d.nodes[d.module][1:3] == ("Top", "")
    assert {(a, b) for a, b, r in d.edges if r == "references"} == {(sections[0], "markdown:link:http://a.b"), (sections[1], "markdown:link:http://c.d")}
    d = markup.html_page("x.html", "<title> T t</title><h1>One</h1><p><a href='#x'>n</a><a href='http://a'>y</a></p><h3>Three</h3>")
    assert d.nodes[d.module][1] == "T t" and sum(":section:" in i for i in d.nodes) == 2 and ("html:section:x.html:n1:one", "html:link:http://a", "references") in d.edges
    d = markup.rst("x.rst", "Title\n=====\n\ntext `a <http://a.b>`_ http://c.d.\n\nSub\n---\n")
    assert d.nodes[d.module][1] == "Title" and {b for a, b, r in d.edges if r == "references"} == {"rst:link:http://a.b", "rst:link:http://c.d"}
    assert {b for a, b, r in markup.plain("x.txt", "go to https://a.b/c), or http://d!").edges} == {"text:link:https://a.b/c", "text:link:http://d"}
    assert markup.shortcut("x.gdoc", '{"doc_id": "7"}').external.endswith("open?id=7") and markup.shortcut("x.gdoc", "no") is None


def archive(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return b.getvalue()


W = 'xmlns:w="w" xmlns:r="r"'


def test_office_and_pdf(spark):
    rel = '<Relationships><Relationship Id="i1" Target="http://a.b"/></Relationships>'
    doc = archive({"word/document.xml": f'<w:document {W}><w:p><w:pPr><w:pStyle w:val="Title"/></w:pPr><w:r><w:t>T</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>H</w:t></w:r><w:hyperlink r:id="i1"/></w:p></w:document>', "word/_rels/document.xml.rels": rel})
    d = markup.docx("x.docx", doc)
    assert d.nodes[d.module][1] == "T" and ("docx:section:x.docx:n1:h", "docx:link:http://a.b", "references") in d.edges
    book = archive({"xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="s1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="s1" Target="worksheets/s.xml"/></Relationships>', "xl/worksheets/s.xml": '<worksheet xmlns:r="r"><tableParts><tablePart r:id="t1"/></tableParts></worksheet>', "xl/worksheets/_rels/s.xml.rels": '<Relationships><Relationship Id="t1" Target="../tables/t.xml"/></Relationships>', "xl/tables/t.xml": '<table displayName="Tab"><tableColumns><tableColumn name="C"/></tableColumns></table>'})
    assert {i.split(":")[1] for i in markup.xlsx("x.xlsx", book).nodes} == {"module", "section", "table", "column"}
    deck = archive({"ppt/slides/slide1.xml": '<p xmlns:a="a"><sp><nvPr><ph type="title"/></nvPr><a:t>Hello</a:t></sp></p>', "ppt/slides/slide2.xml": "<p/>"})
    assert [n[1] for i, n in markup.pptx("x.pptx", deck).nodes.items() if ":section:" in i] == ["Hello", "Slide 2"]
    d = markup.pdf("x.pdf", b"%PDF /Title (My \\(one\\)) stream\n(see http://a.b now) Tj\nendstream")
    assert d.nodes[d.module][1] == "My (one)" and ("pdf:module:x.pdf", "pdf:link:http://a.b", "references") in d.edges
    rows = markup.extract_binaries(spark.createDataFrame([("x.docx", doc), ("bad.docx", b"no"), ("n.pdf", None)], "path string, content binary"))
    assert {r.id for r in rows.where("what = 'node'").collect()} == {"docx:module:x.docx", "docx:section:x.docx:n1:h"}


def test_rationale():
    x = markup.rationale_of("a.go", "// NOTE: why\n// more\n\nfunc (t *T) Run() {}\n/* TODO later */\nvar a = 1\n")
    assert {n[1] for n in x.nodes.values()} == {"NOTE: why", "TODO later"}
    assert set(x.edges) == {("go:rationale:a.go:L1", "go:function:a.go:Run", "rationale_for"), ("go:rationale:a.go:L5", "go:module:a.go", "rationale_for")}
    assert markup.rationale_of("a.md", "plain NOTE: x").nodes == {}


def test_web(spark):
    page = "<nav>n</nav><article>short</article><article><h2>A <b>b</b></h2><p>x &amp;lt; y<br>z</p><script>s</script><ul><li>i</li></ul></article>"
    assert one(spark, web.html_to_markdown(F.lit(page))) == "## A b\n\nx < y\nz\n\n- i"
    tags = one(spark, web.og_tags(F.lit('<meta content="C" property="og:title"><meta name="twitter:title" content="X"><meta property="og:description" content="a\nb">')))
    assert (tags.title, tags.description, tags.image) == ("C", "a b", "")
    route = lambda u: one(spark, web.route(F.lit(u)))
    assert [route(u) for u in ("https://github.com/a/b", "https://arxiv.org/abs/1", "https://youtu.be/x", "http://a/x.PDF", "http://a/x.png?s=1", "http://a")] == ["github", "arxiv", "youtube", "pdf", "image", "page"]
    name = one(spark, web.side_file(F.lit("https://ex.am/ple/Page_1/")))
    assert name.startswith("ex-am-Page_1-") and len(name) == len("ex-am-Page_1-") + 16 + 3
    for bad in ("ftp://a/b", "http://127.0.0.1/x", "http://localhost/"):
        with pytest.raises(ValueError):
            web.fetch(bad)


def small(spark):
    n = [("a:function:1", "A'x", "s/f.go", "c1", "code"), ("a:function:2", "<B>", "s/g.go", "c1", "code"), ("a:class:3", "C", "t/h.md", "c2", "document")]
    e = [("a:function:1", "a:function:2", "calls", 0), ("a:function:2", "a:class:3", "is a", 2)]
    return graph(spark.createDataFrame(n, "id string, label string, sourcefile string, community string, filetype string"), spark.createDataFrame(e, EDGE_SCHEMA), spark.createDataFrame([(["a:function:1", "a:function:2", "a:class:3"], "r", 1)], HYPEREDGE_SCHEMA), "abc1234")


def test_json_round_trip(spark, tmp_path):
    g, path = small(spark), str(tmp_path / "g.json")
    graph_formats.write_json(g, path)
    again = graphjson.load_graph(spark, path)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(again.nodes) == key(g.nodes) and key(again.edges) == key(g.edges) and key(again.hyperedges) == key(g.hyperedges) and again.commit == "abc1234"
    first = open(path, encoding="utf-8").read()
    graph_formats.write_json(g, path)
    assert open(path, encoding="utf-8").read() == first and json.loads(first)["edges"][0]["confidence_score"] == 1.0 and graphjson.version(spark, path) == "v2"
    for bad in ("", "x.txt", "a\0.json"):
        with pytest.raises(ValueError):
            graphjson.check_path(bad)


def test_text_formats(spark, tmp_path):
    from xml.etree import ElementTree

    g = small(spark)
    xml = "\n".join(r.line for r in graph_formats.graphml_lines(g).orderBy("part", "k").collect())
    assert len(ElementTree.fromstring(xml)[-1]) == 5
    cypher = [r.line for r in graph_formats.cypher_lines(g).orderBy("part", "k").collect()]
    assert "A\\'x" in cypher[1] and "[r:IS_A]" in cypher[-1]
    graph_formats.write_lines(graph_formats.cypher_lines(g), str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c")).count() == 5
    out = str(tmp_path / "sent")

    def connect():
        def send(statement, rows):
            with open(out, "a") as f:
                f.write("".join(json.dumps(r) + "\n" for r in rows))

        return send

    graph_formats.push(g, connect, batch=1)
    assert len(open(out).read().splitlines()) == 5


def test_pages(spark, tmp_path):
    g = small(spark)
    assert "# Graph report" in report(g) and "abc1234" in report(g)
    d = str(tmp_path / "wiki")
    assert pages.write_pages(pages.wiki(g), d) == pages.wiki(g).count() and os.path.exists(d + "/index.md")
    pages.write_pages(pages.vault(g), d)
    os.makedirs(tmp_path / "mine")
    (tmp_path / "mine" / "x").write_text("")
    with pytest.raises(FileExistsError):
        pages.write_pages(pages.vault(g), str(tmp_path / "mine"))
    body, index = pages.site(g)
    assert body.count() >= 3 and index.where("token = 'index'").count() == 1
    assert "2 files" in pages.tree_page(g) and "flowchart" in pages.callflow_page(g) and "const G=" in pages.viewer_page(g)
    assert pages.drawing(g).count("<circle") == 3 and len(json.loads(pages.canvas(g))["nodes"]) == 2
    assert pages.mermaid_id("ab_1") == "ab_1" and pages.mermaid_id("a b") != pages.mermaid_id("a-b")
    assert [r.slug for r in pages.unique_slugs(spark.createDataFrame([("1", "A b"), ("2", "a-B"), ("3", "")], "id string, l string"), "l", "id").orderBy("id").collect()] == ["a-b", "a-b_2", "page"]


def test_files(spark):
    cur = spark.createDataFrame([("same_time", 5, "zz"), ("same_hash", 6, "AB"), ("both", 7, "cd"), ("new", 1, "x"), ("unknown", 0, "ab")], "path string, mtime bigint, sha256 string")
    cache = spark.createDataFrame([("same_time", 5, "ab"), ("same_hash", 1, "ab"), ("both", 1, "ab"), ("gone", 1, "ab"), ("unknown", 0, "cd")], "path string, mtime bigint, hash string")
    assert {r.path for r in files.changed_files(cur, cache).collect()} == {"both", "new", "unknown"}
    saved = {r.path: r.hash for r in files.save_cache(cache, cur.withColumnRenamed("sha256", "hash")).collect()}
    assert saved["gone"] == "ab" and saved["both"] == "cd" and len(saved) == 6
    prior = spark.createDataFrame([("a.go", 1, 10, "old"), ("b.go", 1, 10, "old")], "path string, mtime bigint, size bigint, sha256 string")
    listing = spark.createDataFrame([("a.go", 1, 10), ("b.go", 2, 10)], "path string, mtime bigint, size bigint")
    assert sorted((r.path, r.sha256, r.ext) for r in files.build_manifest(listing, prior, F.lit("fresh")).collect()) == [("a.go", "old", ".go"), ("b.go", "fresh", ".go")]


def test_semantic(spark):
    reply = 'Sure: {"entities": [{"id": "a", "label": "A"}, {"id": "", "label": "x"}, {"id": "b", "label": "B"}], "relations": [{"source": "a", "target": "b"}, {"source": "a"}], "hyperedges": [{"members": ["a", "b", "c"]}, {"members": ["a", "", "b"]}]} ok'
    g = semantic.parse_replies(spark.createDataFrame([("p.md", reply), ("q.md", "no json"), ("r.md", "{broken}"), (None, reply)], "path string, reply string"))
    assert {r.id for r in g.nodes.where("sourcefile = 'p.md'").collect()} == {"doc:module:p.md", "doc:entity:p.md:a", "doc:entity:p.md:b"}
    assert {(r.relation, r.confidence) for r in g.edges.collect()} == {("mentions", 1), ("relates_to", 1)} and g.hyperedges.count() == 1
    jobs = spark.createDataFrame([("k1", "a", "p1"), ("k2", "b", "boom"), ("k3", "c", "p3")], "key string, path string, prompt string")

    def client(prompt):
        if prompt == "boom":
            raise RuntimeError("down")
        return semantic.Reply("re " + prompt)

    cache = spark.createDataFrame([("k3", "cached")], "key string, reply string")
    replies, fresh = semantic.extract_cached(jobs, cache, client)
    assert {(r.path, r.reply) for r in replies.collect()} == {("a", "re p1"), ("c", "cached")} and {r.key for r in fresh.collect()} == {"k1"}
    est = semantic.estimates(spark.createDataFrame([(1, 3000), (2, 30), (3, 30)], "seq int, size bigint"), F.col("size"), 1.0, 1.0)
    assert [(r.input_tokens, r.output_tokens) for r in est.orderBy("seq").collect()] == [(1000, 125), (10, 64), (10, 64)]
    assert semantic.within_budget(est, "seq", max_tokens=1000).count() == 1 and semantic.within_budget(est, "seq", max_tokens=1126).count() == 2
    assert semantic.preflight(est).first().jobs == 3 and semantic.hub_prompt([" a ", "", "b"]) == "a, b"
    k = lambda t, m="text": one(spark, semantic.prompt_key(F.lit(t), "m", "p", m))
    assert k("---\na: 1\n---\nbody") == k("body") and k("---\na: 1\n---\nbody", "raw") != k("body", "raw")


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.createDataFrame([("a", 1.0, 0), ("a", 2.0, 1), ("a", 3.0, 50), ("b", 4.0, 2)], "kind string, value double, s int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    rows.write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    for name, df in (("bursts", debounced(stream, "ts", "kind", "10 seconds")), ("rates", event_rates(stream, "ts", "kind", "1 minute"))):
        q = df.writeStream.outputMode("complete").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert {(r.key, r.n) for r in spark.table("bursts").collect()} == {("a", 2), ("a", 1), ("b", 1)}
    assert {(r.kind, r.n, r.total) for r in spark.table("rates").collect()} == {("a", 3, 6.0), ("b", 1, 4.0)}
    batch = {(r.key, r.n) for r in debounced(rows, "ts", "kind", "10 seconds").collect()}
    assert batch == {("a", 2), ("a", 1), ("b", 1)}


def test_newest_version_of_a_batch_counts(spark, tmp_path):
    src, seen, state = str(tmp_path / "in"), [], ContentState(spark)

    def drain(rows, order="at"):
        spark.createDataFrame(rows, "key string, hash string, at bigint").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("key string, hash string, at bigint").parquet(src)
        process_changed(stream, state, lambda df: seen.append(sorted(map(tuple, df.collect()))), str(tmp_path / "ck"), order=order).awaitTermination(120)

    drain([("a", "9", 1), ("a", "1", 2)])
    drain([("a", "1", 5), ("a", "7", 1)])
    drain([("a", "8", 4), ("b", "1", 1)])
    drain([("a", "0", 6)])
    assert seen == [[("a", "1")], [("b", "1")], [("a", "0")]]
    with pytest.raises(Exception, match="several versions"):
        drain([("c", "1", 1), ("c", "2", 2)], order=None)


def test_stream_of_changes(spark, tmp_path):
    src, seen, state = str(tmp_path / "in"), [], ContentState(spark)
    put = lambda rows: spark.createDataFrame(rows, "key string, hash string").write.mode("append").parquet(src)
    put([("a", "1"), ("b", "1")])

    def drain():
        stream = spark.readStream.schema("key string, hash string").parquet(src)
        q = process_changed(stream, state, lambda df: seen.append(sorted(r.key for r in df.collect())), str(tmp_path / "ck"))
        q.awaitTermination(120)

    drain()
    put([("a", "1"), ("b", "2"), ("c", "1")])
    drain()
    assert seen == [["a", "b"], ["b", "c"]]


def test_go_members():
    text = "package p\n\ntype Base struct{}\n\ntype T struct {\n\tBase\n\t*io.Reader\n\tx, y int // place\n\tm map[string]func(a int) error\n\tin struct {\n\t\tdeep int\n\t}\n}\n\ntype I interface {\n\tfmt.Stringer\n\tRun(a int) error\n}\n"
    x = code.scan("a.go", text, code.BY_EXTENSION[".go"])
    members = {i for i in x.nodes if i.split(":")[1] in ("field", "method")}
    assert members == {"go:field:a.go:T.x", "go:field:a.go:T.y", "go:field:a.go:T.m", "go:field:a.go:T.in", "go:method:a.go:I.Run"}
    assert ("go:type:a.go:T", "go:field:a.go:T.x", "contains") in x.edges
    assert {e for e in x.edges if e[2] == "embeds"} == {("go:type:a.go:T", "go:typeref:Base", "embeds"), ("go:type:a.go:T", "go:typeref:Reader", "embeds"), ("go:type:a.go:I", "go:typeref:Stringer", "embeds")}


def test_rationale_locations_and_functions():
    x = markup.rationale_of("a.py", "# TODO: x\n@deco\nasync def run():\n    pass\n# NOTE y\nz = 1\n")
    assert {(n[3], n[4]) for n in x.nodes.values()} == {("L1", "rationale"), ("L5", "rationale")}
    assert set(x.edges) == {("py:rationale:a.py:L1", "py:function:a.py:run", "rationale_for"), ("py:rationale:a.py:L5", "py:module:a.py", "rationale_for")}
    assert {e[1] for e in markup.rationale_of("a.ts", "// HACK: q\nexport const go = async (x) => x\n").edges} == {"ts:function:a.ts:go"}


def test_pages_without_regions_and_broken_ones():
    assert web.page_markdown(None) == "" and web.page_markdown("") == ""
    assert web.page_markdown("<main><p>one</p></main><p>two") == "one"
    assert web.page_markdown("<div>a<script>x<p>y</script>b</div>") == "ab"
    assert web.page_markdown("<h1>T</h1><p>a&nbsp;b</p>\n\n\n<p>c &#39;d&#39;") == "# T\n\na b\n\nc 'd'"
    assert web.page_tags("<meta property='og:title' content=''><meta name='twitter:title' content='X'><meta name='og:site_name' content='S'>") == {"title": "X", "description": "", "image": "", "site_name": "S"}
