import hashlib

from pyspark.sql import functions as F

from graphloom import pipeline
from graphloom.model import EDGE_SCHEMA, graph
from graphloom.operators.incremental import ContentState
from graphloom.operators.semantic import within_budget
from graphloom.plans.rank import rank_within, running_before

LIB = "package main\n\nfunc Hello() string { return \"hi\" }\n"
MAIN = "package main\n\nimport \"fmt\"\n\n// NOTE: prints\nfunc main() { fmt.Println(Hello()) }\n"


def ids(g):
    return {r.id for r in g.nodes.collect()}


def test_run_twice_gives_the_same(spark, tmp_path):
    (tmp_path / "lib.go").write_text(LIB)
    (tmp_path / "main.go").write_text(MAIN)
    (tmp_path / "doc.md").write_text("# Guide\n\nsee [x](http://a.b)\n")
    g = pipeline.run(spark, str(tmp_path))
    again = pipeline.run(spark, str(tmp_path))
    key = lambda x: (sorted(map(str, x.nodes.collect())), sorted(map(str, x.edges.collect())))
    assert key(g) == key(again)
    hello = f"go:function:{tmp_path}/lib.go:Hello"
    assert hello in ids(g) and g.edges.where((F.col("target") == hello) & (F.col("relation") == "calls") & (F.col("confidence") == 1)).count() == 1
    assert g.nodes.where("community = '' and sourcefile <> ''").count() == 0


def test_update_folds_changes(spark):
    files = lambda **x: spark.createDataFrame([(f"/{k}.py", v) for k, v in x.items()], "path string, text string")
    options = pipeline.Options(dedup=False, cluster=False)
    state = ContentState(spark)
    empty = pipeline.extract_all(files(a="")).with_()
    none = empty.with_(nodes=empty.nodes.limit(0), edges=empty.edges.limit(0))
    g, n = pipeline.update(none, files(a="def f():\n    g()\n", b="def g():\n    pass\n"), state, options)
    assert n == 2 and {"py:function:/a.py:f", "py:function:/b.py:g"} <= ids(g)
    same, n = pipeline.update(g, files(a="def f():\n    g()\n", b="def g():\n    pass\n"), state, options)
    assert n == 0 and same is g
    g, n = pipeline.update(g, files(a="def h():\n    pass\n"), state, options)
    assert n == 1 and "py:function:/a.py:h" in ids(g) and not {"py:function:/a.py:f", "py:function:/b.py:g"} & ids(g)


def test_update_sees_files_return(spark, monkeypatch):
    named = F.concat(F.lit("py:function:"), "path", F.lit(":"), F.substring("text", 5, 1))
    flat = lambda files, _: graph(files.select(named.alias("id"), F.lit("f").alias("label"), F.col("path").alias("sourcefile")), spark.createDataFrame([], EDGE_SCHEMA))
    monkeypatch.setattr(pipeline, "extract_all", flat)
    files = lambda t: spark.createDataFrame([("/a.py", t)] if t else [], "path string, text string")
    state, options = ContentState(spark), pipeline.Options(False, False, False)
    g = flat(files(None), True)
    x, y = sorted(("def f(): pass", "def g(): pass"), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    for text, n in ((y, 1), (x, 1), (x, 0), (y, 1), (None, 0), (y, 1)):
        g, got = pipeline.update(g, files(text), state, options)
        assert got == n and ids(g) == ({f"py:function:/a.py:{text[4]}"} if text else set())


def test_ingest_once(spark, tmp_path):
    calls = []

    def get(url):
        calls.append(url)
        return b"<meta property='og:title' content='T'><article><h1>A</h1><p>b</p></article>"

    path = pipeline.ingest(spark, "http://ex.am/p", str(tmp_path), get)
    assert pipeline.ingest(spark, "http://ex.am/p", str(tmp_path), get) == path and len(calls) == 1
    assert "> title: T" in open(path).read() and "# A\n\nb" in open(path).read()


def test_distributed_ranks(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", f"{i:03d}", i) for i in range(90)], "g string, o string, v bigint").repartition(6)
    want, seen = {}, {"a": 0, "b": 0}
    for i in range(90):
        g = "a" if i % 3 else "b"
        seen[g] += 1
        want[f"{i:03d}"] = seen[g]
    assert {r.o: r.n for r in rank_within(df, "g", "o").collect()} == want
    assert {r.o: r.s for r in running_before(df, "o", {"s": "v"}).collect()} == {f"{i:03d}": i * (i - 1) // 2 for i in range(90)}
    assert rank_within(df.limit(0), "g", "o").count() == 0
    jobs = spark.createDataFrame([(i, 1.0, 1, 1) for i in range(50)], "seq int, usd double, input_tokens bigint, output_tokens bigint")
    assert within_budget(jobs, "seq", max_usd=10.0).count() == 10 and within_budget(jobs, "seq").count() == 50
