import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.operators.eager_agg import crowded_endpoints, eager_join_aggregate, endpoint_counts, key_profile
from graphloom.operators.incremental import ConcurrentCommit, ContentState, content_hash, newest, pending_paths
from graphloom.operators.references import ForeignKey, Table, graph_orphans, orphan_cascade, orphan_references, project_keys
from graphloom.plans.rank import numbered
from graphloom.plans.skew import heavy_keys, salted_join

T = lambda n: dt.datetime(2025, 1, 1) + dt.timedelta(hours=n)
EDGES = "edge_id bigint, source string, target string, relation string, confidence int, built_at timestamp_ntz, _k string, key string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_eager_join_equals_plain_join(spark):
    r = random.Random(2)
    left = [(r.choice(["a", "a", "a", "b", None, ""]), r.choice("xy"), r.randrange(5)) for _ in range(80)]
    right = [(r.choice(["a", "a", "c", None, ""]), r.choice("uv"), r.randrange(5)) for _ in range(60)]
    ld, rd = spark.createDataFrame(left, "k string, g string, x bigint"), spark.createDataFrame(right, "k string, h string, y bigint")
    got = {(a.l_g, a.r_h): (int(a.pairs), a.l_x, a.r_y) for a in eager_join_aggregate(ld, rd, "k", "k", ["g"], ["h"], ["x"], ["y"]).collect()}
    want = {}
    for k, g, x in left:
        for k2, h, y in right:
            if k is not None and k == k2:
                n, sx, sy = want.get((g, h), (0, 0, 0))
                want[g, h] = (n + 1, sx + x, sy + y)
    assert got == want


def test_crowded_endpoints_and_counts(spark):
    data = [(i, "hub" if i < 40 else f"s{i}", "t" if i % 2 else None, "calls", 0, T(0), "k", "x") for i in range(95)] + [(99, "", "", None, 0, T(0), None, None)] * 5
    e = spark.createDataFrame(data, EDGES)
    assert rows(crowded_endpoints(e, 0.4)) == [("source", "hub"), ("target", "t")]
    assert rows(crowded_endpoints(e, 0.41)) == [("target", "t")]
    got = {(r.node_id, r.relation): (r.out_n, r.in_n) for r in endpoint_counts(e).collect()}
    assert got["hub", "calls"] == (40, 0) and got["t", "calls"] == (0, 47) and len(got) == 57
    assert rows(crowded_endpoints(spark.createDataFrame([], EDGES))) == []
    assert key_profile(e, e, "target", "source").agg(F.sum("left_n")).first()[0] == 47


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_join(spark, how):
    r = random.Random(1)
    big = spark.createDataFrame([(r.choice(["h"] * 6 + ["a", "b", None]), i) for i in range(300)], "k string, i bigint")
    small = spark.createDataFrame([("h", 1), ("h", 2), ("b", 3), (None, 4), ("z", 5)], "k string, v bigint")
    heavy = heavy_keys(big, "k", 0.3)
    assert heavy == ["h"]
    key = lambda df: Counter(tuple(x) for x in df.select(sorted(df.columns)).collect())
    assert key(salted_join(big, small, "k", heavy, F.col("i"), how, 8)) == key(big.join(small, "k", how))


def test_numbered(spark):
    df = spark.createDataFrame([(f"k{i:03d}",) for i in random.Random(3).sample(range(200), 200)], "k string").repartition(5)
    assert [(r.k, r.n) for r in numbered(df, "k").orderBy("k").collect()] == [(f"k{i:03d}", i) for i in range(200)]


def test_pending_paths(spark):
    scans = [
        ("same", T(1), "AB"), ("same", T(0), "zz"), ("changed", T(2), "cd"), ("new", T(1), "ef"), ("unread", T(1), None), ("lost", T(3), None), ("lost", T(1), "aa"),
        ("failed", T(1), "11"), ("older", T(1), "22"), (None, T(1), "99"), ("same", T(1), "AB"),
    ]
    cache = [("same", "ab", 1), ("changed", "ce", 1), ("lost", "aa", 2), ("failed", "11", 3), ("older", "22", 1), ("older", "23", 2), ("gone", "xx", 1), ("same", "ab", 1)]
    runs = [(1, "ok"), (2, "ok"), (3, "failed"), (1, "ok")]
    m = spark.createDataFrame(scans, "path string, scanned_at timestamp_ntz, sha256 string")
    c = spark.createDataFrame(cache, "path string, hash string, run_id int")
    g = spark.createDataFrame(runs, "run_id int, status string")
    assert rows(pending_paths(m, c, g)) == [("changed", "cd", "changed"), ("failed", "11", "new"), ("new", "ef", "new"), ("older", "22", "changed")]
    assert pending_paths(m.limit(0), c, g).count() == 0
    assert pending_paths(m, c.limit(0), g).count() == 6


def test_state_survives_a_crash_between_write_and_swap(spark, monkeypatch):
    state = ContentState(spark)
    assert state.version() is None and state.load().count() == 0
    first = spark.createDataFrame([("a", "1", 0), ("b", "1", 0)], "key string, hash string, seen bigint")
    state.commit(first)
    second = spark.createDataFrame([("a", "2", 1), ("c", "1", 1)], "key string, hash string, seen bigint")
    monkeypatch.setattr(state, "_swap", lambda name: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        state.commit(second)
    monkeypatch.undo()
    assert rows(state.load()) == [("a", "1", 0), ("b", "1", 0)]
    assert rows(state.changed(second.select("key", "hash"))) == [("a", "2", "changed"), ("c", "1", "new")]
    state.commit(second)
    assert state.changed(second.select("key", "hash")).count() == 0
    assert rows(state.load()) == [("a", "2", 1), ("b", "1", 0), ("c", "1", 1)]


STATE = "key string, hash string, seen bigint"


def test_state_keeps_versions_apart_and_folds_them(spark):
    state = ContentState(spark)
    one = lambda key, hash_, seen: spark.createDataFrame([(key, hash_, seen)], STATE)
    assert state.commit(one("a", "1", 0)) == 1
    assert state.commit(one("a", "1", 0)) == 1, "nothing new, no version"
    for i in range(1, 20):
        assert state.commit(one("a" if i % 2 else "b", str(100 - i), i)) == i + 1
    assert rows(state.load()) == [("a", "81", 19), ("b", "82", 18)]
    kept = sorted(x.getPath().getName() for x in state._fs.listStatus(state._path(f"{state.root}/versions")))
    assert kept == [f"{v:012d}" for v in (19, 20)] and len(state._parts(20)) <= 8
    state.commit(spark.createDataFrame([], STATE), gone=spark.createDataFrame([("a",)], "key string"))
    assert rows(state.load()) == [("b", "82", 18)]
    state.commit(one("a", "1", 1))
    assert rows(state.load()) == [("a", "1", 1), ("b", "82", 18)], "a key that went may return"
    state.commit(one("c", "1", 0), merge=False)
    assert rows(state.load()) == [("c", "1", 0)]


def test_two_writers_lose_no_commit(spark):
    first, second = ContentState(spark), None
    second = ContentState(spark, first.root)
    first.commit(spark.createDataFrame([("a", "1", 0)], STATE))
    base = second.version()
    first.commit(spark.createDataFrame([("b", "1", 0)], STATE))
    with pytest.raises(ConcurrentCommit):
        second.commit(spark.createDataFrame([("c", "1", 0)], STATE), expected=base)
    stale = iter([base])
    real = second.version
    second.version = lambda: next(stale, None) or real()
    second.commit(spark.createDataFrame([("c", "1", 0)], STATE))
    assert rows(first.load()) == [("a", "1", 0), ("b", "1", 0), ("c", "1", 0)]


def test_a_kept_state_is_only_brought_up_to_date(spark):
    m = spark.createDataFrame([("x", T(0), "aa"), ("y", T(0), "bb")], "path string, scanned_at timestamp_ntz, sha256 string")
    cache = [("x", "aa", 1), ("y", "b0", 1), ("y", "bb", 2)]
    c = lambda n: spark.createDataFrame(cache[:n], "path string, hash string, run_id int")
    runs = lambda second: spark.createDataFrame([(1, "ok"), (2, second)], "run_id int, status string")
    state = ContentState(spark)
    assert rows(pending_paths(m, c(2), runs("failed"), state)) == [("y", "bb", "changed")] and state.version() == 1
    assert rows(pending_paths(m, c(3), runs("failed"), state)) == [("y", "bb", "changed")] and state.version() == 1
    assert rows(pending_paths(m, c(3), runs("ok"), state)) == [] and state.version() == 2


def test_content_hash_keeps_columns_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "c"), ("", "c")], "x string, y string").select(content_hash("x", "y").alias("h"))
    assert df.distinct().count() == 4


def test_newest_breaks_ties_by_value(spark):
    df = spark.createDataFrame([("p", 1, "B"), ("p", 1, "a"), ("p", 0, "z")], "path string, at int, v string")
    assert rows(newest(df, "path", "at", "v")) == [("p", "b")]


def test_orphans_in_time(spark):
    nodes = [("go:function:a", T(0), None, "x"), ("go:function:b", T(5), T(8), "x"), ("go:function:b", T(10), None, "x"), ("go:function:b", T(10), None, "x"), (None, T(0), None, "x")]
    edges = [
        (1, "go:function:a", "go:function:b", "r", 0, T(6), "", ""), (2, "go:function:a", "go:function:b", "r", 0, T(8), "", ""), (3, "go:function:b", "md:link:x", "r", 0, T(11), "", ""),
        (4, "", None, "r", 0, T(1), "", ""), (5, "go:function:no", "go:function:a", "r", 0, T(1), "", ""), (5, "go:function:no", "go:function:a", "r", 0, T(1), "", ""), (6, "go:function:b", "go:function:a", "r", 0, T(4), "", ""),
    ]
    n = spark.createDataFrame(nodes, "id string, built_at timestamp_ntz, removed_at timestamp_ntz, edge_id string")
    e = spark.createDataFrame(edges, EDGES)
    assert rows(graph_orphans(e, n).select("edge_id", "endpoint")) == [(2, "target"), (5, "source"), (6, "source")]
    assert graph_orphans(e, n.limit(0)).count() == 9 and graph_orphans(e.limit(0), n).count() == 0


def test_cascade_reaches_the_end_of_long_chains(spark):
    t = spark.createDataFrame([(f"{i:02d}", f"{i - 1:02d}" if i else "gone") for i in range(70)], "id string, up string")
    got = orphan_cascade({"t": Table(t, "id")}, [ForeignKey("t", "up", "t")]).first()
    assert (got.direct, got.inherited, got.references) == (1, 69, 70)


def test_references_to_orphaned_nodes_are_inherited(spark):
    nodes = spark.createDataFrame([("n:a:1", "f", T(0), None), ("n:a:2", "lost", T(0), T(9)), ("n:a:3", "", T(0), None)], "id string, sourcefile string, built_at timestamp_ntz, removed_at timestamp_ntz")
    edges = [(1, "n:a:1", "n:a:2", T(1)), (2, "n:a:1", "n:a:2", T(9)), (3, "n:a:3", "n:link:2", T(1)), (4, "n:a:9", None, None)]
    e = spark.createDataFrame(edges, "edge_id bigint, source string, target string, built_at timestamp_ntz")
    tables, keys = project_keys(Table(e, "edge_id", "built_at"), Table(nodes, "id", "built_at", "built_at", "removed_at"), Table(spark.createDataFrame([("f",)], "path string"), "path"))
    got = rows(orphan_references(tables, keys).select("tbl", "key", "column", "state"))
    assert got == [("edges", "1", "target", "inherited"), ("edges", "2", "target", "direct"), ("edges", "4", "source", "direct"), ("nodes", "n:a:2", "sourcefile", "direct")]
    assert rows(graph_orphans(e, nodes, spark.createDataFrame([("f",)], "path string")).select("edge_id", "endpoint")) == [(2, "target"), (4, "source")]


def test_cascade_follows_keys_and_ends_on_cycles(spark):
    t = spark.createDataFrame([("r",)], "id string")
    a = spark.createDataFrame([("a1", "r"), ("a2", "gone"), ("a3", None)], "id string, up string")
    b = spark.createDataFrame([("b1", "a1", "b2"), ("b2", "a2", "b1"), ("b3", "a9", ""), ("b4", "a3", "b2")], "id string, up string, peer string")
    tables = {"t": Table(t, "id"), "a": Table(a, "id"), "b": Table(b, "id")}
    keys = [ForeignKey("a", "up", "t"), ForeignKey("b", "up", "a"), ForeignKey("b", "peer", "b")]
    got = {(r.tbl, r.column): (r.direct, r.inherited, r.references) for r in orphan_cascade(tables, keys).collect()}
    assert got == {("a", "up"): (1, 0, 2), ("b", "up"): (1, 1, 4), ("b", "peer"): (0, 3, 3)}
