import itertools

import pytest
from pyspark.sql import functions as F

from graphloom.llm.copies import bare, bare_fields, collapse, copy_members, entity_records, node_records, possible_repeats

ENTITY = "entity_key string, type string, label string, props string, doc_id bigint"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_bare_forms(spark):
    df = spark.createDataFrame([("  **Work Group** ",), ("work-group",), ("ÜBER　Blick",), (None,), ("straße",), ("STRASSE",)], "s string")
    assert [r[0] for r in df.select(bare(F.col("s"))).collect()] == ["workgroup", "workgroup", "überblick", "", "strasse", "strasse"]


@pytest.mark.parametrize(
    "a, b, same",
    [
        ('{"a": 1, "b": "x y"}', '{\n "B":"XY", "a":"1"}', True),
        (None, "{ }", True),
        ("{}", "", False),
        ('{"a": "in\\u2014review"}', '{"a":"in review"}', True),
        ('{"a": 12}', '{"a": 1}', False),
        ('{"a": "b"}', '{"b": "a"}', False),
    ],
)
def test_fields(spark, a, b, same):
    x, y = (r[0] for r in spark.createDataFrame([(a,), (b,)], "p string").select(bare_fields(F.col("p"))).collect())
    assert (x == y) == same


def test_members_and_collapse(spark):
    data = [
        ("e3", "Concept", "Route  Cache", '{"a": 1}', 1), ("e1", "concept", "route-cache", '{"A":"1"}', 2), ("e2", "concept", "RouteCache", None, 3),
        ("e1", "concept", "route-cache", '{"A":"1"}', 2), ("e4", None, "x", None, None), ("e5", "", "X!", "{}", None), ("e6", "concept", None, None, 1), ("e7", "concept", " ", None, 1),
    ]
    r = entity_records(spark.createDataFrame(data, ENTITY))
    assert rows(copy_members(r)) == [("e1", "e3", 2), ("e4", "e5", 2)]
    assert rows(collapse(r)) == [("e1", 2), ("e2", 1), ("e4", 2), ("e6", 1), ("e7", 1)]


def test_nodes_same_kind_and_file(spark):
    data = [("a:entity:1", "A b", ""), ("b:entity:2", "a.B", None), ("a:section:1", "ab", ""), ("a:entity:3", "ab", "f"), ("a:function:1", "ab", ""), ("a:function:2", "ab", "")]
    r = node_records(spark.createDataFrame(data, "id string, label string, sourcefile string"))
    assert rows(copy_members(r)) == [("a:entity:1", "b:entity:2", 2)]


def test_empty(spark):
    r = entity_records(spark.createDataFrame([], ENTITY))
    assert rows(copy_members(r)) == [] and rows(collapse(r)) == []


def test_hot_group_is_whole(spark):
    n = 3000
    r = spark.range(n).select(F.format_string("k%05d", "id").alias("key"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("canon"))
    got = copy_members(r)
    assert got.count() == 999 and {x.first_key for x in got.collect()} == {"k00000"}


def test_filter_has_no_false_negatives(spark):
    vals = [i for i in range(5000)] + [i for i in range(0, 5000, 7)]
    df = spark.createDataFrame([(v,) for v in vals], "v bigint").select(F.xxhash64("v").alias("h"), "v").repartition(7)
    kept = {r.v for r in df.where(possible_repeats(df, "h")).collect()}
    assert set(range(0, 5000, 7)) <= kept and len(kept) < 900


def test_against_all_pairs(spark):
    words = ["Alpha", "alpha ", "AL-PHA", "beta", "Beta!", "gamma"]
    data = [(f"k{i:03d}", words[i * 7 % 6]) for i in range(60)]
    r = spark.createDataFrame(data, "key string, label string").select("key", bare(F.col("label")).alias("canon"))
    norm = {k: "".join(c for c in w if c.isalnum()).casefold() for k, w in data}
    want = sorted({(min(x for x in norm if norm[x] == norm[b]), b) for a, b in itertools.permutations(norm, 2) if a < b and norm[a] == norm[b]})
    assert sorted((x.first_key, x.copy_key) for x in copy_members(r).collect()) == want
