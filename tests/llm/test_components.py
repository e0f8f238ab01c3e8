import random

import pytest

from graphloom.llm.components import components, links, node_groups


def brute(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), []).append(x)
    return {(x, min(g)) for g in groups.values() for x in g}


def run(spark, pairs):
    df = spark.createDataFrame(pairs or [], "a string, b string")
    return {(r.node_id, r.group_id) for r in components(links(df, "a", "b")).collect()}


@pytest.mark.parametrize(
    "pairs",
    [
        [],
        [("a", "b")],
        [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(33)],
        [(f"c{i}", f"c{(i + 1) % 9}") for i in range(9)],
        [("hub", f"leaf{i}") for i in range(40)],
        [(f"k{i}", f"k{j}") for i in range(6) for j in range(i)],
        [("a", "b"), ("b", "a"), ("a", "a"), (None, "x"), ("y", None), ("a", "b")],
        [("h", "x1"), ("x1", "x2"), ("x2", "x3"), ("x3", "h"), ("h", "y"), ("h", "z"), ("z", "y")],
    ],
)
def test_shapes(spark, pairs):
    clean = [(a, b) for a, b in pairs if a and b and a != b]
    assert run(spark, pairs) == brute(clean)


def test_random_graph(spark):
    r = random.Random(5)
    pairs = [(f"v{r.randrange(300):03d}", f"v{r.randrange(300):03d}") for _ in range(260)]
    pairs += [(f"w{i}", f"w{i + 1}") for i in range(20)] + [("v001", "w3")]
    assert run(spark, pairs) == brute([(a, b) for a, b in pairs if a != b])


def test_node_groups_keep_lone_nodes(spark):
    nodes = spark.createDataFrame([("a", "A"), ("b", None), ("c", ""), ("a", "A"), (None, "x")], "id string, label string")
    pairs = spark.createDataFrame([("b", "a", 95.0), ("a", "c", 91.9), ("c", "a", None)], "left_id string, right_id string, score double")
    assert sorted(tuple(r) for r in node_groups(nodes, pairs).collect()) == [("a", "A", "a"), ("b", None, "a"), ("c", "", "c")]
