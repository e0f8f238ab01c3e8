import random
import re

import numpy as np
import pytest

from graphloom.llm.leakage import FMIndex, Phrases, WaveletMatrix, _Shard, leaked_spans, suffix_array, words_of

WORDS = [f"w{i}" for i in range(30)]


def brute(docs, items, k=12):
    grams = {}
    for i, t in items:
        w = words_of(t or "")
        for j in range(len(w) - k + 1):
            grams.setdefault(tuple(w[j : j + k]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words_of(t or "")
        for j in range(len(w) - k + 1):
            for i in grams.get(tuple(w[j : j + k]), ()):
                out.add((d, i))
    return out


def test_suffix_array():
    r = np.random.default_rng(3)
    for n in (1, 2, 7, 200):
        t = r.integers(0, 3, n)
        want = sorted(range(n), key=lambda i: tuple(t[i:]))
        assert suffix_array(t).tolist() == want


def test_wavelet_ranks():
    r = np.random.default_rng(4)
    t = r.integers(0, 13, 300)
    w = WaveletMatrix(t, 4)
    at, c = r.integers(0, 301, 200), r.integers(0, 13, 200)
    assert w.rank(c, at).tolist() == [int((t[:a] == x).sum()) for a, x in zip(at, c)]
    assert w.access(np.arange(300)).tolist() == t.tolist()


def test_search_and_locate():
    r = np.random.default_rng(5)
    t = np.r_[r.integers(1, 4, 400), 0, r.integers(1, 4, 300), 0]
    index = FMIndex(t, 3)
    rows = np.array([t[i : i + 5] for i in range(0, 390, 17)], np.int32)
    which, lo, hi = index.search(rows)
    for w, a, b in zip(which, lo, hi):
        got = sorted(index.locate(np.arange(a, b)).tolist())
        assert got == [i for i in range(len(t) - 4) if (t[i : i + 5] == rows[w]).all()]
    assert set(which) == set(range(len(rows)))


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    items = [(i, text(40)) for i in range(6)] + [(90, "too short"), (91, None)]
    docs = []
    for d in range(40):
        own = text(r.randrange(0, 60))
        if d % 3 == 0:
            w = words_of(items[d % 6][1])
            a = r.randrange(0, 20)
            cut = w[a : a + r.choice([11, 12, 13, 20])]
            own += " other " + r.choice([", ", "\n- ", " … "]).join(x.upper() if d % 2 else x for x in cut) + " end"
        docs.append((d, own))
    docs += [(200, None), (201, ""), (202, items[0][1] * 3)]
    got = leaked_spans(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(g.doc_id, g.item_id) for g in got} == brute(docs, items)


def test_spans_are_merged_and_exact():
    item = " ".join(f"t{i}" for i in range(30))
    text = "Before it; " + item.replace(" ", ", ").upper() + " -- after it"
    shard = _Shard(Phrases([(1, item)]))
    shard.add(7, text)
    (row,) = shard.spans().itertuples(index=False)
    assert (row.doc_id, row.item_id, row.words) == (7, 1, 30)
    assert re.findall(r"\w+", text[row.start : row.end].lower()) == item.split()


def test_folding_keeps_word_bounds():
    assert words_of("İstanbul STRASSE Straße") == ["i̇stanbul", "strasse", "strasse"]


def test_empty_tables(spark):
    d, i = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert leaked_spans(d, i).count() == 0
