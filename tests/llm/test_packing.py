import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm.packing import fill_closest, fill_report, pack, pack_documents, pack_window, token_counter


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), min_size=1, max_size=7), st.integers(0, 90))
def test_fill_is_optimal(items, room):
    lengths = np.array(sorted(items, reverse=True))
    counts = np.array([items[x] for x in lengths])
    used = fill_closest(lengths, counts, room)
    assert all(used[i] <= counts[i] for i in used)
    total = sum(int(lengths[i]) * k for i, k in used.items())
    reach = {0}
    for size, n in items.items():
        reach |= {r + size * k for r in reach for k in range(1, n + 1)}
    assert total == max(x for x in reach if x <= room)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=120))
def test_window_keeps_every_item_and_capacity(sizes):
    sizes = np.array(sizes, np.int64)
    bins = pack_window(sizes, 64)
    assert len(bins) == len(sizes)
    for b in set(bins.tolist()):
        assert sizes[bins == b].sum() <= 64


def test_pack_parts_and_repeats(spark):
    df = spark.createDataFrame([(1, 250), (2, 40), (3, 0), (4, 60), (2, 30), (None, 5)], "doc_id bigint, tokens bigint")
    got = pack(df, 100).collect()
    parts = {}
    for r in got:
        parts.setdefault(r.doc_id, []).append((r.part, r.tokens))
    assert {k: sorted(v) for k, v in parts.items()} == {1: [(0, 100), (1, 100), (2, 50)], 2: [(0, 40)], 3: [(0, 0)], 4: [(0, 60)]}
    load = {}
    for r in got:
        load[r.bin_id] = load.get(r.bin_id, 0) + r.tokens
    assert max(load.values()) <= 100


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id bigint, tokens bigint"), 10).count() == 0


def test_documents_full_containers(spark):
    texts = [(i, "word " * (i % 37 + 1) + ("<|endoftext|>" if i == 5 else "")) for i in range(1, 900)] + [(1000, None), (1001, ""), (1002, "long " * 9000)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    packed = pack_documents(df, 512)
    rep = fill_report(packed, 512).first()
    assert packed.where("part = 0").count() == len(texts) and rep.unused_share < 0.02


def test_counter_counts_whole_texts():
    import public_tokenizers

    count = token_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert count(["", None, "hello world"])[:2] == [0, 0]
    long = "hello world " * 20000
    assert count([long])[0] == pytest.approx(20000 * 2, rel=0.01)
