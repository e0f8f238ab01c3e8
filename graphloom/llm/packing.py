"""Filling fixed-capacity containers with documents, sized in tokens of a public tokenizer.

Minimum bin slack: a container is opened with the largest remaining item; a subset-sum table, kept as the bits of one
integer, then finds the multiset of remaining lengths that fills the rest closest to capacity, and backtracking reads
off how many items of each length it takes. The same filling is repeated while its counts last, so work grows with the
number of different fillings, not with the number of items.

Documents are spread by hash over windows of about ``WINDOW`` items; every window is packed on its own, by one task, and
only its last containers can have room to spare. An item longer than the capacity is cut into full containers and a
remainder, which is packed like any item; no other item is ever cut.

Defined results: a null or empty text has no tokens and still comes out once. A doc_id that stands in several rows comes
out once, with its longest text. Extra columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.scratch import cut
from graphloom.plans.spread import spread

WINDOW = 20_000
#: Bits that number the containers inside a window.
BIN_BITS = 32


def default_vocabulary() -> str:
    """Path of the byte-level BPE vocabulary the environment offers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_counter(vocabulary: str, pattern: str | None = None):
    """``texts -> counts`` with a byte-level BPE vocabulary file in rank format."""
    import tiktoken

    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    coder = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(coder.encode_ordinary(t)) if t else 0 for t in texts]


def token_count(text: Column, vocabulary: str | None = None) -> Column:
    """Number of tokens of the whole text; null counts as empty. Special-token strings are ordinary text."""
    vocabulary = vocabulary or default_vocabulary()
    held = []

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not held:
            held.append(token_counter(vocabulary))
        for s in batches:
            yield pd.Series(held[0](s.where(s.notna(), None)), dtype="int64")

    return count(text)


def fill_closest(lengths: np.ndarray, counts: np.ndarray, room: int) -> dict[int, int]:
    """Index -> number of items of that length whose sum comes closest to ``room`` without exceeding it.

    ``lengths`` descend. Exact over the whole multiset: stops early only when the room is filled to the last token.
    """
    mask, reach, trail = (1 << (room + 1)) - 1, 1, []
    for i, (size, n) in enumerate(zip(lengths.tolist(), counts.tolist())):
        if size > room or n == 0 or size == 0:
            continue
        n, step = min(n, room // size), 1
        while n > 0:
            take = min(step, n)
            trail.append((i, take, take * size, reach))
            reach |= (reach << (take * size)) & mask
            n -= take
            step *= 2
        if reach >> room & 1:
            break
    left, used = reach.bit_length() - 1, {}
    for i, take, width, before in reversed(trail):
        if not before >> left & 1:
            used[i] = used.get(i, 0) + take
            left -= width
    return used


def pack_window(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of every item of one window; no container's sizes exceed ``capacity``."""
    out = np.zeros(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    lengths, first, counts = np.unique(-sizes[order], return_index=True, return_counts=True)
    lengths, counts = -lengths, counts.copy()
    taken = first.copy()
    n, head = 0, 0
    while True:
        while head < len(lengths) and counts[head] == 0:
            head += 1
        if head == len(lengths) or lengths[head] == 0:
            break
        counts[head] -= 1
        used = fill_closest(lengths[head:], counts[head:], int(capacity - lengths[head]))
        counts[head] += 1
        filling = {head + i: k for i, k in used.items()}
        filling[head] = filling.get(head, 0) + 1
        times = min(int(counts[i]) // k for i, k in filling.items())
        for i, k in filling.items():
            block = order[taken[i] : taken[i] + k * times]
            out[block] = n + np.repeat(np.arange(times), k)
            taken[i] += k * times
            counts[i] -= k * times
        n += times
    if head < len(lengths):
        out[order[taken[head] :]] = max(0, n - 1)
    return out


def pack(sized: DataFrame, capacity: int, window: int = WINDOW) -> DataFrame:
    """``doc_id, part, tokens, bin_id``: every item of ``sized`` (doc_id, tokens) in a container of ``capacity`` tokens.

    ``part`` is 0 for items that stay whole; longer ones have parts 0, 1, … in text order.
    """
    cap = F.lit(capacity)
    parts = F.greatest(F.lit(1), F.ceil(F.col("tokens") / cap)).cast("int")
    items = cut(sized.where("doc_id is not null").groupBy("doc_id").agg(F.max("tokens").alias("tokens")), "items")
    n = items.agg(F.sum(parts)).first()[0] or 0
    windows = max(1, -(-n // window))
    pieces = items.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).select(
        F.pmod(F.xxhash64("doc_id", "part"), F.lit(windows)).alias("w"),
        "doc_id",
        "part",
        F.least(cap.cast("bigint"), F.col("tokens") - F.col("part") * cap).cast("bigint").alias("tokens"),
    )

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "part"], kind="stable")
        bins = pack_window(pdf["tokens"].to_numpy(np.int64), capacity)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "part": pdf["part"], "tokens": pdf["tokens"], "bin_id": (int(key[0]) << BIN_BITS) + bins})

    return pieces.groupBy("w").applyInPandas(run, "doc_id bigint, part int, tokens bigint, bin_id bigint")


def pack_documents(documents: DataFrame, capacity: int = 2048, vocabulary: str | None = None, window: int = WINDOW) -> DataFrame:
    """:func:`pack` over the token counts of whole texts."""
    return pack(spread(documents.select("doc_id", "text")).select("doc_id", token_count(F.col("text"), vocabulary).alias("tokens")), capacity, window)


def packing_faults(documents: DataFrame, packed: DataFrame, capacity: int, tightness: float = 1.01) -> DataFrame:
    """One row ``documents, missing, repeated, cut_without_need, overfull, incomplete, tight``: what a packing owes.

    ``missing`` and ``repeated`` documents, documents cut though they fit, containers above ``capacity``, documents whose
    parts do not run from 0 on, and whether the containers exceed the fewest possible by no more than the factor
    ``tightness`` and two a window.
    """
    doc = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("part").alias("parts"), F.max("part").alias("last"), F.sum("tokens").alias("tokens"))
    wanted = documents.select("doc_id").where("doc_id is not null").distinct()
    joined = wanted.join(doc, "doc_id", "full").join(wanted.withColumn("_known", F.lit(True)), "doc_id", "left")
    state = joined.agg(
        F.count_if("_known").alias("documents"), F.count_if(F.col("rows").isNull()).alias("missing"), F.count_if(F.col("rows") > F.col("parts")).alias("repeated"),
        F.count_if((F.col("parts") > 1) & (F.col("tokens") <= capacity)).alias("cut_without_need"), F.count_if(F.col("last") + 1 != F.col("parts")).alias("incomplete"),
    )
    bins = packed.groupBy("bin_id").agg(F.sum("tokens").alias("tokens"))
    windows = F.countDistinct(F.shiftright("bin_id", BIN_BITS))
    filled = bins.agg(F.count_if(F.col("tokens") > capacity).alias("overfull"), (F.count(F.lit(1)) <= F.ceil(F.sum("tokens") / capacity) * tightness + 2 * windows).alias("tight"))
    return state.join(F.broadcast(filled)).select("documents", "missing", "repeated", "cut_without_need", "overfull", "incomplete", "tight")


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """``capacity, items, bins, tokens, unused_share`` of a packing."""
    per_bin = packed.groupBy("bin_id").agg(F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("tokens"))
    return per_bin.agg(
        F.lit(capacity).alias("capacity"),
        F.sum("items").alias("items"),
        F.count(F.lit(1)).alias("bins"),
        F.sum("tokens").alias("tokens"),
        (1 - F.sum("tokens") / (F.count(F.lit(1)) * capacity)).alias("unused_share"),
    )
