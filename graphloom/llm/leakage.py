"""Evaluation texts leaking into training text.

Every shard of the corpus gets an FM-index over its words: suffix array, Burrows-Wheeler transform, a wavelet matrix for
rank queries and a sampled suffix array. The corpus is read and indexed once, whatever the number of test items: the
indexes are stored in the shared folder, and all blocks of test items are searched in each of them. All runs of ``WORDS``
words of a block are searched backwards through the wavelet ranks at once, the surviving ranges are located by walking to
sampled suffixes, and overlapping or adjoining hits of one item in one document are merged into removal spans.

Only words that occur in test items can take part in a match. As long as the items have at most ``VOCABULARY`` different
words, those are sent to the executors, and a shard indexes the stretches of at least ``WORDS`` such words alone, parted
by a sentinel; beyond that number every word is indexed. The result is the same and exact: nothing is sampled away. Each
document lies whole in one shard. A word stands for its 64-bit hash.

Words are the longest runs of Unicode letters and digits, case folded. Null and empty texts match nothing, repeated rows
give repeated spans, items with fewer than ``WORDS`` words cannot be found.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.copies import _fetch, _store
from graphloom.plans.scratch import cut, fresh_path
from graphloom.plans.spread import spread

WORDS = 12
#: A shard is indexed when it holds this many words.
SHARD_WORDS = 1 << 20
#: One suffix position in this many is stored.
SAMPLE = 16
#: Test items are stored in blocks of about this many bytes.
ITEM_BYTES = 1 << 22
#: Different words of the test items up to which they are broadcast (8 bytes each) to pass over text that cannot match.
VOCABULARY = 1 << 22
#: Words whose numbers a task remembers.
REMEMBERED = 1 << 20

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return [w.casefold() for w in _WORD.findall(text)]


def _folded_words(text: str) -> list[str]:
    """``words_of``, folding the whole text at once where that cannot move word bounds."""
    return _WORD.findall(text.casefold()) if text.isascii() or len(text.casefold()) == len(text) else words_of(text)


class _Numbers(dict):
    """Word -> 64-bit number; 0 for words that no test item has, where those are known."""

    def __init__(self, vocabulary: np.ndarray | None = None):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word) or 1
        if self.vocabulary is not None:
            at = int(np.searchsorted(self.vocabulary, np.uint64(h)))
            if at == len(self.vocabulary) or int(self.vocabulary[at]) != h:
                h = 0
        self[word] = h
        return h

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Phrases:
    """The distinct runs of ``k`` words of a set of items, as rows of word numbers, and the items of each."""

    def __init__(self, items: list[tuple[int, str]], k: int = WORDS):
        self.k, numbers, rows, owners = k, _Numbers(), [], []
        for item, text in items:
            ids = numbers.of(words_of(text or ""))
            if len(ids) >= k:
                runs = np.lib.stride_tricks.sliding_window_view(ids, k)
                rows.append(runs)
                owners.append(np.full(len(runs), item, np.int64))
        found = np.concatenate(rows) if rows else np.zeros((0, k), np.uint64)
        self.rows, place = np.unique(found, axis=0, return_inverse=True)
        pairs = np.unique(np.column_stack([place.ravel(), np.concatenate(owners)]), axis=0) if rows else np.zeros((0, 2), np.int64)
        self.start = np.searchsorted(pairs[:, 0], np.arange(len(self.rows) + 1))
        self.items = pairs[:, 1]

    @property
    def vocabulary(self) -> np.ndarray:
        return np.unique(self.rows)

    def dump(self) -> bytes:
        return _dump(rows=self.rows, start=self.start, items=self.items)

    @classmethod
    def load(cls, data: bytes) -> Phrases:
        out, z = cls.__new__(cls), np.load(io.BytesIO(data))
        out.rows, out.start, out.items = z["rows"], z["start"], z["items"]
        out.k = out.rows.shape[1]
        return out


def _dump(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; a shorter suffix precedes those it starts."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order, step = np.argsort(rank, kind="stable"), 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[0, sorted_[1:] != sorted_[:-1]])
        rank = new
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        step *= 2
        if step >= n:
            return np.argsort(rank, kind="stable")


class WaveletMatrix:
    """Rank and access over small integers, one bit vector with prefix counts per bit of the alphabet."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros, self.vectors = bits, [], [], []
        current = values
        for level in range(bits - 1, -1, -1):
            bit = (current >> level) & 1
            self.vectors.append(bit.astype(bool))
            self.ones.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            current = np.r_[current[bit == 0], current[bit == 1]]

    @classmethod
    def from_vectors(cls, vectors: np.ndarray) -> WaveletMatrix:
        """The matrix of stored bit vectors, one row per level."""
        out = cls.__new__(cls)
        out.bits, out.vectors = len(vectors), list(vectors)
        out.ones = [np.r_[0, np.cumsum(v)].astype(np.int32) for v in vectors]
        out.zeros = [int(len(v) - v.sum()) for v in vectors]
        return out

    def rank(self, symbols: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often ``symbols[i]`` stands before position ``upto[i]``."""
        lo, hi = np.zeros_like(upto), upto.copy()
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros):
            bit = ((symbols >> level) & 1).astype(bool)
            l1, h1 = ones[lo], ones[hi]
            lo, hi = np.where(bit, zeros + l1, lo - l1), np.where(bit, zeros + h1, hi - h1)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        out, i = np.zeros(len(at), np.int64), at.copy()
        for vector, ones, zeros in zip(self.vectors, self.ones, self.zeros):
            bit = vector[i]
            out = (out << 1) | bit
            i = np.where(bit, zeros + ones[i], i - ones[i])
        return out


class FMIndex:
    """Backward search and location over a text of word numbers, in which 0 parts the stretches.

    Inside, every symbol is one higher and a single 0 ends the text, as walking back over the transform needs.
    """

    def __init__(self, text: np.ndarray, alphabet: int, sample: int = SAMPLE):
        text, alphabet = np.r_[text + 1, 0], alphabet + 1
        order = suffix_array(text)
        last = text[order - 1]
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=alphabet + 1))].astype(np.int64)
        self.tree = WaveletMatrix(last.astype(np.int64), max(1, int(alphabet).bit_length()))
        self.kept = order % sample == 0
        self.kept_before = np.r_[0, np.cumsum(self.kept)]
        self.positions = order[self.kept]
        self.n = len(text)

    def arrays(self) -> dict[str, np.ndarray]:
        """What :meth:`from_arrays` needs; prefix counts are made again."""
        return {"first": self.first, "levels": np.packbits(np.stack(self.tree.vectors), axis=1), "kept": np.packbits(self.kept), "positions": self.positions, "n": np.int64(self.n)}

    @classmethod
    def from_arrays(cls, z) -> FMIndex:
        out = cls.__new__(cls)
        out.n, out.first, out.positions = int(z["n"]), z["first"], z["positions"]
        out.tree = WaveletMatrix.from_vectors(np.unpackbits(z["levels"], axis=1, count=out.n).astype(bool))
        out.kept = np.unpackbits(z["kept"], count=out.n).astype(bool)
        out.kept_before = np.r_[0, np.cumsum(out.kept)]
        return out

    def search(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, lo, hi)`` of the suffix ranges that start with the phrases of ``rows``, where not empty."""
        alive = np.arange(len(rows))
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), self.n, np.int64)
        for j in range(rows.shape[1] - 1, -1, -1):
            c = rows[alive, j].astype(np.int64) + 1
            lo, hi = self.first[c] + self.tree.rank(c, lo), self.first[c] + self.tree.rank(c, hi)
            keep = lo < hi
            alive, lo, hi = alive[keep], lo[keep], hi[keep]
            if not len(alive):
                break
        return alive, lo, hi

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks, walking back to the nearest sampled suffix."""
        out, todo, i, steps = np.zeros(len(at), np.int64), np.arange(len(at)), at.astype(np.int64), 0
        while len(todo):
            done = self.kept[i]
            out[todo[done]] = self.positions[self.kept_before[i[done]]] + steps
            todo, i = todo[~done], i[~done]
            c = self.tree.access(i)
            i = self.first[c] + self.tree.rank(c, i)
            steps += 1
        return out


class _Shard:
    """Documents gathered until they are worth an index."""

    def __init__(self, phrases: Phrases | None = None, vocabulary: np.ndarray | None = None, k: int = WORDS):
        self.phrases, self.k = phrases, phrases.k if phrases else k
        self.numbers = _Numbers(phrases.vocabulary if phrases else vocabulary)
        self.clear()

    def clear(self) -> None:
        self.docs, self.parts, self.runs, self.begin, self.end, self.words = [], [], [], [], [], 0

    def add(self, doc_id: int, text: str) -> None:
        ids = self.numbers.of(_folded_words(text))
        if len(ids) < self.k:
            return
        edges = np.flatnonzero(np.diff(np.r_[0, ids != 0, 0].astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.k
        if not long.any():
            return
        bounds = np.array([m.span() for m in _WORD.finditer(text)], np.int64)
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            self.runs.append((self.words, len(self.docs), a))
            self.parts += [ids[a:b], np.zeros(1, np.uint64)]
            self.begin += [bounds[a:b, 0], np.zeros(1, np.int64)]
            self.end += [bounds[a:b, 1], np.zeros(1, np.int64)]
            self.words += b - a + 1
        self.docs.append(doc_id)

    def full(self) -> bool:
        return self.words >= SHARD_WORDS

    def index(self) -> Indexed | None:
        """The index of what was gathered, None if that is nothing; the shard is empty afterwards."""
        if not self.parts:
            return None
        hashes = np.concatenate(self.parts)
        alphabet = np.unique(hashes[hashes != 0])
        symbols = np.where(hashes == 0, 0, np.searchsorted(alphabet, hashes) + 1)
        out = Indexed(FMIndex(symbols, len(alphabet)), alphabet, np.array(self.docs, np.int64), np.array(self.runs, np.int64), np.concatenate(self.begin), np.concatenate(self.end))
        self.clear()
        return out

    def spans(self) -> pd.DataFrame | None:
        """Removal spans of the shard's own phrases; the shard is empty afterwards."""
        made = self.index()
        return None if made is None else made.spans(self.phrases)


@dataclass
class Indexed:
    """An FM-index with the words its symbols stand for and the places its positions have in the documents.

    ``runs`` has, per stretch, its first position, its document and the number of its first word there; ``begin`` and
    ``end`` are the bounds of every word in characters.
    """

    fm: FMIndex
    alphabet: np.ndarray
    docs: np.ndarray
    runs: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    def dump(self) -> bytes:
        return _dump(alphabet=self.alphabet, docs=self.docs, runs=self.runs, begin=self.begin, end=self.end, **self.fm.arrays())

    @classmethod
    def load(cls, data: bytes) -> Indexed:
        z = np.load(io.BytesIO(data))
        return cls(FMIndex.from_arrays(z), *(z[k] for k in ("alphabet", "docs", "runs", "begin", "end")))

    def spans(self, phrases: Phrases) -> pd.DataFrame:
        """``doc_id, item_id, start, end, words``: merged stretches of the phrases' items."""
        at = np.minimum(np.searchsorted(self.alphabet, phrases.rows), len(self.alphabet) - 1)
        usable = np.flatnonzero((self.alphabet[at] == phrases.rows).all(axis=1))
        which, lo, hi = self.fm.search(at[usable] + 1)
        hits = hi - lo
        ranks = np.repeat(lo - np.r_[0, np.cumsum(hits)[:-1]], hits) + np.arange(hits.sum())
        where, phrase = self.fm.locate(ranks), np.repeat(usable[which], hits)
        owners = phrases.start[phrase + 1] - phrases.start[phrase]
        item = phrases.items[np.repeat(phrases.start[phrase] - np.r_[0, np.cumsum(owners)[:-1]], owners) + np.arange(owners.sum())]
        where = np.repeat(where, owners)
        run = np.searchsorted(self.runs[:, 0], where, "right") - 1 if len(where) else where
        doc = self.runs[run, 1] if len(where) else where
        word = self.runs[run, 2] + where - self.runs[run, 0] if len(where) else where
        order = np.lexsort((word, item, doc))
        doc, item, word, where = doc[order], item[order], word[order], where[order]
        fresh = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (word[1:] > word[:-1] + phrases.k)] if len(doc) else np.zeros(0, bool)
        first = np.flatnonzero(fresh)
        last = np.r_[first[1:], len(doc)] - 1 if len(doc) else first
        return pd.DataFrame(
            {
                "doc_id": self.docs[doc[first]], "item_id": item[first], "start": self.begin[where[first]],
                "end": self.end[where[last] + phrases.k - 1], "words": word[last] - word[first] + phrases.k,
            }
        )


def _store_items(items: DataFrame, k: int, root: str) -> DataFrame:
    """``path, words`` of the stored blocks of test items: the file and the different words of each."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(int(i), t) for pdf in batches for i, t in zip(pdf["item_id"], pdf["text"])]
        phrases = Phrases(rows, k)
        if len(phrases.rows):
            path = f"{root}/items-{uuid.uuid4().hex}.npz"
            _store(path, phrases.dump())
            yield pd.DataFrame({"path": [path], "words": [phrases.vocabulary.view(np.int64)]})

    blocks = items.repartition(max(1, -(-int(total) // ITEM_BYTES)), "item_id")
    return cut(blocks.mapInPandas(run, "path string, words array<bigint>"), "items")


def leaked_spans(documents: DataFrame, items: DataFrame, k: int = WORDS, vocabulary: int = VOCABULARY) -> DataFrame:
    """``doc_id, item_id, start, end, words``: the merged stretches of each item in each document, in characters."""
    spark = documents.sparkSession
    schema = "doc_id bigint, item_id bigint, start bigint, end bigint, words bigint"
    root = fresh_path(spark, "leakage")
    texts = spread(documents.select("doc_id", "text").where("doc_id is not null and text is not null and text <> ''"))
    blocks = _store_items(items.select("item_id", "text").where("item_id is not null and text is not null"), k, root)
    paths = [r.path for r in blocks.select("path").orderBy("path").collect()]
    words = blocks.select(F.explode("words").alias("w")).distinct()
    known = [r.w for r in words.limit(vocabulary + 1).collect()]
    shared = spark.sparkContext.broadcast(np.sort(np.array(known, np.int64).view(np.uint64)) if len(known) <= vocabulary else None)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = _Shard(vocabulary=shared.value, k=k)

        def close() -> Iterator[pd.DataFrame]:
            if (made := shard.index()) is not None:
                path = f"{root}/shard-{uuid.uuid4().hex}.npz"
                _store(path, made.dump())
                yield pd.DataFrame({"path": [path]})

        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                shard.add(int(doc_id), text)
                if shard.full():
                    yield from close()
        yield from close()

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                made = Indexed.load(_fetch(path))
                for block in paths:
                    yield made.spans(Phrases.load(_fetch(block)))

    shards = cut(texts.mapInPandas(index, "path string"), "shards")
    return shards.repartition(max(1, spark.sparkContext.defaultParallelism), "path").mapInPandas(search, schema)
