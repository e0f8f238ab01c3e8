"""Generated, minified, vendored and data-only source files.

Files become token sequences without comments. Two sets of five-token shingles are kept of each: one with identifiers
and literals masked, one as written. Equal sets are one class. MinHash bands propose near-equal classes, every proposal
is verified at a Jaccard similarity of 0.8, and links are closed into clusters.

* Clusters of *masked* sets are families of files of one shape, and a family is judged as a whole, by the means over its
  members: almost nothing but literals is data; endless lines of one-letter names were packed; a shape that repeats
  itself (few different masked shingles for many tokens) was generated.
* Clusters of sets *as written* that span repositories are copies of one project's files: vendored. A file of which the
  corpus holds a single copy leaves no cluster; it is taken as vendored if its leading comment names its origin or it
  lies in a project folder below a directory set aside for other projects.

The plain rule "a family within one repository is generated" is not used: hand-written files of one repository share
their shapes as well (README has figures), so the family's repetition decides.

Defined results: null or blank texts are no cases. Exact repeats of a row count once; a path with several texts is a case
if one of them is. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.nearcopies import Hasher, band_keys, near_links, shingles
from graphloom.operators.components import star_roots
from graphloom.plans.scratch import cut
from graphloom.plans.skew import crowded_keys, salted_join
from graphloom.plans.spread import spread

SIMILARITY = 0.8
#: Bands and rows of the signatures: a pair at 0.8 shares a band with a chance of 0.997, unrelated files as written (0.1) of 3e-7.
WRITTEN_BANDS = (32, 8)
MASKED_BANDS = (20, 8)
#: Means over a family: distinct masked shingles per token, share of literals in its characters, length of lines and names.
REPEATS, LITERAL, LINE, NAME = 0.10, 0.55, 150.0, 3.0

# Keywords that keep their form in masked shingles.
KEYWORDS = frozenset(
    "abstract and as async await break case catch class const continue def default defer do elif else enum export extends "
    "false final finally fn for from func function go if implements import in include int interface is lambda let map "
    "match mod mut new nil none not null or package pass private protected public raise range require return self static "
    "struct super switch this throw throws trait true try type typedef use var void while with yield".split()
)
# Directories set aside for other projects' files.
FOREIGN_DIRS = r"/(?:vendor|vendored|third_party|third-party|3rdparty|node_modules|bower_components|external|deps|Pods)/[^/]+/"

_LEADING = re.compile(r"\A\s*(?:(?:#(?!\s*include\b)|//|--)[^\n]*(?:\n|\Z)\s*|/\*.*?\*/\s*)+", re.S)
_BLOCK = re.compile(r"/\*.*?\*/", re.S)
_LINE = re.compile(r"^[ \t]*(?://|#(?!\s*(?:include|define|if|endif|else|pragma)\b)|--[ \t])[^\n]*$", re.M)
_TOKEN = re.compile(
    r"[^\W\d][\w$]*|[^\s\w\"'`$]|\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|`[^`]*(?:`|\Z)"
    r"|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|0[xX][0-9a-fA-F]+|\d[\w.]*|\$[\w$]*"
)
_ORIGIN = re.compile(
    r"^\W*[\w.\-]+ - version \d|^\W*[\w.\-]+ v?\d+\.\d+\.\d+\b|\bimported (?:\w+ )?from\b|\bcopied (?:\w+ )?from\b"
    r"|\bvendored from\b|^\W*upstream:\s|\bredistribution and use in source\b",
    re.I | re.M,
)


class Tokens(dict):
    """Numbers of tokens, and per number the hash as written, the hash masked, and the characters of literals and names.

    Every different token is looked at once; a text then is one lookup per token and whole-array work.
    """

    def __init__(self, limit: int = 1 << 18):
        super().__init__()
        self.limit = limit
        self.table = np.zeros((1024, 2), np.uint64)
        self.chars = np.zeros((1024, 3), np.int64)

    def __missing__(self, t: str) -> int:
        n, c = len(self), t[0]
        if n == len(self.table):
            self.table, self.chars = np.concatenate([self.table] * 2), np.concatenate([self.chars] * 2)
        literal, name = 0, False
        if c in "\"'`" or c.isdigit():
            masked, literal = "L", len("".join(t.split()))
        else:
            low = t.lower()
            name = (c.isalpha() or c in "_$") and low not in KEYWORDS
            masked = "I" if name else low
        self.table[n] = xxhash.xxh3_64_intdigest(t), xxhash.xxh3_64_intdigest(masked)
        self.chars[n] = literal, name, len(t) if name else 0
        self[t] = n
        return n

    def __call__(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes as written, masked hashes, and the sums of literal characters, names and their characters."""
        if len(self) > self.limit:
            self.clear()
        at = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        return self.table[at, 0], self.table[at, 1], self.chars[at].sum(axis=0)


def profile(text: str, hasher: Tokens | Hasher) -> dict:
    """Shingle sets and measures of one file."""
    tokens_of = hasher if isinstance(hasher, Tokens) else Tokens()
    leading = _LEADING.match(text)
    body = _LINE.sub("", _BLOCK.sub(" ", text))
    tokens = _TOKEN.findall(body)
    written, masked, (literal, names, name_chars) = tokens_of(tokens)
    shape = shingles(masked)
    lines = list(filter(None, map(len, map(str.strip, body.split("\n")))))
    return {
        "written": shingles(written),
        "shape": shape,
        "tokens": len(tokens),
        "repeats": len(shape) / max(1, len(tokens)),
        "literal": int(literal) / max(1, len("".join(body.split()))),
        "line": sum(lines) / max(1, len(lines)),
        "name": int(name_chars) / max(1, int(names)),
        "origin": bool(leading and _ORIGIN.search(leading.group())),
    }


def _class(shingle_set: np.ndarray) -> str:
    """Name of the class of files with this very set."""
    return xxhash.xxh3_128_hexdigest(shingle_set.tobytes())


_MEASURES = ("tokens", "repeats", "literal", "line", "name")
_PROFILE = (
    "path string, repo string, shape string, written string, tokens bigint, repeats double, literal double, line double, "
    "name double, origin boolean, shape_set array<bigint>, shape_bands array<bigint>, written_bands array<bigint>"
)


_LONGS = pa.list_(pa.int64())
_ARROW = pa.schema(
    [("path", pa.string()), ("repo", pa.string()), ("shape", pa.string()), ("written", pa.string()), ("tokens", pa.int64()), ("repeats", pa.float64()), ("literal", pa.float64())]
    + [("line", pa.float64()), ("name", pa.float64()), ("origin", pa.bool_()), ("shape_set", _LONGS), ("shape_bands", _LONGS), ("written_bands", _LONGS)]
)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per file; sets and bands stand only in the first row of their class in this task."""
    tokens, shapes, texts = Tokens(), set(), set()
    for batch in batches:
        rows = []
        for path, repo, text in zip(*(batch.column(c).to_pylist() for c in ("path", "repo", "text"))):
            p = profile(text, tokens)
            if not p["tokens"]:
                continue
            shape, written = _class(p["shape"]), _class(p["written"])
            row = {"path": path, "repo": repo, "shape": shape, "written": written, "origin": p["origin"]} | {m: p[m] for m in _MEASURES}
            if shape not in shapes:
                row |= {"shape_set": p["shape"], "shape_bands": band_keys(p["shape"], *MASKED_BANDS)}
            if written not in texts:
                row["written_bands"] = band_keys(p["written"], *WRITTEN_BANDS)
            # Forgetting classes only repeats their sets; it bounds what a task remembers.
            for seen, c in ((shapes, shape), (texts, written)):
                if len(seen) > 1 << 20:
                    seen.clear()
                seen.add(c)
            rows.append(row)
        yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _ARROW], schema=_ARROW)


def _written_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens = Tokens()
    for batch in batches:
        sets = [profile(t, tokens)["written"] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([_class(s) for s in sets], pa.string()), pa.array(sets, _LONGS)], ["id", "shingles"])


def _clusters(links: DataFrame, classes: DataFrame) -> DataFrame:
    """``id, cluster`` of every class of ``classes`` (id); unlinked ones are a cluster of their own."""
    roots = star_roots(links.distinct()).withColumnRenamed("x", "id")
    return classes.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("cluster"))


def _families(files: DataFrame, rows: DataFrame) -> DataFrame:
    """``shape, reason``: what the clusters of masked sets say, per class."""
    sets = files.where("shape_set is not null").groupBy(F.col("shape").alias("id"))
    classes = cut(sets.agg(F.min(F.struct("shape_set", "shape_bands")).alias("m")).select("id", F.col("m.shape_set").alias("shingles"), F.col("m.shape_bands").alias("bands")), "shapes")
    cluster = _clusters(near_links(classes, SIMILARITY), classes.select("id"))
    sums = rows.groupBy(F.col("shape").alias("id")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(m).alias(m) for m in _MEASURES))
    placed = cut(sums.join(cluster, "id"), "placed")
    mean = placed.groupBy("cluster").agg(*((F.sum(m) / F.sum("n")).alias(m) for m in _MEASURES))
    reason = (
        F.when(F.col("literal") >= LITERAL, "data")
        .when((F.col("line") >= LINE) & (F.col("name") < NAME), "minified")
        .when(F.col("repeats") < REPEATS, "generated")
    )
    return placed.select(F.col("id").alias("shape"), "cluster").join(mean.select("cluster", reason.alias("reason")).where("reason is not null"), "cluster").select("shape", "reason")


def _shared(texts: DataFrame, files: DataFrame, rows: DataFrame) -> DataFrame:
    """``written`` of the classes whose clusters of sets as written span repositories."""
    repos = rows.groupBy(F.col("written").alias("id")).agg(F.min("repo").alias("a"), F.max("repo").alias("b"), F.min("path").alias("path"))
    bands = files.where("written_bands is not null").groupBy(F.col("written").alias("id")).agg(F.min("written_bands").alias("bands"))
    classes = cut(repos, "texts")

    def sets(ids: DataFrame) -> DataFrame:
        """The sets of classes that share a band are made again from one file of each: no set of all files is ever stored."""
        wanted = classes.join(ids, "id", "left_semi")
        again = texts.join(wanted.select("path").distinct(), "path", "left_semi").select("text").mapInArrow(_written_sets, "id string, shingles array<bigint>")
        return again.join(wanted.select("id"), "id", "left_semi").dropDuplicates(["id"])

    cluster = _clusters(near_links(bands, SIMILARITY, sets), classes.select("id"))
    placed = classes.join(cluster, "id")
    wide = placed.groupBy("cluster").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a <> b").select("cluster")
    return placed.join(wide, "cluster", "left_semi").select(F.col("id").alias("written"))


def judged_files(source_files: DataFrame) -> DataFrame:
    """``path, reason, basis`` of files that are not hand-written source; ``basis`` is ``family``, ``copies`` or ``origin``.

    ``family``: verdict of the file's cluster of masked sets; ``copies``: its cluster of sets as written spans
    repositories; ``origin``: a leading comment or folder that names another project.
    """
    texts = spread(source_files.select("path", "repo", "text").where("path is not null and text is not null and trim(text) <> ''"))
    files = cut(texts.mapInArrow(_profiles, _PROFILE), "profiles")
    rows = cut(files.select("path", "repo", "shape", "written", "origin", *_MEASURES).distinct(), "files")
    families, shared = _families(files, rows), _shared(texts, files, rows)
    by_shape = salted_join(rows, families, "shape", crowded_keys(rows, "shape"), F.col("path")).select("path", "reason", F.lit("family").alias("basis"))
    vendored = F.lit("vendored").alias("reason")
    copies = salted_join(rows, shared, "written", crowded_keys(rows, "written"), F.col("path"), "left_semi").select("path", vendored, F.lit("copies").alias("basis"))
    origin = rows.where(F.col("origin") | F.col("path").rlike(FOREIGN_DIRS)).select("path", vendored, F.lit("origin").alias("basis"))
    return by_shape.unionByName(copies).unionByName(origin).distinct()


def foreign_files(source_files: DataFrame) -> DataFrame:
    """``path, reason`` of files that are not hand-written source of their repository.

    ``reason`` is generated, minified, data or vendored; a file may have several.
    """
    return judged_files(source_files).select("path", "reason").distinct()
