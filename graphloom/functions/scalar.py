"""Scalar functions over labels, ids, paths and texts, as Column expressions that stay inside code generation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# The three confidence levels.
CONFIDENCE_NAMES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
CONFIDENCE_SCORES = (1.0, 0.5, 0.25)
# Kinds of ids that merge only among their own kind.
ISOLATED_KINDS = ("module", "section", "import", "call", "typeref", "link", "key")
# File types in the order in which they win a merge.
FILETYPE_RANK = ("code", "paper", "document", "image", "video", "rationale")
LABEL_CAP = 256


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _text(c: str | Column) -> Column:
    return F.coalesce(_c(c), F.lit(""))


def trim_space(c: str | Column) -> Column:
    """Strip Unicode white space from both ends."""
    return F.regexp_replace(_c(c), r"^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+\z", "")


def sanitize_text(c: str | Column) -> Column:
    """Control characters out, white space off both ends, at most 256 characters."""
    return F.substring(trim_space(F.regexp_replace(_text(c), r"\p{Cc}", "")), 1, LABEL_CAP)


def display_label(label: str | Column = "label", id_: str | Column = "id") -> Column:
    return F.coalesce(F.nullif(_c(label), F.lit("")), _c(id_))


def confidence_name(c: str | Column = "confidence") -> Column:
    return F.element_at(F.array(*map(F.lit, CONFIDENCE_NAMES)), _c(c) + 1)


def confidence_score(c: str | Column = "confidence") -> Column:
    return F.element_at(F.array(*map(F.lit, CONFIDENCE_SCORES)), _c(c) + 1)


def location(row: str | Column, col: str | Column) -> Column:
    """One-based ``row:column`` of zero-based positions."""
    return F.concat_ws(":", (_c(row) + 1).cast("string"), (_c(col) + 1).cast("string"))


def normalize_label(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]+", " "))


def entropy(c: str | Column) -> Column:
    """Bits per character; characters are counted as such, the length is the number of bytes."""
    s = _text(c)
    chars = F.filter(F.split(s, ""), lambda x: x != "")
    n = F.octet_length(s).cast("double")
    share = lambda x: F.size(F.filter(chars, lambda y: y == x)) / n
    terms = F.transform(F.transform(F.array_sort(F.array_distinct(chars)), share), lambda p: -p * F.log2(p))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b))


def shingles(c: str | Column, k: int = 3) -> Column:
    """Distinct runs of ``k`` characters without blanks; a shorter text is one shingle."""
    t = F.replace(_text(c), F.lit(" "), F.lit(""))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - k + 1), lambda i: F.substring(t, i, F.lit(k))))
    return F.when(F.octet_length(t) < k, F.array(t)).when(F.length(t) < k, F.array(t)).otherwise(grams)


def merge_bucket(id_: str | Column = "id") -> Column:
    k = F.split_part(_c(id_), F.lit(":"), F.lit(2))
    return F.when(k.isin(*ISOLATED_KINDS), F.concat(F.lit("k:"), k)).otherwise("entity")


def winner_score(id_: str | Column = "id", filetype: str | Column = "filetype") -> Column:
    """Sort key of the record that survives a merge; the least wins."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, FILETYPE_RANK)), _c(filetype)), F.lit(0)) - 1, F.lit(len(FILETYPE_RANK)))
    suffix = F.regexp_like(_c(id_), F.lit(r"_c\d+\z")).cast("int")
    return F.struct(rank.cast("int").alias("rank"), suffix.alias("suffix"), F.octet_length(_c(id_)).alias("size"), _c(id_).alias("id"))


def jaro_winkler_pair(a: str, b: str, boost_over: float = 0.7, prefix: int = 4) -> float:
    """Jaro similarity, raised for a common prefix when above ``boost_over``."""
    if a == b:
        return 1.0 if a else 0.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(max(la, lb) // 2 - 1, 0)
    used, matched = [False] * lb, []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                matched.append(ch)
                break
    m = len(matched)
    if not m:
        return 0.0
    other = [b[j] for j in range(lb) if used[j]]
    swaps = sum(x != y for x, y in zip(matched, other)) // 2
    jaro = (m / la + m / lb + (m - swaps) / m) / 3
    if jaro <= boost_over:
        return jaro
    common = 0
    for x, y in zip(a[:prefix], b[:prefix]):
        if x != y:
            break
        common += 1
    return jaro + common * 0.1 * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler_pair(x or "", y or "") for x, y in zip(a, b)])


def cross_language(a: str | Column, b: str | Column) -> Column:
    la, lb = (F.when(F.instr(_c(x), ":") > 0, F.split_part(_c(x), F.lit(":"), F.lit(1))) for x in (a, b))
    return F.coalesce(la != lb, F.lit(False))


def top_level_dir(path: str | Column) -> Column:
    return F.when(F.instr(_c(path), "/") > 0, F.substring_index(_c(path), "/", 1)).otherwise("")


def parent_dir_name(path: str | Column) -> Column:
    """Name of the directory a path lies in, with either slash; '' at the top."""
    parts = F.split(F.replace(_c(path), F.lit("\\"), F.lit("/")), "/")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise("")


def match_score(needle: str | Column, label: str | Column = "label", id_: str | Column = "id", file: str | Column = "sourcefile") -> Column:
    n, l_, i, f = (F.lower(_text(x)) for x in (needle, label, id_, file))
    return (
        F.when(l_ == n, 100).when(F.startswith(l_, n), 50).when(F.contains(l_, n), 25).when(F.contains(i, n), 15).when(F.contains(f, n), 10).otherwise(0)
    )


def is_hub_or_stub(id_: str | Column, label: str | Column, degree: str | Column) -> Column:
    """Module nodes, ``.name()`` labels, and ``name()`` labels hardly anything refers to."""
    call = F.endswith(_c(label), F.lit("()"))
    return (F.split_part(_c(id_), F.lit(":"), F.lit(2)) == "module") | (call & F.startswith(_c(label), F.lit("."))) | (call & (_c(degree) <= 1))


def import_segments(path: str | Column) -> Column:
    """Non-empty segments of an import path, cut at slashes, dots and double colons."""
    return F.filter(F.split(_c(path), r"/|::|\."), lambda x: x != "")


def is_version_tag(segment: str | Column) -> Column:
    return F.regexp_like(_c(segment), F.lit(r"^v[0-9]+\z"))


def last_import_segment(path: str | Column) -> Column:
    """Last segment, or the one before it where the last is a version tag."""
    s = import_segments(path)
    last = F.element_at(s, -1)
    return F.when(F.size(s) == 0, "").when(is_version_tag(last) & (F.size(s) > 1), F.element_at(s, -2)).otherwise(last)


def first_import_segment(path: str | Column) -> Column:
    s = import_segments(path)
    return F.when(F.size(s) == 0, "").otherwise(F.element_at(s, 1))


def suffix_overlap(a: str | Column, b: str | Column) -> Column:
    """Length of the common run of elements at the ends of two arrays."""
    pairs = F.arrays_zip(F.reverse(_c(a)).alias("x"), F.reverse(_c(b)).alias("y"))
    step = lambda acc, p: F.struct(
        (acc["n"] + F.when(acc["go"] & F.coalesce(p["0"] == p["1"], F.lit(False)), 1).otherwise(0)).alias("n"),
        (acc["go"] & F.coalesce(p["0"] == p["1"], F.lit(False))).alias("go"),
    )
    zipped = F.transform(pairs, lambda p: F.struct(p["x"].alias("0"), p["y"].alias("1")))
    return F.aggregate(zipped, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), step, lambda acc: acc["n"])


def tokenize(c: str | Column, least: int = 3) -> Column:
    return F.filter(F.split(F.lower(_text(c)), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= least)


def question_terms(c: str | Column) -> Column:
    return F.filter(F.split(F.lower(_text(c)), r"\s+"), lambda t: F.octet_length(t) > 2)


def estimate_tokens(c: str | Column, per_token: int = 4) -> Column:
    return F.greatest(F.lit(1), F.floor(F.octet_length(_text(c)) / per_token).cast("int"))


def round_one(c: str | Column) -> Column:
    """One decimal, half to even in binary arithmetic."""
    return F.rint(_c(c) * 10) / 10


def approx_input_tokens(size: str | Column) -> Column:
    return F.floor((_c(size) + 2) / 3).cast("bigint")


def approx_output_tokens(tokens: str | Column, cap: int = 4096) -> Column:
    return F.greatest(F.least(F.floor(_c(tokens) / 8).cast("bigint"), F.lit(cap).cast("bigint")), F.lit(64).cast("bigint"))


def extract_json(c: str | Column) -> Column:
    """From the first opening to the last closing brace."""
    return F.regexp_extract(_text(c), r"(?s)\{.*\}", 0)


def community_hue(c: str | Column) -> Column:
    """Hue of a community: polynomial hash of its bytes, base 131, modulo 2^32, modulo 360."""
    code = F.encode(_text(c), "utf-8")
    byte = lambda i: F.conv(F.hex(F.substring(code, i, F.lit(1))), 16, 10).cast("bigint")
    n = F.octet_length(_text(c))
    h = F.aggregate(
        F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
        F.lit(0).cast("bigint"),
        lambda acc, i: (acc * 131 + byte(i)) % F.lit(1 << 32),
    )
    return (h % 360).cast("int")


def slugify(c: str | Column) -> Column:
    """Lower case, everything but a-z and 0-9 as single hyphens, none at the end."""
    return F.regexp_replace(F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]+", "-"), r"-\z", "")


def quote_cypher(c: str | Column) -> Column:
    """A single-quoted string literal."""
    s = _text(c)
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.concat(F.lit("'"), s, F.lit("'"))


def cypher_relation(c: str | Column) -> Column:
    """Relation as a relationship type: upper case, other characters as underscores, RELATED if nothing is left."""
    t = F.regexp_replace(F.upper(_text(c)), "[^A-Z0-9_]", "_")
    return F.when(t == "", "RELATED").when(F.regexp_like(t, F.lit("^[0-9]")), F.concat(F.lit("_"), t)).otherwise(t)


def escape_xml(c: str | Column) -> Column:
    s = F.regexp_replace(_text(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def repo_tag_ok(c: str | Column) -> Column:
    t = _text(c)
    return ~(t.isin("", ".", "..") | F.contains(t, F.lit("/")) | F.contains(t, F.lit("\\")) | F.contains(t, F.lit("::")))


def cache_key(parts: list[Column]) -> Column:
    """SHA-256 over length-prefixed parts."""
    framed = [F.concat(F.octet_length(_text(p)).cast("string"), F.lit(":"), _text(p)) for p in parts]
    return F.sha2(F.concat(*framed), 256)


def strip_frontmatter(c: str | Column) -> Column:
    return F.regexp_replace(_text(c), r"(?s)\A---\r?\n.*?\n---\r?\n", "")


def trim_float(c: str | Column) -> Column:
    """One decimal, without it where it is zero: 10.0 is 10, 2.25 is 2.2 (half to even)."""
    return F.regexp_replace(round_one(c).cast("decimal(38,1)").cast("string"), r"\.0\z", "")


def commas(c: str | Column) -> Column:
    """A whole number with its digits in groups of three."""
    return F.format_number(_c(c).cast("bigint"), 0)


def truncate(c: str | Column, n: int) -> Column:
    """The first ``n`` characters; '' for n <= 0."""
    return F.substring(_c(c), 1, max(0, n))


def derive_seed(members: str | Column) -> Column:
    """A 64-bit seed from an array of strings in any order: FNV-1a over the sorted members, each closed by a zero byte."""

    @F.pandas_udf("bigint")
    def seed(groups: pd.Series) -> pd.Series:
        def one(names) -> int:
            h = 0xCBF29CE484222325
            for byte in b"".join(x.encode() + b"\0" for x in sorted(names, key=str.encode)):
                h = ((h ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
            return h - (1 << 64) if h >> 63 else h

        return pd.Series([one(g) if g is not None else None for g in groups], dtype="Int64")

    return seed(_c(members))
