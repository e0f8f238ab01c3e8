"""File discovery: listing with ignore rules, classification, and reading contents as rows."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE_CAP = 10 * 1024 * 1024
MINIFIED_LINE, MINIFIED_HEAD = 5000, 64 * 1024

# Extensions per file type.
CODE = (
    ".py .ts .js .jsx .tsx .mjs .cjs .go .rs .java .c .h .cpp .cc .cxx .hpp .hxx .hh .rb .kt .kts .scala .sc .php .lua .zig .jl "
    ".sh .bash .cs .hs .ml .mli .svelte .f .f90 .f95 .f03 .f08 .ex .exs .dart .swift .r .erl .ejs .groovy .gradle .luau .ps1 "
    ".m .mm .vue .v .sv .sql .toc .pas .pp .dpr .dpk .lpr .inc .dfm .lfm .lpk"
).split()
DOCUMENT = ".md .mdx .qmd .txt .rst .html .yaml .yml .gdoc .gsheet .gslides".split()
PAPER = [".pdf"]
IMAGE = ".png .jpg .jpeg .gif .webp .svg".split()
VIDEO = ".mp4 .mov .webm .mkv .avi .m4v .mp3 .wav .m4a .ogg".split()

# Names of files that hold secrets. \b parts ASCII words.
SENSITIVE = (
    r"(^|[\\/])\.(env|envrc)(\..*)?$",
    r"(?i)\.(pem|key|p12|pfx|cert|crt|der|p8)$",
    r"(?i)\b(credential|secret|passwd|password|token|private_key)s?\b",
    r"(id_rsa|id_dsa|id_ecdsa|id_ed25519)(\.pub)?$",
    r"(?i)(\.netrc|\.pgpass|\.htpasswd)$",
    r"(?i)(aws_credentials|gcloud_credentials|service.account)",
    r"(?i)(^|/)\.aws/(credentials|config)$",
    r"(?i)(^|/)\.kube/config$",
    r"(?i)(^|/)\.docker/config\.json$",
    r"(?i)(^|/)\.gnupg/",
    r"(?i)(^|/)\.(npmrc|pypirc|gem/credentials|cargo/credentials(\.toml)?)$",
    r"(?i)\.tfstate(\.backup)?$",
    r"(?i)\.tfvars(\.json)?$",
    r"(?i)firebase-adminsdk[^/]*\.json$",
    r"(?i)\b(api[-_]?key|access[-_]?token|client[-_]?secret)s?\b",
)
_ASCII_BOUND = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"


def _java(pattern: str) -> str:
    p = pattern.replace(r"\b", _ASCII_BOUND)
    return re.sub(r"\$$", r"\\z", p)


def extension(path: str | Column) -> Column:
    """From the last dot of the file name on, '' without one."""
    return F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"(\.[^./]*)\z", 1)


def classify(path: str | Column) -> Column:
    """code, document, paper, image, video or '' by lower-cased extension."""
    ext = F.lower(extension(path))
    out = F.lit("")
    for name, exts in (("video", VIDEO), ("image", IMAGE), ("paper", PAPER), ("document", DOCUMENT), ("code", CODE)):
        out = F.when(ext.isin(*exts), name).otherwise(out)
    return out


def is_sensitive(path: str | Column) -> Column:
    """Whether a path names a store of secrets, judged by the full path and by the file name."""
    p = F.replace(F.col(path) if isinstance(path, str) else path, F.lit("\\"), F.lit("/"))
    base = F.element_at(F.split(p, "/"), -1)
    hit = F.lit(False)
    for pattern in SENSITIVE:
        hit = hit | p.rlike(_java(pattern)) | base.rlike(_java(pattern))
    return hit


def is_minified(path: str | Column, content: str | Column) -> Column:
    """``.min.js`` and ``.min.css``, or a line of more than 5,000 bytes within the first 64 KiB of the binary content."""
    p, c = (F.col(x) if isinstance(x, str) else x for x in (path, content))
    head = F.decode(F.substring(c, 1, MINIFIED_HEAD), "ISO-8859-1")
    long_line = F.exists(F.split(head, "\n"), lambda x: F.length(x) > MINIFIED_LINE)
    return F.lower(p).rlike(r"\.min\.(js|css)\z") | F.coalesce(long_line, F.lit(False))


def ignore_regex(line: str) -> tuple[re.Pattern, bool] | None:
    """A line of an ignore file as (pattern over slash-separated relative paths, is negation); None for blank lines."""
    line = line.rstrip("\r\n")
    if not line.strip() or line.startswith("#"):
        return None
    line = re.sub(r"(?<!\\)\s+$", "", line)
    negate = line.startswith("!")
    line = line[1:] if negate else line
    line = line[1:] if line.startswith("\\") else line
    only_dir, line = line.endswith("/"), line.rstrip("/")
    anchored = "/" in line
    line = line.lstrip("/")
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.*", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and "]" in line[i + 2 :]:
            end = line.index("]", i + 2)
            body = line[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(line[i]), i + 1
    head = "" if anchored else "(?:.*/)?"
    tail = "/.*" if only_dir else "(?:/.*)?"
    return re.compile(f"^{head}{out}{tail}$"), negate


class IgnoreRules:
    """Ordered ignore patterns, the last match deciding."""

    def __init__(self, lines: list[str]):
        self.rules = [r for r in map(ignore_regex, lines) if r]
        self.may_prune = not any(negate for _, negate in self.rules)

    def ignored(self, relative: str, is_dir: bool = False) -> bool:
        hit = False
        for pattern, negate in self.rules:
            if pattern.match(relative + ("/" if is_dir else "")) or pattern.match(relative):
                hit = not negate
        return hit

    @classmethod
    def layered(cls, root: str, name: str) -> IgnoreRules:
        """Rules of all files called ``name`` from the repository's top down to ``root``, nearest last."""
        chain, at = [], os.path.abspath(root)
        while True:
            chain.append(at)
            if any(os.path.exists(os.path.join(at, m)) for m in (".git", ".hg", ".svn")) or os.path.dirname(at) == at:
                break
            at = os.path.dirname(at)
        if os.path.dirname(chain[-1]) == chain[-1] and len(chain) > 1:
            chain = chain[:1]
        lines: list[str] = []
        for d in reversed(chain):
            if os.path.isfile(p := os.path.join(d, name)):
                with open(p, encoding="utf-8", errors="replace") as f:
                    lines += f.read().split("\n")
        return cls(lines)


def list_files(root: str, extensions: set[str] | None = None, ignore_file: str = ".graphignore", include_file: str = ".graphinclude") -> list[str]:
    """Sorted absolute paths below ``root``.

    Dot files are skipped unless re-included; ignored subtrees are pruned only where no negation could bring a file
    back; links to directories are followed within the root, each directory once per branch; files beyond the size cap
    or outside the root are left out.
    """
    root = os.path.abspath(root)
    real_root = os.path.realpath(root)
    ignore, include = IgnoreRules.layered(root, ignore_file), IgnoreRules.layered(root, include_file)
    out = []

    def inside(p: str) -> bool:
        return p == real_root or p.startswith(real_root + os.sep)

    def walk(at: str, above: frozenset[str]) -> None:
        real = os.path.realpath(at)
        if real in above or not inside(real):
            return
        for name in sorted(os.listdir(at)):
            path = os.path.join(at, name)
            rel = os.path.relpath(path, root).replace(os.sep, "/")
            is_dir = os.path.isdir(path)
            hidden = name.startswith(".") and not (include.rules and include.ignored(rel, is_dir))
            if hidden or (ignore.ignored(rel, is_dir) and (not is_dir or ignore.may_prune)):
                continue
            if is_dir:
                walk(path, above | {real})
            elif os.path.isfile(path) and (extensions is None or os.path.splitext(name)[1] in extensions):
                target = os.path.realpath(path)
                if inside(target) and os.path.getsize(target) <= SIZE_CAP:
                    out.append(path)

    walk(root, frozenset())
    return sorted(out)


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, content`` of the listed files, read in the tasks; unreadable files have null content."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            contents = []
            for p in pdf["path"]:
                try:
                    with open(p, "rb") as f:
                        contents.append(f.read())
                except OSError:
                    contents.append(None)
            yield pd.DataFrame({"path": pdf["path"], "content": contents})

    df = spark.createDataFrame([(p,) for p in paths], "path string")
    return df.repartition(max(1, min(len(paths), spark.sparkContext.defaultParallelism))).mapInPandas(read, "path string, content binary")


def scan_tree(spark: SparkSession, root: str, extensions: set[str] | None = None) -> DataFrame:
    """``path, content, filetype`` of the files worth extracting: listed, not sensitive, not minified."""
    files = read_files(spark, list_files(root, extensions)).where(~is_sensitive("path"))
    return files.where("content is not null").where(~is_minified("path", "content")).withColumn("filetype", classify("path"))


def head_commit(directory: str) -> str:
    """First seven characters of the checked-out commit, '' if there is none."""
    at = os.path.abspath(directory)
    while not os.path.exists(os.path.join(at, ".git")):
        if os.path.dirname(at) == at:
            return ""
        at = os.path.dirname(at)
    git = os.path.join(at, ".git")
    if os.path.isfile(git):
        with open(git, encoding="utf-8") as f:
            git = os.path.join(at, f.read().partition(":")[2].strip())
    read = lambda p: open(p, encoding="utf-8").read().strip() if os.path.isfile(p) else ""  # noqa: E731, SIM115
    head = read(os.path.join(git, "HEAD"))
    if not head.startswith("ref:"):
        return head[:7]
    ref = head[4:].strip()
    common = read(os.path.join(git, "commondir"))
    for base in [git, *([os.path.normpath(os.path.join(git, common))] if common else [])]:
        if sha := read(os.path.join(base, ref)):
            return sha[:7]
        for line in read(os.path.join(base, "packed-refs")).split("\n"):
            if line.endswith(" " + ref):
                return line[:7]
    return ""
