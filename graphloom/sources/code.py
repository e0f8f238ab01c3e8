"""Code extraction: source files to nodes and edges.

Python is parsed; other languages go through one scanner that blanks comments and strings, finds declarations, imports
and bases by per-language patterns, and attributes calls to the innermost enclosing function by braces, ``end`` keywords
or indentation. One file is one row of work; files are extracted independently in ``mapInPandas``.
"""

from __future__ import annotations

import ast
import os
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import Graph, graph
from graphloom.plans.spread import spread

_ID = r"[A-Za-z_][A-Za-z0-9_]*"


@dataclass(frozen=True)
class Language:
    """How one language is scanned. Patterns are matched on text whose comments and strings are blanked, but for
    ``imports``, which see the strings. ``scope``: braces, end (keyword-closed) or indent."""

    tag: str
    extensions: tuple[str, ...]
    declarations: tuple[tuple[str, str], ...]
    imports: tuple[str, ...] = ()
    bases: tuple[tuple[str, str], ...] = ()
    line_comment: tuple[str, ...] = ("//",)
    block_comment: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    quotes: str = "\"'`"
    scope: str = "braces"
    calls: str | None = rf"(?<![A-Za-z0-9_.:>])((?:{_ID}(?:\.|::|->))*)({_ID})\s*\("
    package: str | None = None
    openers: str = ""
    functions: tuple[str, ...] = ("function", "method", "constructor", "macro", "subroutine")


_JS_DECL = (
    ("class", rf"\bclass\s+(?P<name>{_ID})"),
    ("function", rf"\bfunction\s*\*?\s*(?P<name>{_ID})\s*[(<]"),
    ("function", rf"\b(?:const|let|var)\s+(?P<name>{_ID})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^()\n]*\)|{_ID})\s*(?::[^=\n]+)?=>"),
    ("method", rf"(?:^[ \t]+|[{{}};][ \t]*)(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b){_ID})\s*\([^()\n]*\)\s*(?::[^{{\n]+)?\{{"),
)
_JS_IMPORT = (r"\bimport\s+(?:[^'\";]*?\bfrom\s*)?['\"](?P<path>[^'\"]+)['\"]", r"\bexport\s+[^'\";]*?\bfrom\s*['\"](?P<path>[^'\"]+)['\"]", r"\brequire\(\s*['\"](?P<path>[^'\"]+)['\"]\s*\)")
_HASH = {"line_comment": ("#",), "block_comment": ()}

LANGUAGES = (
    Language(
        "go", (".go",),
        (("type", rf"\btype\s+(?P<name>{_ID})\s+"), ("method", rf"\bfunc\s*\(\s*(?:{_ID}\s+)?\*?(?P<owner>{_ID})[^)]*\)\s*(?P<name>{_ID})\s*[(\[]"), ("function", rf"^func\s+(?P<name>{_ID})\s*[(\[]"), ("const", rf"^const\s+(?P<name>{_ID})\b"), ("var", rf"^var\s+(?P<name>(?!_\b){_ID})\b")),
        (r"^\s*import\s+(?:[\w.]+\s+)?\"(?P<path>[^\"]+)\"", r"^\s+(?:[\w.]+\s+)?\"(?P<path>[^\"\s]+)\"\s*$"), package=rf"^package\s+(?P<name>{_ID})",
    ),
    Language("js", (".js", ".jsx", ".mjs", ".cjs"), _JS_DECL, _JS_IMPORT, (("inherits", rf"\bclass\s+(?P<name>{_ID})\s+extends\s+(?P<bases>[\w.]+)"),)),
    Language(
        "ts", (".ts", ".tsx"), (*_JS_DECL, ("interface", rf"\binterface\s+(?P<name>{_ID})"), ("type", rf"\btype\s+(?P<name>{_ID})\s*(?:<[^=\n]*>)?\s*=")), _JS_IMPORT,
        (("inherits", rf"\b(?:class|interface)\s+(?P<name>{_ID})(?:<[^{{]*?>)?\s+extends\s+(?P<bases>[\w., <>]+?)(?=\s+implements|\s*\{{)"), ("implements", rf"\bclass\s+(?P<name>{_ID})[^{{]*?\bimplements\s+(?P<bases>[\w., <>]+?)\s*\{{")),
    ),
    Language(
        "java", (".java",), (("class", rf"\b(?:class|record)\s+(?P<name>{_ID})"), ("interface", rf"\binterface\s+(?P<name>{_ID})"), ("enum", rf"\benum\s+(?P<name>{_ID})"), ("method", rf"^[ \t]+(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>\n]+>\s*)?[\w.<>\[\], ?]+\s+(?P<name>(?!if\b|for\b|while\b|switch\b){_ID})\s*\([^()\n;]*\)\s*(?:throws [\w., ]+)?\s*\{{")),
        (r"^\s*import\s+(?:static\s+)?(?P<path>[\w.]+(?:\.\*)?)\s*;",), (("inherits", rf"\bclass\s+(?P<name>{_ID})(?:<[^{{]*?>)?\s+extends\s+(?P<bases>[\w.]+)"), ("implements", rf"\b(?:class|enum|record)\s+(?P<name>{_ID})[^{{]*?\bimplements\s+(?P<bases>[\w., <>]+?)\s*\{{"), ("inherits", rf"\binterface\s+(?P<name>{_ID})(?:<[^{{]*?>)?\s+extends\s+(?P<bases>[\w., <>]+?)\s*\{{")),
    ),
    Language("c", (".c", ".h"), (("struct", rf"\bstruct\s+(?P<name>{_ID})\s*\{{"), ("function", rf"^(?!\s|#|typedef|return)[\w\s*]+?\b(?P<name>(?!if\b|for\b|while\b|switch\b){_ID})\s*\([^;{{]*\)\s*\{{")), (r"^\s*#\s*include\s*[<\"](?P<path>[^>\"]+)[>\"]",), calls=None),
    Language("cpp", (".cpp", ".cc", ".cxx", ".hpp", ".hxx", ".hh"), (("namespace", rf"\bnamespace\s+(?P<name>{_ID})\s*\{{"), ("class", rf"\bclass\s+(?P<name>{_ID})\s*(?:final\s*)?[:{{]"), ("struct", rf"\bstruct\s+(?P<name>{_ID})\s*[:{{]"), ("function", rf"^[ \t]*(?!return|else|#)[\w:<>*&~,\s]+?\b(?:{_ID}::)*(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b){_ID})\s*\([^;{{}}]*\)\s*(?:const\s*)?(?:noexcept\s*)?\{{")), (r"^\s*#\s*include\s*[<\"](?P<path>[^>\"]+)[>\"]",), (("inherits", rf"\b(?:class|struct)\s+(?P<name>{_ID})\s*(?:final\s*)?:\s*(?P<bases>[^{{;]+)\{{"),), calls=None),
    Language("csharp", (".cs",), (("class", rf"\b(?:class|record)\s+(?P<name>{_ID})"), ("interface", rf"\binterface\s+(?P<name>{_ID})"), ("struct", rf"\bstruct\s+(?P<name>{_ID})"), ("enum", rf"\benum\s+(?P<name>{_ID})"), ("method", rf"^[ \t]+(?:(?:public|private|protected|internal|static|virtual|override|async|sealed|abstract)\s+)+[\w.<>\[\],? ]+\s+(?P<name>{_ID})\s*(?:<[^>\n]*>)?\([^;{{]*\)\s*(?:\{{|=>)"), ("constructor", rf"^[ \t]+(?:public|private|protected|internal)\s+(?P<name>{_ID})\s*\([^;{{]*\)\s*(?::[^{{]*)?\{{")), (r"^\s*using\s+(?:static\s+)?(?P<path>[\w.]+)\s*;",), (("inherits", rf"\b(?:class|interface|struct|record)\s+(?P<name>{_ID})(?:<[^{{]*?>)?\s*:\s*(?P<bases>[\w., <>]+?)\s*\{{"),)),
    Language("rust", (".rs",), (("function", rf"\bfn\s+(?P<name>{_ID})\s*[(<]"), ("struct", rf"\bstruct\s+(?P<name>{_ID})"), ("enum", rf"\benum\s+(?P<name>{_ID})"), ("trait", rf"\btrait\s+(?P<name>{_ID})"), ("mod", rf"\bmod\s+(?P<name>{_ID})")), (r"^\s*(?:pub\s+)?use\s+(?P<path>[^;]+);",), (("implements", rf"\bimpl(?:<[^>]*>)?\s+(?P<bases>[\w:]+)(?:<[^>]*>)?\s+for\s+(?P<name>{_ID})"),), calls=rf"((?:{_ID}(?:\.|::))*)({_ID})!?\s*\(", quotes='"'),
    Language("ruby", (".rb",), (("module", rf"^\s*module\s+(?P<name>[\w:]+)"), ("class", rf"^\s*class\s+(?P<name>[A-Z][\w:]*)"), ("method", r"^\s*def\s+(?:self\.)?(?P<name>[\w?!]+)")), (r"^\s*require(?:_relative)?\s*\(?\s*['\"](?P<path>[^'\"]+)",), (("inherits", r"^\s*class\s+(?P<name>[A-Z][\w:]*)\s*<\s*(?P<bases>[\w:]+)"),), scope="end", openers=r"\b(?:module|class|def|do|begin|case)\b|^\s*(?:if|unless|while|until|for)\b", **_HASH),
    Language("kotlin", (".kt", ".kts"), (("class", rf"\b(?:class|interface)\s+(?P<name>{_ID})"), ("object", rf"\bobject\s+(?P<name>{_ID})"), ("function", rf"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.<>?]+\.)?(?P<name>{_ID})\s*\(")), (r"^\s*import\s+(?P<path>[\w.*]+)",), (("inherits", rf"\b(?:class|interface|object)\s+(?P<name>{_ID})(?:<[^:{{]*>)?(?:\s*\([^)]*\))?\s*:\s*(?P<bases>[^{{\n]+)"),)),
    Language("scala", (".scala", ".sc"), (("class", rf"\bclass\s+(?P<name>{_ID})"), ("object", rf"\bobject\s+(?P<name>{_ID})"), ("trait", rf"\btrait\s+(?P<name>{_ID})"), ("function", rf"\bdef\s+(?P<name>{_ID})")), (r"^\s*import\s+(?P<path>[^\n;]+)",), (("inherits", rf"\b(?:class|object|trait)\s+(?P<name>{_ID})[^{{\n]*?\bextends\s+(?P<bases>[\w.]+(?:\s+with\s+[\w.]+)*)"),)),
    Language("php", (".php",), (("class", rf"\bclass\s+(?P<name>{_ID})"), ("interface", rf"\binterface\s+(?P<name>{_ID})"), ("trait", rf"\btrait\s+(?P<name>{_ID})"), ("enum", rf"\benum\s+(?P<name>{_ID})"), ("function", rf"\bfunction\s+&?(?P<name>{_ID})\s*\(")), (r"^\s*use\s+(?:function\s+|const\s+)?(?P<path>[\w\\{}, ]+)\s*;", r"\b(?:require|include)(?:_once)?\s*\(?\s*['\"](?P<path>[^'\"]+)"), (("inherits", rf"\bclass\s+(?P<name>{_ID})\s+extends\s+(?P<bases>[\w\\]+)"), ("implements", rf"\bclass\s+(?P<name>{_ID})[^{{]*?\bimplements\s+(?P<bases>[\w\\, ]+?)\s*\{{")), line_comment=("//", "#"), calls=rf"((?:\$?{_ID}(?:->|::))*)({_ID})\s*\("),
    Language("lua", (".lua",), (("function", r"\bfunction\s+(?:[\w]+[.:])*(?P<name>\w+)\s*\("), ("function", rf"\blocal\s+(?P<name>{_ID})\s*=\s*function\b")), (r"\brequire\s*\(?\s*['\"](?P<path>[^'\"]+)",), scope="end", openers=r"\b(?:function|do|then|repeat)\b", line_comment=("--",), block_comment=(("--[[", "]]"),)),
    Language("zig", (".zig",), (("function", rf"\bfn\s+(?P<name>{_ID})\s*\("), ("struct", rf"\bconst\s+(?P<name>{_ID})\s*=\s*(?:packed\s+|extern\s+)?struct\b"), ("enum", rf"\bconst\s+(?P<name>{_ID})\s*=\s*enum\b"), ("union", rf"\bconst\s+(?P<name>{_ID})\s*=\s*union\b")), (r"@import\(\s*\"(?P<path>[^\"]+)\"\s*\)",), block_comment=(), quotes='"'),
    Language("julia", (".jl",), (("module", rf"^\s*module\s+(?P<name>{_ID})"), ("function", rf"^\s*function\s+(?:[\w.]+\.)?(?P<name>[\w!]+)"), ("function", r"^(?P<name>[A-Za-z_][\w!]*)\([^)\n]*\)\s*=(?!=)"), ("struct", rf"\bstruct\s+(?P<name>{_ID})")), (r"^\s*(?:using|import)\s+(?P<path>[\w., :]+)",), scope="end", openers=r"\b(?:module|function|struct|if|for|while|begin|let|try|do|macro|quote)\b", line_comment=("#",), block_comment=(("#=", "=#"),), quotes='"'),
    Language("bash", (".sh", ".bash"), (("function", r"^\s*(?:function\s+)?(?P<name>[\w-]+)\s*\(\)\s*\{"), ("function", r"^\s*function\s+(?P<name>[\w-]+)\s*\{")), (r"^\s*(?:source|\.)\s+['\"]?(?P<path>[^\s'\"]+)",), calls=None, **_HASH),
    Language("haskell", (".hs",), (("function", r"^(?P<name>[a-z_][\w']*)\s*::"),), (r"^import\s+(?:qualified\s+)?(?P<path>[\w.]+)",), scope="indent", line_comment=("--",), block_comment=(("{-", "-}"),), quotes='"', calls=r"(?:=|\$|\(|<-|->)\s*()([a-z_][\w']*)\s+[\w(\"\[]", package=r"^module\s+(?P<name>[\w.]+)"),
    Language("ocaml", (".ml", ".mli"), (("module", r"^\s*module\s+(?P<name>[A-Z]\w*)"), ("function", r"^\s*let\s+(?:rec\s+)?(?P<name>[a-z_][\w']*)\s+[\w(~?][^=\n]*=")), (r"^\s*open\s+(?P<path>[\w.]+)",), scope="indent", line_comment=(), block_comment=(("(*", "*)"),), quotes='"', calls=r"(?:=|\(|;|\|>|@@|in)\s*((?:[A-Z]\w*\.)*)([a-z_][\w']*)\s+[\w(\"\[~]"),
    Language("svelte", (".svelte",), (), _JS_IMPORT, calls=None),
    Language("fortran", (".f", ".f90", ".f95", ".f03", ".f08"), (("subroutine", r"(?i)^\s*(?:\w+\s+)*subroutine\s+(?P<name>\w+)"), ("function", r"(?i)^\s*(?!end\b)(?:[\w()*=]+\s+)*function\s+(?P<name>\w+)\s*\(")), (r"(?i)^\s*use\s*(?:,\s*\w+\s*)?(?:::)?\s*(?P<path>\w+)",), scope="end", openers=r"(?i)^\s*(?:(?!end)(?:\w+\s+)*(?:subroutine|function)\b|(?:module|program)\s+\w+|do\b|select\b|if\b.*\bthen\s*$)", line_comment=("!",), block_comment=(), calls=r"(?i)\bcall\s+()(\w+)", package=r"(?i)^\s*(?:module|program)\s+(?P<name>\w+)"),
    Language("elixir", (".ex", ".exs"), (("function", r"^\s*defp?\s+(?P<name>[\w?!]+)"), ("macro", r"^\s*defmacrop?\s+(?P<name>[\w?!]+)")), (r"^\s*(?:alias|import|require|use)\s+(?P<path>[\w.{}, ]+)",), scope="end", openers=r"\b(?:do|fn)\b(?!:)", package=r"^\s*defmodule\s+(?P<name>[\w.]+)", calls=r"((?:[\w]+\.)*)([a-z_][\w?!]*)\(", **_HASH),
    Language("dart", (".dart",), (("class", rf"\bclass\s+(?P<name>{_ID})"), ("mixin", rf"\bmixin\s+(?P<name>{_ID})"), ("extension", rf"\bextension\s+(?P<name>{_ID})\s+on\b"), ("enum", rf"\benum\s+(?P<name>{_ID})"), ("method", rf"^[ \t]+(?:static\s+|@override\s+|final\s+)*[\w<>?,\[\] ]+\s+(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b){_ID})\s*\([^;{{]*\)\s*(?:async\s*)?(?:\{{|=>)"), ("function", rf"^[\w<>?,\[\] ]+\s+(?P<name>{_ID})\s*\([^;{{]*\)\s*(?:async\s*)?(?:\{{|=>)")), (r"^\s*(?:import|export)\s+['\"](?P<path>[^'\"]+)",), (("inherits", rf"\bclass\s+(?P<name>{_ID})(?:<[^{{]*?>)?\s+extends\s+(?P<bases>[\w<>]+)"), ("implements", rf"\bclass\s+(?P<name>{_ID})[^{{]*?\bimplements\s+(?P<bases>[\w., <>]+?)\s*\{{")), calls=None),
    Language("swift", (".swift",), (("class", rf"\b(?:class|struct|enum|actor|extension)\s+(?P<name>(?!func\b|var\b){_ID})"), ("protocol", rf"\bprotocol\s+(?P<name>{_ID})"), ("function", rf"\bfunc\s+(?P<name>{_ID})\s*[(<]")), (r"^\s*import\s+(?P<path>[\w.]+)",), (("inherits", rf"\b(?:class|struct|enum|protocol|actor|extension)\s+(?P<name>{_ID})(?:<[^{{]*?>)?\s*:\s*(?P<bases>[\w., <>]+?)\s*\{{"),), quotes='"'),
    Language("r", (".r", ".R"), (("function", r"(?P<name>[\w.]+)\s*(?:<-|=)\s*function\s*\("),), (r"\b(?:library|require)\(\s*['\"]?(?P<path>[\w.]+)",), calls=r"((?:[\w.]+::)*)([A-Za-z_.][\w.]*)\s*\(", **_HASH),
    Language("erlang", (".erl", ".hrl"), (("function", r"^(?P<name>[a-z]\w*)\s*\([^\n]*?\)\s*(?:when\b[^\n]*)?->"),), (r"^-import\(\s*(?P<path>\w+)",), scope="indent", line_comment=("%",), block_comment=(), quotes='"', calls=r"((?:\w+:)*)([a-z]\w*)\s*\(", package=r"^-module\(\s*(?P<name>\w+)"),
)
# Words before a parenthesis that are no calls.
NOT_CALLS = frozenset("if for while switch catch return function func fn def when match elif else and or not in is new typeof sizeof await yield throw assert with lambda until unless do case select super class struct enum interface import require library".split())
BY_EXTENSION = {e: x for x in LANGUAGES for e in x.extensions}
EXTENSIONS = frozenset([*BY_EXTENSION, ".py", ".yaml", ".yml", ".toml"])


def simple_type(name: str) -> str:
    """Bare name of a base: generics and arguments cut, then the last segment."""
    return re.split(r"[<(\[]", name.strip())[0].strip().rpartition("::")[2].rpartition(".")[2].rpartition("\\")[2]


def blank(text: str, lang: Language, keep_strings: bool = False) -> str:
    """``text`` with comments (and the insides of strings) as blanks, line and column positions unchanged."""
    parts = [re.escape(a) + r"[\s\S]*?(?:" + re.escape(b) + r"|\Z)" for a, b in lang.block_comment] + [re.escape(c) + r"[^\n]*" for c in lang.line_comment]
    strings = [f"{q}(?:[^{q}\\\\\n]|\\\\[\\s\\S])*{q}" if q != "`" else r"`[^`]*`" for q in lang.quotes]
    finder = re.compile("|".join([f"(?P<s>{'|'.join(strings)})", *parts]) if strings else "|".join(parts) or r"(?!)")
    wipe = lambda s: re.sub(r"[^\n]", " ", s)

    def replace(m: re.Match) -> str:
        s = m.group()
        if "s" in m.groupdict() and m.group("s") is not None:
            return s if keep_strings else s[0] + wipe(s[1:-1]) + s[-1]
        return wipe(s)

    return finder.sub(replace, text)


@dataclass
class Extraction:
    """Nodes and edges of one file, first write per key."""

    lang: str
    path: str
    nodes: dict[str, tuple] = field(default_factory=dict)
    edges: dict[tuple, int] = field(default_factory=dict)

    @property
    def module(self) -> str:
        return f"{self.lang}:module:{self.path}"

    def node(self, id_: str, label: str, line: int | None = None, col: int = 0, file: bool = True) -> str:
        self.nodes.setdefault(id_, (id_, label, self.path if file else "", f"{line + 1}:{col + 1}" if line is not None else "", "code" if file else ""))
        return id_

    def declare(self, kind: str, name: str, parent: str, line: int, col: int, owner: str = "") -> str:
        id_ = self.node(f"{self.lang}:{kind}:{self.path}:{owner + '.' if owner else ''}{name}", name, line, col)
        self.edge(parent, id_, "contains")
        return id_

    def symbol(self, kind: str, name: str) -> str:
        return self.node(f"{self.lang}:{kind}:{name}", name, file=False)

    def edge(self, a: str, b: str, relation: str, confidence: int = 0) -> None:
        self.edges.setdefault((a, b, relation), confidence)


def _ends(code: str, lang: Language, starts: list[int], kinds: list[str]) -> list[int]:
    """Where the scope of each declaration ends."""
    out = []
    if lang.scope == "braces":
        close, stack, opens = {}, [], []
        for m in re.finditer(r"[{}]", code):
            if m.group() == "{":
                stack.append(m.start())
                opens.append(m.start())
            elif stack:
                close[stack.pop()] = m.start()
        stops = [m.start() for m in re.finditer(";", code)]
        for s, kind in zip(starts, kinds):
            i, j = bisect_left(opens, s), bisect_left(stops, s)
            o, stop = opens[i] if i < len(opens) else len(code), stops[j] if j < len(stops) else len(code)
            line = code.find("\n", s)
            line = len(code) if line < 0 else line
            if stop < o or (kind in ("const", "var", "type", "import") and o > line):
                out.append(min(stop, line) if kind in ("const", "var", "type") else stop)
            else:
                out.append(close.get(o, len(code)))
    elif lang.scope == "end":
        words = sorted([(m.start(), 1) for m in re.finditer(lang.openers, code, re.M)] + [(m.start(), -1) for m in re.finditer(r"(?i)\bend\w*\b", code)])
        for s in starts:
            line = code.rfind("\n", 0, s) + 1
            depth = 0
            end = len(code)
            for at, step in words:
                if at < line:
                    continue
                depth += step
                if depth <= 0 and step < 0:
                    end = at
                    break
            out.append(end)
    else:
        out = [*starts[1:], len(code)]
    return out


def scan(path: str, text: str, lang: Language) -> Extraction:
    """Extract one file of a scanned language."""
    x = Extraction(lang.tag, path)
    code, seen = blank(text, lang), blank(text, lang, keep_strings=True)
    lines = [0, *(m.end() for m in re.finditer("\n", code))]

    def at(pos: int) -> tuple[int, int]:
        row = bisect_right(lines, pos) - 1
        return row, pos - lines[row]

    named = re.search(lang.package, code, re.M) if lang.package else None
    x.node(x.module, named["name"] if named else os.path.basename(path))
    found: dict[int, tuple[str, str, str, int]] = {}
    for kind, pattern in lang.declarations:
        for m in re.finditer(pattern, code, re.M):
            owner = m.groupdict().get("owner") or ""
            found.setdefault(m.start("name"), (kind, m["name"], owner, m.start()))
    order = sorted(found)
    ends = _ends(code, lang, [found[p][3] for p in order], [found[p][0] for p in order])
    open_: list[tuple[int, str, str]] = []
    spans = []
    for pos, end in zip(order, ends):
        kind, name, owner, _ = found[pos]
        while open_ and open_[-1][0] <= pos:
            open_.pop()
        parent, parent_kind = (open_[-1][1], open_[-1][2]) if open_ else (x.module, "module")
        if kind == "function" and parent_kind in ("class", "object", "trait", "struct", "interface", "protocol") and lang.tag not in ("zig",):
            kind = "method" if lang.tag == "php" else kind
        id_ = x.declare(kind, name, x.module if owner else parent, *at(pos), owner)
        if owner:
            x.edge(id_, x.symbol("typeref", owner), "method_of")
        open_.append((end, id_, kind))
        if kind in lang.functions:
            spans.append((pos, end, id_, name))
    if lang.tag == "go":
        for pos, end in zip(order, ends):
            if found[pos][0] == "type":
                _go_members(x, code, pos, end, found[pos][1], at)
    for pattern in lang.imports:
        for m in re.finditer(pattern, seen, re.M):
            for p in import_paths(m["path"], lang.tag):
                x.edge(x.module, x.symbol("import", p), "imports")
    for relation, pattern in lang.bases:
        for m in re.finditer(pattern, code, re.M):
            own = next((n for n in x.nodes if n.endswith(f"{path}:{m['name']}")), None) or x.symbol("typeref", m["name"])
            for base in re.split(r",|\bwith\b", re.sub(r"<[^<>]*>|\([^()]*\)|\b(?:public|private|protected|virtual)\b", "", m["bases"])):
                if (b := simple_type(base)) and re.match(r"^[A-Za-z_]\w*$", b):
                    x.edge(own, x.symbol("typeref", b), relation)
    if lang.calls:
        declared = set(order)
        for m in re.finditer(lang.calls, code, re.M):
            name = m.group(2)
            if name in NOT_CALLS or m.start(2) in declared:
                continue
            inner = [s for s in spans if s[0] < m.start(2) < s[1]]
            x.edge(max(inner)[2] if inner else x.module, x.symbol("call", name), "calls")
    return x


def _go_members(x: Extraction, code: str, pos: int, end: int, name: str, at) -> None:
    """Fields and embedded types of a struct, methods and embedded types of an interface: what stands at depth one."""
    body = re.compile(rf"{name}\s*(?:\[[^\]]*\])?\s*(struct|interface)\s*\{{").match(code, pos)
    if not body:
        return
    own, depth, start = f"go:type:{x.path}:{name}", 0, body.end()
    pieces = []
    for i in range(body.end(), min(end, len(code))):
        c = code[i]
        depth += c in "{(["
        depth -= c in "})]"
        if c in "\n;" and depth == 0:
            pieces.append((start, code[start:i]))
            start = i + 1
    pieces.append((start, code[start : min(end, len(code))]))
    for offset, piece in pieces:
        place = at(offset + len(piece) - len(piece.lstrip()))
        if base := re.match(rf"\s*\*?((?:{_ID}\.)?{_ID})(?:\[[^\n]*\])?\s*(?:[\"`].*)?$", piece):
            x.edge(own, x.symbol("typeref", simple_type(base[1])), "embeds")
        elif body[1] == "interface":
            if m := re.match(rf"\s*({_ID})\s*\(", piece):
                x.declare("method", m[1], own, *place, name)
        elif m := re.match(rf"\s*({_ID}(?:\s*,\s*{_ID})*)\s+\S", piece):
            for field_ in re.split(r"\s*,\s*", m[1]):
                x.declare("field", field_, own, *place, name)


def declared_functions(path: str, text: str, tag: str) -> dict[int, str]:
    """Row -> name of the functions a file of language ``tag`` declares, as the extraction finds them."""
    if tag == "py":
        return {int(n[3].partition(":")[0]) - 1: n[1] for i, n in parse_python(path, text).nodes.items() if i.startswith("py:function:") and n[1] != "<anonymous>"}
    lang = next((x for x in LANGUAGES if x.tag == tag), None)
    if lang is None:
        return {}
    code = blank(text, lang)
    lines = [0, *(m.end() for m in re.finditer("\n", code))]
    wanted = ("function", "method") if tag == "go" else ("function",)
    return {bisect_right(lines, m.start("name")) - 1: m["name"] for kind, pattern in lang.declarations if kind in wanted for m in re.finditer(pattern, code, re.M)}


def import_paths(raw: str, tag: str) -> list[str]:
    """The paths one import statement names, groups opened."""
    raw = re.sub(r"\s+as\s+\w+", "", " ".join(raw.split()))
    m = re.match(r"^(.*?)\{(.*)\}$", raw)
    if m:
        return [p for part in m.group(2).split(",") if (p := (m.group(1) + part.split("=>")[0].strip()).strip())]
    parts = raw.split(",") if tag in ("julia", "php") else [raw.split(",")[0] if tag == "elixir" else raw]
    return [p.strip().rstrip(":") for p in parts if p.strip()]


def parse_python(path: str, text: str) -> Extraction:
    """Extract one Python file from its syntax tree; a file that does not parse is a bare module."""
    x = Extraction("py", path)
    x.node(x.module, os.path.basename(path))
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return x
    todo = [(tree, x.module)]
    while todo:
        node, scope = todo.pop()
        for child in ast.iter_child_nodes(node):
            inner = scope
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                inner = x.declare("function", child.name, scope, child.lineno - 1, child.col_offset)
            elif isinstance(child, ast.ClassDef):
                inner = x.declare("class", child.name, scope, child.lineno - 1, child.col_offset)
                for b in child.bases:
                    if name := simple_type(ast.unparse(b)):
                        x.edge(inner, x.symbol("typeref", name), "inherits")
            elif isinstance(child, ast.Lambda):
                inner = x.node(f"py:function:{path}:anon@{child.lineno - 1}:{child.col_offset}", "<anonymous>", child.lineno - 1, child.col_offset)
                x.edge(scope, inner, "contains")
            elif isinstance(child, ast.Import):
                for a in child.names:
                    x.edge(x.module, x.symbol("import", a.name), "imports")
            elif isinstance(child, ast.ImportFrom):
                base = "." * child.level + (child.module or "")
                x.edge(x.module, x.symbol("import", base), "imports")
                for a in child.names:
                    x.edge(x.module, x.symbol("import", f"{base}.{a.name}" if base else a.name), "imports")
            elif isinstance(child, ast.Call):
                f = child.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""
                if name:
                    x.edge(scope, x.symbol("call", name), "calls")
            todo.append((child, inner))
    return x


def parse_keys(path: str, text: str, tag: str) -> Extraction:
    """Top-level keys of YAML, top-level pairs and tables of TOML."""
    x = Extraction(tag, path)
    x.node(x.module, os.path.basename(path))
    pattern = r"^(?P<k>[A-Za-z0-9_.\"'/-]+)\s*:(?:\s|$)" if tag == "yaml" else r"^\s*\[\[?(?P<t>[^\]\n]+)\]\]?\s*(?:#.*)?$|^(?P<k>[A-Za-z0-9_.\"'-]+)\s*=" 
    in_table = False
    for row, line in enumerate(text.split("\n")):
        m = re.match(pattern, line)
        if not m:
            continue
        table_ = m.groupdict().get("t")
        if table_:
            in_table = True
        elif in_table:
            continue
        name = (table_ or m["k"]).strip().strip("\"'")
        x.declare("key", name, x.module, row, 0)
    return x


def extract_text(path: str, text: str) -> Extraction | None:
    """Nodes and edges of one source file by its extension; None if the extension is not code."""
    ext = os.path.splitext(path)[1]
    if ext == ".py":
        return parse_python(path, text)
    if ext in (".yaml", ".yml"):
        return parse_keys(path, text, "yaml")
    if ext == ".toml":
        return parse_keys(path, text, "toml")
    lang = BY_EXTENSION.get(ext)
    return scan(path, text, lang) if lang else None


_ROW = "what string, id string, label string, sourcefile string, sourcelocation string, filetype string, source string, target string, relation string, confidence int"


def rows_of(extractions: Iterator[Extraction | None]) -> pd.DataFrame:
    names = [c.split()[0] for c in _ROW.split(", ")]
    rows = []
    for x in extractions:
        if x is not None:
            rows += [("node", *n, None, None, None, None) for n in x.nodes.values()]
            rows += [("edge", None, None, None, None, None, *k, c) for k, c in x.edges.items()]
    return pd.DataFrame(rows, columns=names)


def extract(files: DataFrame, extractor=extract_text) -> Graph:
    """Graph of all files (path, text); nodes without a file (imports, calls, type references) are shared between files.

    Null paths or texts give nothing. The first of several nodes of one id (by label, file) stays.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield rows_of(extractor(p, t) for p, t in zip(pdf["path"], pdf["text"]))

    rows = spread(files.select("path", "text").where("path is not null and text is not null")).mapInPandas(run, _ROW)
    nodes = rows.where("what = 'node'").groupBy("id").agg(F.min(F.struct("label", "sourcefile", "sourcelocation", "filetype")).alias("m")).select("id", "m.*")
    edges = rows.where("what = 'edge'").groupBy("source", "target", "relation").agg(F.min("confidence").alias("confidence"))
    return graph(nodes, edges)
