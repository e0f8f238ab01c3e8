"""Pages from the web: routing, readable Markdown, metadata, names of side files, and a guarded fetcher."""

from __future__ import annotations

import ipaddress
import socket
import urllib.error
import urllib.request
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Entities in the order they are decoded.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&mdash;", "—"), ("&ndash;", "–"))
# Elements dropped with all they hold.
CHROME = ("script", "style", "noscript", "nav", "footer", "aside", "header")


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


class _Reader(HTMLParser):
    """Collects a page's readable text as Markdown, the source ranges of its regions, and its social metadata."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.hidden: list[str] = []
        self.open: dict[str, list[int]] = {"article": [], "main": []}
        self.regions: dict[str, list[tuple[int, int]]] = {"article": [], "main": []}
        self.meta: dict[str, str] = {}
        self.source, self.starts = source, [0]
        for line in source.split("\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.feed(source)
        self.close()

    def _at(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def _say(self, text: str) -> None:
        if not self.hidden:
            self.out.append(text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "meta":
            named = dict(attrs)
            key, value = (named.get("property") or named.get("name") or "").lower(), " ".join((named.get("content") or "").splitlines()).strip()
            if key.startswith(("og:", "twitter:")) and value:
                self.meta.setdefault(key, value)
        if tag in CHROME:
            self.hidden.append(tag)
        elif tag in self.open:
            self.open[tag].append(self._at() + len(self.get_starttag_text()))
        elif tag == "p":
            self._say("\n\n")
        elif tag == "li":
            self._say("\n- ")
        elif tag == "br":
            self._say("\n")
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self._say("\n\n" + "#" * int(tag[1]) + " ")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in CHROME and tag not in self.open:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.hidden and tag == self.hidden[-1]:
            self.hidden.pop()
        elif tag in self.open and self.open[tag]:
            self.regions[tag].append((self.open[tag].pop(), self._at()))
        elif tag == "p" or (len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"):
            self._say("\n\n")

    def handle_data(self, data: str) -> None:
        self._say(data)

    def handle_entityref(self, name: str) -> None:
        self._say(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self._say(f"&#{name};")

    def markdown(self) -> str:
        text = "".join(self.out)
        for entity, char in ENTITIES:
            text = text.replace(entity, char)
        lines = [x if x.strip() else "" for x in text.split("\n")]
        kept = [x for i, x in enumerate(lines) if x or (i and lines[i - 1])]
        return "\n".join(kept).strip()

    def main_region(self) -> str | None:
        """Source of the largest article, or else of the largest main."""
        for tag in ("article", "main"):
            pieces = [self.source[a:b] for a, b in self.regions[tag]]
            if best := max(pieces, key=lambda x: len(x.encode()), default=""):
                return best
        return None


def page_markdown(page: str | None) -> str:
    """Readable text of a page: its largest article (else main) region without chrome; headings, paragraphs and list items
    as Markdown, other tags dropped, basic entities decoded last."""
    whole = _Reader(page or "")
    region = whole.main_region()
    return (whole if region is None else _Reader(region)).markdown()


@F.pandas_udf(StringType())
def _markdown(pages: pd.Series) -> pd.Series:
    return pages.map(page_markdown, na_action=None)


def html_to_markdown(page: str | Column) -> Column:
    """:func:`page_markdown` of a column of pages; '' for null."""
    return _markdown(_c(page))


def page_tags(page: str | None) -> dict[str, str]:
    """title, description, image and site_name of a page's og: metas, or of its twitter: metas where those are missing."""
    meta = _Reader(page or "").meta
    return {k: meta.get(f"og:{k}") or meta.get(f"twitter:{k}", "") if k != "site_name" else meta.get("og:site_name", "") for k in ("title", "description", "image", "site_name")}


@F.pandas_udf(StructType([StructField(k, StringType()) for k in ("title", "description", "image", "site_name")]))
def _tags(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([page_tags(p) for p in pages], columns=["title", "description", "image", "site_name"])


def og_tags(page: str | Column) -> Column:
    """Struct of :func:`page_tags`."""
    return _tags(_c(page))



def route(url: str | Column) -> Column:
    """How an address is taken in: github, arxiv, youtube, pdf, image or page."""
    u = F.lower(_c(url))
    path = F.regexp_extract(u, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    host = F.regexp_extract(u, r"^[a-z]+://([^/:?#]*)", 1)
    return (
        F.when(host.isin("github.com", "www.github.com"), "github")
        .when(host.isin("arxiv.org", "www.arxiv.org") & F.startswith(path, F.lit("/abs/")), "arxiv")
        .when(host.isin("youtube.com", "www.youtube.com", "m.youtube.com", "youtu.be"), "youtube")
        .when(F.endswith(path, F.lit(".pdf")), "pdf")
        .when(path.rlike(r"\.(png|jpe?g|gif|webp|svg)\z"), "image")
        .otherwise("page")
    )


def side_file(url: str | Column) -> Column:
    """File name of an ingested address: host and last path segment, at most 60 characters, and 16 digits of its hash."""
    u = _c(url)
    host = F.regexp_extract(u, r"^[A-Za-z]+://(?:[^/@]*@)?([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), r"/+\z", "")
    last = F.element_at(F.split(path, "/"), -1)
    stem = F.concat(host, F.lit("-"), F.when(last == "", host).otherwise(last))
    stem = F.regexp_replace(F.regexp_replace(F.replace(stem, F.lit("."), F.lit("-")), r"[^A-Za-z0-9_\-]+", "-"), r"^-+|-+\z", "")
    stem = F.substring(stem, 1, 60)
    return F.concat(F.when(stem == "", "url").otherwise(stem), F.lit("-"), F.substring(F.sha1(u), 1, 16), F.lit(".md"))


def allowed_host(host: str, allowlist: list[str] | None = None) -> bool:
    """Host is on the list (or below an entry), and no address of it is loopback, private or link-local."""
    if allowlist and not any(host == a or host.endswith("." + a) for a in allowlist):
        return False
    try:
        found = {x[4][0] for x in socket.getaddrinfo(host, None)}
    except OSError:
        return False
    return all(not (ip := ipaddress.ip_address(a.split("%")[0])).is_private and not ip.is_loopback and not ip.is_link_local for a in found)


def fetch(url: str, allowlist: list[str] | None = None, cap: int = 10 * 1024 * 1024, timeout: int = 30, redirects: int = 5) -> bytes:
    """Fetch an http(s) address, checking every hop's host; refuses other schemes, private hosts and oversized bodies."""

    class NoRedirect(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *args, **kwargs):
            return None

    opener = urllib.request.build_opener(NoRedirect)
    for _ in range(redirects + 1):
        parts = urlparse(url)
        if parts.scheme not in ("http", "https") or not parts.hostname or not allowed_host(parts.hostname, allowlist):
            raise ValueError(f"refused: {url}")
        try:
            with opener.open(url, timeout=timeout) as r:
                body = r.read(cap + 1)
        except urllib.error.HTTPError as e:
            if e.code in (301, 302, 303, 307, 308) and e.headers.get("Location"):
                url = urljoin(url, e.headers["Location"])
                continue
            raise
        if len(body) > cap:
            raise ValueError(f"larger than {cap} bytes: {url}")
        return body
    raise ValueError(f"too many redirects: {url}")
