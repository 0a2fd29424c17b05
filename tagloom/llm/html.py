"""Operator 2: main text of web pages, with site templates found by recurring element subtrees.

Pass one parses each page and hashes every block element, bottom up
from tag, class, id, own text and child hashes. Spark counts, per host, in how many different surroundings each hash occurs,
a surrounding being the longest other block of the page; subtrees that recur across many of them are template, copies of a page are not. Pass two parses again, drops
template subtrees together with elements that are never main text (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, reader comments), and joins the blocks left.
Inside an article element (hashed apart from what lies outside) the surroundings are the other blocks of the article, and a
template must also recur on a share of the host's pages, as short paragraphs of plain text recur by chance.
"""

from __future__ import annotations

import html
import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_NAMES = re.compile(r"[^a-z0-9]+")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements that are never main text.
_NEVER = {"head", "script", "style", "noscript", "template", "nav", "footer", "aside", "form", "button", "select", "option", "textarea", "title", "iframe", "svg", "canvas", "object", "dialog", "menu", "xmp", "noembed", "noframes", "math"}
#: Names in class, id or role that mark such elements anywhere, and those that mark them outside an article only.
_MARKED = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "sidebar", "comment", "comments", "disqus", "reply", "replies", "share", "sharing", "social", "related", "newsletter", "subscribe", "popup", "modal", "overlay", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "footer", "complementary", "contentinfo", "alert", "search"}
#: Class words that say something about the page around an element, not what the element is.
_STATES = ("has-", "with-", "without-", "no-", "is-", "js-")
_MARKED_OUTSIDE = {"header", "masthead", "topbar", "toolbar", "widget", "banner"}
#: A start tag closes an open element of these kinds first.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


class Page:
    """One parsed page: its blocks in order, each with the element subtrees that hold it."""

    __slots__ = ("blocks", "subtrees", "inside", "has_article", "has_main")

    def __init__(self, source: str | None):
        self.blocks: list[tuple[str, tuple[int, ...], bool, bool]] = []  # text, numbers of the holding subtrees, in article, in main
        self.subtrees: list[int] = []  # hash of each subtree by number, once closed
        self.inside: list[int] = []  # per subtree: the number, from 1, of the outermost article that it lies in; 0 outside
        self.has_article = self.has_main = False
        if source:
            self._parse(source)

    def _parse(self, s: str) -> None:
        stack: list[list] = []  # tag, never, in_article, in_main, number, hasher or None
        text: list[str] = []

        def flush() -> None:
            if text:
                joined = " ".join(html.unescape("".join(text)).split())
                text.clear()
                if joined:
                    top = stack[-1] if stack else None
                    outer = next((e for e in reversed(stack) if e[5] is not None), None)  # past inline elements left open
                    if outer is not None:
                        outer[5].update(joined)
                    if top is None or not top[1]:
                        self.blocks.append((joined, tuple(e[4] for e in stack if e[4] >= 0), bool(top and top[2]), bool(top and top[3])))

        def close(n: int) -> None:
            while len(stack) > n:
                if stack[-1][0] in _BLOCK:
                    flush()
                _, _, _, _, number, hasher = stack.pop()
                if hasher is not None:
                    self.subtrees[number] = hasher.intdigest()
                    outer = next((e for e in reversed(stack) if e[5] is not None), None)
                    if outer is not None:
                        outer[5].update(hasher.digest())

        at = articles = 0
        while (m := _TOKEN.search(s, at)) is not None:
            if m.start() > at:
                text.append(s[at : m.start()])
            at = m.end()
            tag = m.group(2)
            if tag is None:
                continue
            tag = tag.lower()
            block = tag in _BLOCK
            if m.group(1):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
                else:
                    if block:
                        flush()
                continue
            if tag == "br":
                text.append(" ")
                continue
            if block:
                flush()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] in _BLOCK:
                        break
            if tag in _CLOSES:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in _CLOSES[tag]:
                        close(k)
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table", "select"):
                        break
            if tag in _VOID or (m.group(3) or "").endswith("/") and not block:
                continue
            up = stack[-1] if stack else None
            in_article = tag == "article" or bool(up and up[2])
            in_main = tag == "main" or bool(up and up[3])
            never, names = bool(up and up[1]) or tag in _NEVER, ""
            if m.group(3):
                attributes = {a.lower(): v.strip("\"'").lower() for a, v in _ATTRIBUTE.findall(m.group(3))}
                names = f"{attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('role', '')}"
                if names != "  " and not never and tag not in ("body", "html", "article", "main") or tag == "article":
                    found = {n for word in names.split() if not word.startswith(_STATES) for n in _NAMES.split(word)}
                    never = never or bool(found & _MARKED) or not in_article and bool(found & _MARKED_OUTSIDE)
                never = never or "hidden" in attributes or attributes.get("aria-hidden") == "true"
            never = never or tag == "header" and not in_article
            if tag in _RAW:
                end = _RAW_END[tag].search(s, at)
                at = end.end() if end else len(s)
                continue
            if not never:
                self.has_article = self.has_article or tag == "article"
                self.has_main = self.has_main or tag == "main"
            if block and tag not in ("html", "body"):
                within = up is not None and up[2]  # an article itself is not within it
                articles += in_article and not within
                hasher = xxhash.xxh3_64(f"<{tag} {names}>" if not in_article else f"<in article {tag} {names}>")
                self.subtrees.append(0)
                self.inside.append(articles if in_article else 0)
                stack.append([tag, never, in_article, in_main, len(self.subtrees) - 1, hasher])
            else:
                stack.append([tag, never, in_article, in_main, -1, None])
        if at < len(s):
            text.append(s[at:])
        flush()
        close(0)

    def hashes(self) -> dict[int, int]:
        """Hash of each subtree -> hash of its surroundings, the longest other block of its article or, outside, of the page; 0 if there is none."""
        longest: dict[int, list[tuple[str, tuple[int, ...]]]] = {}  # of each article, its blocks from the longest
        for text, held, in_article, _ in self.blocks:
            longest.setdefault(0, []).append((text, held))
            if in_article:
                longest.setdefault(max(self.inside[k] for k in held), []).append((text, held))
        for blocks in longest.values():
            blocks.sort(key=lambda b: (-len(b[0]), b[0]))
        out: dict[int, int] = {}
        for k, h in enumerate(self.subtrees):
            other = next((t for t, held in longest.get(self.inside[k], ()) if k not in held), "")
            out.setdefault(_signed(h), _signed(xxhash.xxh3_64_intdigest(other)) if other else 0)
        return out

    def text(self, template: set[int]) -> str:
        """Main text: the articles if there are any, else the main element, else all; without template subtrees."""
        bad = {k for k, h in enumerate(self.subtrees) if _signed(h) in template} if template else set()
        kept = []
        for text, held, in_article, in_main in self.blocks:
            if self.has_article and not in_article or not self.has_article and self.has_main and not in_main:
                continue
            if bad and not bad.isdisjoint(held):
                continue
            kept.append(text)
        return " ".join(kept)


def host_of(url: str) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(F.col(url).cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)


def template_subtrees(pages: DataFrame, url_col: str = "url", html_col: str = "html", least_pages: int = 10, least_share: float = 0.2) -> DataFrame:
    """host, subtree, n_pages: subtrees in at least least_pages pages of a host; inside articles also in least_share of its pages.

    Pages in which a subtree has the same surroundings count as one; pages without any do not count.
    """

    def run(batch):
        hosts, hashes, around, within = [], [], [], []
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = {0: (None, False)}  # 0 stands for the page itself
            page = Page(source)
            inside = {_signed(h) for h, a in zip(page.subtrees, page.inside, strict=True) if a}
            own |= {h: (a, h in inside) for h, a in page.hashes().items() if h and a}
            hosts += [host] * len(own)
            hashes += own
            around += [a for a, _ in own.values()]
            within += [x for _, x in own.values()]
        return {"host": hosts, "subtree": hashes, "around": around, "within": within}

    rows = pages.select(host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("html"))
    each = map_batches(rows, run, "host string, subtree bigint, around bigint, within boolean").groupBy("host", "subtree", "around", "within").agg(F.count(F.lit(1)).alias("_n"))
    found = cut(each.groupBy("host", "subtree").agg(F.sum(F.when(F.col("around").isNull(), F.col("_n")).otherwise(1)).alias("n_pages"), F.bool_or("within").alias("within")))
    often = found.where((F.col("subtree") != 0) & (F.col("n_pages") >= least_pages))
    sizes = found.where(F.col("subtree") == 0).select("host", F.col("n_pages").alias("_all"))
    return often.join(sizes, "host").where(~F.col("within") | (F.col("n_pages") >= least_share * F.col("_all"))).select("host", "subtree", "n_pages")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = 10, least_share: float = 0.2, broadcast_rows: int = 500_000) -> DataFrame:
    """Main text of every whole page.

    Returns id_col, url_col, text, n_chars. Null or empty html, and pages without main text, give an empty text; pages
    whose url has no host share the empty host; repeated rows and null ids give one row each; other
    columns are ignored. Templates reach the tasks by broadcast if they are at most broadcast_rows
    rows, which is checked, else by a join that gives each page the template hashes of its host.
    """
    spark = pages.sparkSession
    templates = cut(template_subtrees(pages, url_col, html_col, least_pages, least_share))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("html"))
    kind = pages.schema[id_col].dataType.simpleString()
    if templates.count() <= broadcast_rows:
        by_host: dict[str, set[int]] = {}
        for host, subtree, _ in templates.toLocalIterator():
            by_host.setdefault(host, set()).add(subtree)
        shared = spark.sparkContext.broadcast(by_host)
        rows = rows.withColumn("found", F.lit(None).cast("array<bigint>"))
        lookup = lambda host, _: shared.value.get(host, ())
    else:
        per_host = templates.groupBy("host").agg(F.collect_set("subtree").alias("found"))  # at most 1 / least_share hashes a page of the host
        rows = rows.join(per_host, "host", "left").select("id", "url", "host", "html", "found")
        lookup = lambda _, found: set(found or ())

    def run(batch):
        texts = [Page(source).text(lookup(host, found)) for host, source, found in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
        return {"id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": np.array([len(t) for t in texts], np.int64)}

    out = map_batches(rows, run, f"id {kind}, url string, text string, n_chars bigint")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
