"""Main content of web pages, and its Markdown, on the standard library's HTML parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillspark.functions import text as T

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Where an article's content is, and what is never part of it.
_MAIN_TAGS, _MAIN_CLASSES = {"article", "main"}, {"post", "entry-content", "content", "main"}
_CHROME_TAGS = {"header", "footer", "nav", "aside", "script", "style"}
_CHROME_CLASSES = {"sidebar", "ads", "advert", "banner", "breadcrumbs", "menu", "navbar", "comments", "related-posts"}


class _Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []

    def classes(self) -> set[str]:
        return set((self.attrs.get("class") or "").split())


class _Tree(HTMLParser):
    """A forgiving tree: an end tag closes the nearest open element of its name."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#root", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, dict(attrs))
        if tag in ("p", "li") and self.open[-1].tag == tag:
            self.open.pop()
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def _walk(node: _Node):
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack += [c for c in reversed(x.children) if isinstance(c, _Node)]


def _first(root: _Node, good) -> _Node | None:
    return next((x for x in _walk(root) if good(x)), None)


def _plain(node: _Node) -> str:
    stack, out = [node], []
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            stack += reversed(x.children)
    return "".join(out)


def _without_chrome(node: _Node) -> None:
    for x in _walk(node):
        x.children = [c for c in x.children if isinstance(c, str) or not (c.tag in _CHROME_TAGS or c.classes() & _CHROME_CLASSES)]


_BLOCK = frozenset("p div section article main ul ol table tr blockquote pre body figure".split())


_WRAPS = {"b": "**", "strong": "**", "i": "_", "em": "_"}


def _closed(c: _Node, text: str) -> str:
    """An element's Markdown, given that of its children."""
    if re.fullmatch("h[1-6]", c.tag):
        return f"\n\n{'#' * int(c.tag[1])} {text.strip()}\n\n"
    if c.tag == "a" and c.attrs.get("href"):
        return f"[{text}]({c.attrs['href']})"
    if c.tag in _WRAPS:
        return f"{_WRAPS[c.tag]}{text}{_WRAPS[c.tag]}"
    if c.tag == "li":
        return f"\n  * {text.strip()}"
    if c.tag in _BLOCK:
        return f"\n\n{text.strip()}\n\n"
    return {"br": "  \n", "hr": "\n\n* * *\n\n"}.get(c.tag, text)


def _markdown(node: _Node) -> str:
    """Markdown of a node's children; a stack of open elements, however deep they are nested."""
    open_: list[tuple[_Node, Iterator, list[str]]] = [(node, iter(node.children), [])]
    while True:
        x, rest, out = open_[-1]
        c = next(rest, None)
        if c is None:
            open_.pop()
            if not open_:
                return "".join(out)
            open_[-1][2].append(_closed(x, "".join(out)))
        elif isinstance(c, str):
            out.append(re.sub(r"\s+", " ", c))
        elif c.tag not in ("img", "head", "script", "style"):
            open_.append((c, iter(c.children), []))


def page(html: str | None) -> dict:
    """Title, and Markdown of the main content and of the whole page."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    title = _first(tree.root, lambda x: x.tag == "title")
    body = _first(tree.root, lambda x: x.tag == "body") or tree.root
    full = _markdown(body)
    main = _first(tree.root, lambda x: x.tag in _MAIN_TAGS or x.classes() & _MAIN_CLASSES) or body
    _without_chrome(main)
    part = _markdown(main)
    name = _plain(title).strip() if title else ""
    return {"title": name or None, "main": part.strip(), "full": full.strip()}


@F.pandas_udf(StructType([StructField(x, StringType()) for x in ("title", "main", "full")]))
def parsed(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([page(h) for h in html], columns=["title", "main", "full"])


def extract(pages: DataFrame, html: str = "html", *, least: int = 80) -> DataFrame:
    """``pages`` with ``title``, ``markdown`` and ``plain``: the main content, or the whole page
    where that has under ``least`` characters."""
    got = pages.withColumn("_page", parsed(html))
    chosen = F.when(F.length("_page.main") < least, F.col("_page.full")).otherwise(F.col("_page.main"))
    out = got.withColumn("title", F.col("_page.title")).withColumn("markdown", T.clean_markdown(chosen))
    return out.withColumn("plain", T.strip_links("markdown")).drop("_page")


def title_of(html: Column | str) -> Column:
    """The page's title without parsing its tree; null without one."""
    t = T.strip_ends(F.regexp_extract(T.col(html), r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(t != "", t)
