"""Attribute extraction from stored HTML pages."""

from __future__ import annotations

from collections.abc import Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Finder(HTMLParser):
    """Walks a page once; ``path`` is a list of exact class values, each inside the one before,
    and only the first element that matches a step is entered."""

    def __init__(self, path: Sequence[str], tag: str, attr: str):
        super().__init__(convert_charrefs=True)
        self.path, self.tag, self.attr = list(path), tag, attr
        self.open: list[str] = []
        self.depths: list[int] = []
        self.step = 0
        self.found: str | None = None
        self.done = False

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        attrs = dict(attrs)
        inside = len(self.depths) == len(self.path)
        if inside and tag == self.tag:
            self.found, self.done = attrs.get(self.attr), True
            return
        if tag in VOID:
            return
        self.open.append(tag)
        if self.step < len(self.path) and attrs.get("class") == self.path[self.step]:
            self.depths.append(len(self.open))
            self.step += 1

    def handle_endtag(self, tag):
        if self.done or tag not in self.open:
            return
        while self.open:
            last = self.open.pop()
            if self.depths and len(self.open) < self.depths[-1]:
                # the first match of the innermost step is closed without a hit
                self.done = True
                return
            if last == tag:
                return


def first_attr(html: str | None, path: Sequence[str], tag: str, attr: str) -> str | None:
    if html is None:
        return None
    finder = _Finder(path, tag, attr)
    try:
        finder.feed(html)
        finder.close()
    except Exception:  # a page that cannot be parsed gives NULL, the job goes on
        return None
    return finder.found


def extract_attr(html: str | Column, path: Sequence[str], tag: str, attr: str) -> Column:
    """First ``tag@attr`` below the nested class values ``path``; NULL when there is none.

    Arrow batches over the standard-library parser; Spark has no HTML expression.
    """
    path = list(path)

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: first_attr(page, path, tag, attr)).astype(object)

    return run(F.col(html) if isinstance(html, str) else html)


def extract_attr_fast(html: str | Column, tag: str, attr: str) -> Column:
    """The same for double-quoted attributes without a class path: one JVM regular expression."""
    c = F.col(html) if isinstance(html, str) else html
    pattern = rf'<{tag}\s(?:[^>]*\s)?{attr}="([^"]*)"'
    hit = F.regexp_extract(c, pattern, 1)
    return F.when(c.rlike(pattern), hit)
