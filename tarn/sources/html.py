"""HTML to text, links and fields, with the standard library's parser in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SILENT = frozenset(("script", "style", "noscript", "template"))
_BLOCK = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 table tr td th section article header footer title".split())


class _Text(HTMLParser):
    def __init__(self, markdown: bool = False):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent, self.markdown = 0, markdown

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        elif self.markdown and re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif self.markdown and tag == "li":
            self.out.append("\n* ")
        elif self.markdown and tag in ("b", "strong"):
            self.out.append("**")
        elif tag in _BLOCK:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif self.markdown and tag in ("b", "strong"):
            self.out.append("**")
        elif tag in _BLOCK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(data if self.markdown else data + "\n" if data.strip() else data)


def clean_html(raw: str | None, markdown: bool = False) -> str:
    """Text of a page: tags become line breaks, scripts and styles go, blanks are squeezed."""
    if not raw:
        return ""
    parser = _Text(markdown)
    parser.feed(raw)
    parser.close()
    text = re.sub(r"\r\n?", "\n", "".join(parser.out))
    text = re.sub(r"[ \t]+", " ", text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"\n ", "\n", text)).strip()


def html_text(c: Column | str, markdown: bool = False) -> Column:
    """clean_html() of a column."""
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: None if p is None else clean_html(p, markdown))

    return run(c)


def plain(c: Column) -> Column:
    """Text of simple HTML by expressions alone: no scripts or styles, tags as blanks, five entities."""
    text = F.regexp_replace(c, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, "(?s)<[^>]*>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(text, "[ \\t\\r\\n]+", " "))


def labelled(c: Column, label: str) -> Column:
    """The text of the element after a heading with this label, such as 'Seniority level'."""
    got = F.regexp_extract(c, f"(?is)<h\\d[^>]*>\\s*{re.escape(label)}\\s*</h\\d>\\s*<(\\w+)[^>]*>\\s*(.*?)\\s*</\\1>", 2)
    return F.nullif(F.trim(F.regexp_replace(got, "<[^>]*>", "")), F.lit(""))
