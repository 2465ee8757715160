"""Web pages that arrive as rows: URL checks, title, text."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim

_SKIP = {"script", "style", "noscript", "template", "head"}
_BLOCK = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "nav", "header", "footer", "title", "body", "main", "aside", "blockquote", "pre"}


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        self.skip += tag in _SKIP
        if tag in _BLOCK:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP and self.skip:
            self.skip -= 1
        if tag in _BLOCK:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(data)


def text_of(html: str | None) -> str:
    p = _Text()
    p.feed(html or "")
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.out).split("\n"))
    return "\n".join(x for x in lines if x)


def html_text(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, text: a page's visible text, a line for each block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({page_id: b[page_id], "text": [text_of(h) for h in b[html]]})

    return pages.select(page_id, html).mapInPandas(run, f"{page_id} long, text string")


def title(html: Column, suffix: str | None = None) -> Column:
    """The title element with single spaces, without a site-name suffix (a regular expression)."""
    t = trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    return trim(F.regexp_replace(t, f"(?:{suffix})$", "")) if suffix else t


def domain(url: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.call_function("try_parse_url", url, F.lit("HOST")), r"^www\.", ""), F.lit("unknown"))


def validate(url: Column) -> Column:
    """ok, or why not: protocol, host; with a hint where only slashes are missing."""
    u = trim(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.regexp_extract(u, r"(?i)^https?://([^/?#]+)", 1)
    return F.when(~scheme.isin("http", "https"), "bad protocol").when(host == "", "no host").otherwise("ok")


def repair_hint(url: Column) -> Column:
    u = trim(url)
    return F.when((validate(u) == "no host") & u.rlike(r"(?i)^https?:/?[^/]"), F.regexp_replace(u, r"(?i)^(https?):/*", "$1://"))


def configured(df: DataFrame, column: str) -> DataFrame:
    """A row for each URL of a comma- or line-separated setting."""
    return df.select(F.explode(F.split(column, r"[,\n]")).alias("url")).select(trim(F.col("url")).alias("url")).where("url <> ''")
