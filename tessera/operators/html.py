"""Rows from raw HTML: titles, headings, links, text and PDF inventories."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions import url as U
from tessera.functions.text import is_junk, or_empty, quality_gate

DROPPED = frozenset(("script", "style", "noscript", "svg"))
FURNITURE = DROPPED | {"footer", "header", "nav", "form"}
#: Containers whose longest text is the page's; in this order on ties.
CONTAINERS = ("main", "article", "section", "body")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Text(HTMLParser):
    def __init__(self, dropped: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.dropped, self.depth, self.parts, self.open, self.found = dropped, 0, [], [], {}

    def handle_starttag(self, tag, attrs):
        if tag in self.dropped:
            self.depth += 1
        elif tag in CONTAINERS:
            self.open.append((tag, len(self.parts)))

    def handle_endtag(self, tag):
        if tag in self.dropped:
            self.depth = max(0, self.depth - 1)
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                name, at = self.open.pop(i)
                text = "\n".join(self.parts[at:])
                if len(text) > len(self.found.get(name, "")):
                    self.found[name] = text
                break

    def handle_data(self, data):
        if not self.depth and (t := data.strip()):
            self.parts.append(t)


def html_text(html: str | None, furniture: bool = False) -> str:
    """Text nodes by line, without scripts and, with ``furniture``, without the page's frame and the longest container."""
    parser = _Text(FURNITURE if furniture else DROPPED)
    parser.feed(html or "")
    parser.close()
    while parser.open:
        parser.handle_endtag(parser.open[-1][0])
    whole = "\n".join(line for line in "\n".join(parser.parts).split("\n") if line.strip())
    if not furniture:
        return whole
    texts = [parser.found[c] for c in CONTAINERS if c in parser.found] or [whole]
    return max(texts, key=len)


@F.pandas_udf(StringType())
def clean_html(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(html_text)


@F.pandas_udf(StringType())
def page_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda h: html_text(h, True))


def unescape(x: Column) -> Column:
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(mark))
    return x


def title(html: Column) -> Column:
    return F.trim(unescape(F.regexp_extract(or_empty(html), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def first_heading(html: Column) -> Column:
    raw = F.regexp_extract(or_empty(html), r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    return F.trim(unescape(F.regexp_replace(F.regexp_replace(raw, r"<[^>]*>", " "), r"\s+", " ")))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, url): absolute crawl-normal links of each page, first occurrence of each; script, mail, phone and fragment links go."""
    hrefs = F.regexp_extract_all(or_empty(F.col("html")), F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"'>]*)["']"""), F.lit(1))
    each = pages.select("page_id", F.col("url").alias("base"), F.posexplode(hrefs).alias("pos", "href")).withColumn("href", F.trim(unescape(F.col("href"))))
    good = each.where((F.col("href") != "") & ~F.lower("href").rlike(r"^(javascript:|mailto:|tel:|#)"))
    made = good.select("page_id", "pos", U.normalize_crawl(U.absolute(F.col("base"), F.col("href"))).alias("url"))
    return made.groupBy("page_id", "url").agg(F.min("pos").alias("pos")).select("page_id", "pos", "url")


def pdf_inventory(found: DataFrame) -> DataFrame:
    """(url, pages, title): distinct links with .pdf anywhere in the lower-case URL, titled by their file name."""
    pdf = found.where(F.contains(F.lower("url"), F.lit(".pdf")))
    name = F.regexp_replace(F.substring_index(F.regexp_replace("url", r"[?#].*$", ""), "/", -1), r"(?i)\.pdf$", "")
    return pdf.groupBy("url").agg(F.count_distinct("page_id").alias("pages")).select("url", "pages", F.trim(F.regexp_replace(name, r"[-_]+", " ")).alias("title"))


def page_documents(pages: DataFrame) -> DataFrame:
    """(url, title, content, content_hash) of pages that pass the quality gate; title and heading go before a content whose first 500 characters lack them."""
    made = pages.select("url", title(F.col("html")).alias("title"), first_heading(F.col("html")).alias("h1"), page_text(F.col("html")).alias("body"))
    good = made.where(quality_gate(F.col("body")))
    head = lambda c: F.when((F.col(c) != "") & ~F.contains(F.left("body", F.lit(500)), F.col(c)), F.col(c))
    content = F.concat_ws("\n\n", head("title"), F.when(F.col("h1") != F.col("title"), head("h1")), "body")
    return good.select("url", "title", content.alias("content"), F.sha2(content, 256).alias("content_hash"))


def main_content(first: Column, second: Column) -> Column:
    """The first extraction that isn't junk, else null."""
    return F.coalesce(F.when(~is_junk(first), first), F.when(~is_junk(second), second))


def rank_links(found: DataFrame, patterns) -> DataFrame:
    """Links of each page by priority, then URL."""
    scored = found.withColumn("score", U.priority(F.col("url"), patterns))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "url")))


URL_IN_ERROR = re.compile(r"https?://[^\s)]+")


def failures(errors: DataFrame) -> DataFrame:
    """(url, reason) of error messages, distinct; the URL is the first in the message."""
    return errors.select(F.regexp_extract("message", URL_IN_ERROR.pattern, 0).alias("url"), F.col("message").alias("reason")).distinct()
