"""URL predicates, classes and normal forms as column expressions."""

from __future__ import annotations

from functools import reduce
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera import vocab
from tessera.functions.columns import let

_AUTHORITY = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)"


def host(u: Column) -> Column:
    """Lower-case host without user, port and brackets; empty if there is none."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(u, _AUTHORITY, 2), r"^.*@", ""), r":\d*$", ""))


def path(u: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(u, _AUTHORITY, ""), r"^[^?#]*", 0)


def is_valid(u: Column) -> Column:
    """http or https with an authority."""
    return F.coalesce(F.lower(F.regexp_extract(u, _AUTHORITY, 1)).isin("http", "https") & (F.regexp_extract(u, _AUTHORITY, 2) != ""), F.lit(False))


def in_domains(u: Column, domains) -> Column:
    """The host is one of the domains or lies below one."""
    h = host(u)
    return reduce(lambda a, b: a | b, ((h == d.lower()) | h.endswith("." + d.lower()) for d in domains), F.lit(False))


def is_excluded(u: Column, patterns=vocab.EXCLUDE_PATTERNS, home: str | None = None) -> Column:
    """Any pattern occurs in the lower-case URL; ``home`` adds the institution's closed hosts."""
    wanted = [*patterns, *(f"{h}.{home}" for h in vocab.EXCLUDED_HOSTS if home)]
    low = F.lower(u)
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(p.lower())) for p in wanted), F.lit(False))


def url_class(u: Column) -> Column:
    """document, skip or text_page, from the extension of the path's last segment."""
    p = F.regexp_replace(F.lower(path(u)), "/+$", "")
    ext = F.regexp_extract(F.substring_index(p, "/", -1), r"(\.[^.]*)$", 1)
    return F.when(ext.isin(*vocab.DOCUMENT_EXTENSIONS), "document").when(ext.isin(*vocab.SKIP_EXTENSIONS), "skip").otherwise("text_page")


def priority(u: Column, patterns=vocab.PRIORITY_PATTERNS) -> Column:
    """How many patterns occur in the lower-case URL."""
    low = F.lower(u)
    return reduce(lambda a, b: a + b, (F.contains(low, F.lit(p)).cast("int") for p in patterns), F.lit(0))


def normalize_crawl(u: Column) -> Column:
    """Lower-case scheme and host, no fragment, no trailing slash unless the path is a slash."""
    def joined(x: Column) -> Column:
        rest = F.substring(x["bare"], F.length(x["front"]) + 1, F.length(x["bare"]))
        return F.concat(F.lower(x["front"]), let(rest, lambda r: F.when(r == "/", r).otherwise(F.regexp_replace(r, "/+$", ""))))

    bare = F.regexp_replace(u, "#.*$", "")
    return let(bare, lambda b: let(F.struct(b.alias("bare"), F.regexp_extract(b, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0).alias("front")), joined))


def absolute(base: Column, href: Column) -> Column:
    """``href`` on ``base`` for the forms that occur in pages: absolute, //host, /path, ?query and plain relative."""
    front = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    here = F.regexp_replace(path(base), "[^/]*$", "")
    folder = F.when(here == "", "/").otherwise(here)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*:", 0), href))
        .when(href.startswith("/"), F.concat(front, href))
        .when(href.startswith("?"), F.concat(front, path(base), href))
        .otherwise(F.concat(front, folder, href))
    )


@F.pandas_udf(StringType())
def join_encoded(base: pd.Series, href: pd.Series) -> pd.Series:
    """Exact joining and re-quoting of discovered URLs, by the standard library."""

    def one(b: str | None, h: str | None) -> str | None:
        if h is None:
            return None
        s = urlsplit(urljoin(b or "", h.strip()))
        return urlunsplit((s.scheme, s.netloc, quote(s.path, safe="/:%[]"), quote(s.query, safe="=&?/:,%[]"), ""))

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)])


def split_selector(entry: Column) -> tuple[Column, Column]:
    """(url, CSS selector or null) of an entry url|css=… or url|selector=…."""
    e = F.trim(entry)
    chosen = F.nullif(F.trim(F.regexp_extract(e, r"\|(?:css|selector)=(.*)$", 1)), F.lit(""))
    return F.trim(F.regexp_replace(e, r"\|(?:css|selector)=.*$", "")), chosen
