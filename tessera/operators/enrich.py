"""Metadata enrichment: unit, document type, date and context summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import vocab
from tessera.functions import url as U
from tessera.functions.text import or_empty


def _first_match(x: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, label in reversed(table.items()):
        out = F.when(F.contains(x, F.lit(key)), label).otherwise(out)
    return out


def lower_tr(x: Column) -> Column:
    """Lower case with dotted capital I as i."""
    return F.lower(F.translate(x, "İ", "i"))


def detect_unit(url: Column, title: Column, home: str = "example.edu") -> Column:
    """First key in the host's first label (unless it is the bare home domain), in the first path segment, then in URL and title."""
    u, h = or_empty(url), U.host(or_empty(url))
    label = F.when((h != "") & ~h.isin(home, f"www.{home}"), F.substring_index(h, ".", 1))
    segment = F.lower(F.regexp_extract(U.path(u), r"^/*([^/]+)", 1))
    return F.coalesce(_first_match(label, vocab.UNITS), _first_match(segment, vocab.UNITS), _first_match(lower_tr(F.concat_ws(" ", u, or_empty(title))), vocab.UNITS), F.lit(vocab.DEFAULT_UNIT))


def detect_doc_type(url: Column, title: Column, content: Column) -> Column:
    """First pattern in URL, title and the first 300 characters."""
    return F.coalesce(_first_match(lower_tr(F.concat_ws(" ", or_empty(url), or_empty(title), F.left(or_empty(content), F.lit(300)))), vocab.DOC_TYPES), F.lit(vocab.DEFAULT_DOC_TYPE))


def extract_date(text: Column) -> Column:
    """Date in the first 1000 characters by order of patterns; ISO where it parses, else as written; null if none."""
    head = F.left(or_empty(text), F.lit(1000))
    numeric = F.nullif(F.regexp_extract(head, r"[0-9]{1,2}[./][0-9]{1,2}[./]20[0-9]{2}", 0), F.lit(""))
    iso = F.nullif(F.regexp_extract(head, r"20[0-9]{2}-[0-9]{1,2}-[0-9]{1,2}", 0), F.lit(""))
    named = F.nullif(F.regexp_extract(head, rf"[0-9]{{1,2}}\s+(?:{'|'.join(vocab.MONTHS)})\s+20[0-9]{{2}}", 0), F.lit(""))
    day = lambda x, p: F.date_format(F.try_to_date(x, p), "yyyy-MM-dd")
    return F.coalesce(
        F.when(numeric.isNotNull(), F.coalesce(day(numeric, "d.M.yyyy"), day(numeric, "d/M/yyyy"), numeric)),
        F.when(iso.isNotNull(), F.coalesce(day(iso, "yyyy-M-d"), iso)),
        named,
    )


def summary(title: Column, unit: Column, doc_type: Column, h1: Column, h2: Column) -> Column:
    """One line of context: known unit, title, headers that add to it, known type."""
    t, u, d, a, b = (or_empty(x) for x in (title, unit, doc_type, h1, h2))
    parts = F.array(
        F.when((u != "") & (u != vocab.DEFAULT_UNIT), u), F.when(t != "", t), F.when((a != "") & (a != t), a),
        F.when((b != "") & (b != t) & (b != a), b), F.when((d != "") & (d != vocab.DEFAULT_DOC_TYPE), F.initcap(F.replace(d, F.lit("_"), F.lit(" ")))),
    )
    joined = F.array_join(F.filter(parts, lambda x: x.isNotNull()), " — ")
    return F.when(joined == "", "").otherwise(F.concat(F.lit("[Bağlam: "), joined, F.lit("]")))


def enrich(chunks: DataFrame, now: str, home: str = "example.edu") -> DataFrame:
    """Chunks (source, title, content, header_1, header_2, crawled_at) with unit, doc_type, crawled_at, content_date, summary; the summary heads the content."""
    c = F.col
    made = chunks.withColumns({"unit": detect_unit(c("source"), c("title"), home), "doc_type": detect_doc_type(c("source"), c("title"), c("content")), "crawled_at": F.coalesce(F.nullif(c("crawled_at"), F.lit("")), F.lit(now)), "content_date": extract_date(c("content"))})
    made = made.withColumn("summary", summary(c("title"), c("unit"), c("doc_type"), c("header_1"), c("header_2")))
    return made.withColumn("content", F.when(c("summary") != "", F.concat("summary", F.lit("\n\n"), "content")).otherwise(c("content")))
