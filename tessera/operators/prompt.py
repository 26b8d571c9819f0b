"""Prompt-side text: history, context blocks, source lists and answer cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import vocab
from tessera.functions.text import contains_any, falsy, normalize_question, or_empty, strip, trim_tail, unquote

CONTEXT_CHARS = 5000
HISTORY_CHARS = 2500
# Fixed values of the prompt: words and phrases that refer back, what stands for a listed inventory, labels.
FOLLOW_UP = ("bu", "bunu", "bunun", "onda", "onu", "onun", "peki", "devam", "yukaridaki", "yukarıdaki", "onceki", "önceki", "detaylandir", "detaylandır")
FOLLOW_UP_PHRASES = ("az once", "az önce")
CUT_SUFFIX = "\n...[bağlam kısaltıldı]"
LISTED_TURN = "[Onceki mesajda kaynak envanteri listelendi; detaylar prompttan cikarildi.]"
LISTED_HISTORY = "[Onceki mesajda veritabani kaynak envanteri listelendi; detaylar prompttan cikarildi.]"
LISTING_PHRASE, LISTING_TOTAL, LISTING_ITEM = "su an acik olan veritabaninda indekslenmis kaynaklar", r"toplam:\s*[0-9]+\s+benzersiz kaynak", r"\b[0-9]+\.\s+.*?\bparca\b"
LISTING_ITEMS = 8
NO_LABEL = "Bilinmeyen Belge"
_LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def lists_inventory(text: Column) -> Column:
    """Whether a text is a long answer that lists the indexed sources."""
    n = normalize_question(text)
    return F.contains(n, F.lit(LISTING_PHRASE)) | n.rlike(LISTING_TOTAL) | (F.regexp_count(n, F.lit(LISTING_ITEM)) >= LISTING_ITEMS)


def clean_history(history: Column, *, limit: int = HISTORY_CHARS) -> Column:
    """A history without listed inventories (the first leaves a note, a text that is one is the note), its tail within ``limit``."""
    text = strip(or_empty(history))
    flagged = F.transform(F.split(text, _LINE_END), lambda x: F.struct(x.alias("line"), lists_inventory(x).alias("listed")))
    first = F.array_position(F.transform(flagged, lambda x: x["listed"]), True) - 1
    noted = F.transform(flagged, lambda x, i: F.when(~x["listed"], x["line"]).when(i == first, F.lit(LISTED_HISTORY)))
    kept = trim_tail(strip(F.array_join(F.filter(noted, lambda x: x.isNotNull()), "\n")), limit)
    return F.when(text == "", "").when(lists_inventory(text), LISTED_HISTORY).otherwise(kept)


def chat_history(messages: DataFrame, *, max_pairs: int = 3, chars: int = 800, limit: int = HISTORY_CHARS) -> DataFrame:
    """(conv_id, history): the last 2*max_pairs turns in order as "role: text".

    A text keeps its last ``chars`` characters behind a marker, a listed
    inventory becomes a note; the whole is cleaned and keeps its last ``limit``.
    """
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = messages.withColumn("back", F.row_number().over(w)).where(F.col("back") <= 2 * max_pairs)
    said = or_empty(F.col("text"))
    line = F.concat(or_empty(F.col("role")), F.lit(": "), F.when(lists_inventory(said), LISTED_TURN).otherwise(trim_tail(said, chars)))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("x")))), lambda s: s["x"]), "\n")  # 2*max_pairs turns
    return last.groupBy("conv_id").agg(joined.alias("history")).select("conv_id", clean_history(F.col("history"), limit=limit).alias("history"))


def clean_name(name: Column) -> Column:
    """Decoded, without .pdf and a trailing upload number."""
    return F.regexp_replace(F.regexp_replace(unquote(strip(or_empty(name))), r"(?i)\.pdf$", ""), r"_[0-9]{10,}$", "")


def source_label(title: Column, source: Column) -> Column:
    """The cleaned title, else a URL's host or a path's file name without .pdf, else a fixed label."""
    s = strip(or_empty(source))
    host = F.regexp_extract(s, r"(?i)^https?://([^/?#]+)", 1)
    file = F.substring_index(F.replace(s, F.lit("\\"), F.lit("/")), "/", -1)
    plain = F.regexp_replace(F.coalesce(F.nullif(file, F.lit("")), s), r"(?i)\.pdf$", "")
    return F.coalesce(F.nullif(clean_name(title), F.lit("")), F.nullif(host, F.lit("")), F.nullif(plain, F.lit("")), F.lit(NO_LABEL))


def page_range(start: Column, end: Column) -> Column:
    a, b = start.cast("string"), end.cast("string")
    return F.when(start.isNull(), "").when(end.isNull() | (a == b), a).otherwise(F.concat_ws("-", a, b))


def context(ranked: DataFrame, *, limit: int = CONTEXT_CHARS) -> DataFrame:
    """(query_id, context): numbered blocks by rank, cut at ``limit`` characters with a note.

    ranked (query_id, rank, source, content) may hold title, article_no,
    article_title, page, page_start and page_end; a block names the source's
    label and, where known, the article, the pages and the URL.
    """
    col = lambda c: F.col(c).cast("string") if c in ranked.columns else F.lit(None).cast("string")
    filled = lambda c: F.nullif(col(c), F.lit(""))
    article = F.when(filled("article_no").isNotNull() & filled("article_title").isNotNull(), F.concat_ws(" - ", col("article_no"), col("article_title"))).otherwise(F.coalesce(filled("article_no"), filled("article_title")))
    first, last = F.coalesce(filled("page_start"), filled("page")), F.coalesce(filled("page_end"), filled("page"))
    pages = F.when(first.isNotNull() & last.isNotNull() & (first != last), F.concat_ws("-", first, last)).otherwise(F.coalesce(first, last))
    named = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value))
    lines = (
        F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] Kaynak: "), source_label(col("title"), F.col("source"))),
        named("Madde", article), named("Sayfa", pages), named("URL", F.when(col("source").rlike("^https?://"), col("source"))),
        F.lit("İçerik:"), or_empty(F.col("content")),
    )
    block = F.concat_ws("\n", *lines)
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))), lambda s: s["b"]), "\n\n")
    made = ranked.groupBy("query_id").agg(whole.alias("context"))
    return made.withColumn("context", F.when(F.length("context") > limit, F.concat(F.left("context", F.lit(limit)), F.lit(CUT_SUFFIX))).otherwise(F.col("context")))


def strip_sources(answer: Column) -> Column:
    """An answer up to its own source heading, without blocks that begin with a URL and end at a blank line."""
    cut = F.regexp_replace(strip(or_empty(answer)), r"(?isuU)(?:^|\n)\s*(?:#+\s*)?Kaynak(?:lar)?\s*:.*$", "")

    def step(acc: Column, line: Column) -> Column:
        bare = strip(line)
        starts, skipping = bare.rlike(r"^(?:[-*]\s*)?https?://\S"), acc["skip"]
        kept = ~starts & ~skipping
        return F.struct(F.when(kept, F.concat(acc["out"], F.array(line))).otherwise(acc["out"]).alias("out"), (starts | (skipping & (bare != ""))).alias("skip"))

    zero = F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.lit(False).alias("skip"))
    return strip(F.aggregate(F.split(strip(cut), _LINE_END), zero, step, lambda acc: F.array_join(acc["out"], "\n")))


def independent(question: Column) -> Column:
    """Five distinct words or more and nothing that refers back."""
    n = normalize_question(question)
    words = F.array_distinct(F.split(n, " "))
    back = F.arrays_overlap(words, F.array(*map(F.lit, FOLLOW_UP)))
    for phrase in FOLLOW_UP_PHRASES:
        back = back | F.contains(n, F.lit(phrase))
    return (F.size(words) >= 5) & ~back


def asks_inventory(question: Column) -> Column:
    """Whether a question asks which sources there are."""
    n = normalize_question(question)
    together = reduce(lambda a, b: a & b, (contains_any(n, words) for words in vocab.INVENTORY_TOGETHER))
    return contains_any(n, vocab.INVENTORY_TERMS) | together


def error_class(message: Column) -> Column:
    """prompt_size, collection or other, by what the message says."""
    m = F.lower(or_empty(message))
    has = lambda *xs: reduce(lambda a, b: a & b, (F.contains(m, F.lit(x)) for x in xs))
    size = has("413") | has("payload too large") | has("request too large") | has("requested", "tokens", "limit") | has("rate_limit") | has("rate limit") | has("tpm")
    gone = has("collection") & (has("does not exist") | has("error getting collection"))
    return F.when(size, "prompt_size").when(gone, "collection").otherwise("other")


def inventory_answer(inventory: DataFrame, *, limit: int = 30) -> DataFrame:
    """(rank, line): the first ``limit`` sources as numbered lines and a last one that counts the rest."""
    w = Window.orderBy(F.desc("chunks"), F.lower("source"))
    first = inventory.orderBy(F.desc("chunks"), F.lower("source")).limit(limit).withColumn("rank", F.row_number().over(w))
    listed = first.select("rank", F.concat(F.col("rank").cast("string"), F.lit(". "), falsy(F.col("title"), ""), F.when(falsy(F.col("title"), "") != "", " — ").otherwise(""), "source", F.lit(" ("), F.col("chunks").cast("string"), F.lit(" parça)")).alias("line"))
    rest = inventory.agg((F.count("*") - limit).alias("n")).where("n > 0").select(F.lit(limit + 1).alias("rank"), F.concat(F.lit("... "), F.col("n").cast("string"), F.lit(" kaynak daha")).alias("line"))
    return listed.unionByName(rest)
