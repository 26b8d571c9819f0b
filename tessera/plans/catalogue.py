"""Registered queries over the test tables, and the same in DuckDB's SQL.

Some operators need inputs that the tables lack (articles, headers, dates, an
earlier snapshot); those are derived from the tables by the same rule on both
sides.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import url as U
from tessera.operators import chunk, enrich, evaluate, graph, html, legal, prompt, rank, report, rerank, store
from tessera.operators.retrieve import inject, retrieve as retrieve_rows
from tessera.storage import materialize, table
from tessera.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


# ---- ranking -------------------------------------------------------------

NORM = "replace(lower(translate({x}, 'İIıĞğÜüŞşÖöÇç', 'iiigguussoocc')), 'ß', 'ss')"
TOKENS = f"regexp_extract_all({NORM}, '[a-z0-9]{{{{2,}}}}')"
BM25_CTE = f"""
d AS (SELECT doc_id, {TOKENS.format(x="text")} AS t FROM documents),
q AS (SELECT item_id AS query_id, unnest({TOKENS.format(x="text")}) AS term FROM benchmark),
qt AS (SELECT query_id, term, count(*) AS qtf FROM q GROUP BY ALL),
s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / a))), 6) AS score
  FROM qt JOIN df USING (term) JOIN tf USING (term), s GROUP BY query_id, doc_id),
bm AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc WHERE score > 0) WHERE rank <= 5)
"""


def questions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


@query(f"WITH {BM25_CTE} SELECT query_id, doc_id, score, rank FROM bm")
def bm25_topk(s, d):
    return rank.bm25(documents(s, d), questions(s, d), k=5).select("query_id", "doc_id", "score", "rank")


def truth(s: SparkSession, d: str) -> DataFrame:
    """Documents that hold a question's text; the questions are a small stated set, sent to all rows."""
    q = F.broadcast(questions(s, d))
    return documents(s, d).join(q, F.contains(F.col("text"), F.col("question"))).select("query_id", "doc_id")


@query(
    f"""WITH {BM25_CTE}, tr AS (SELECT item_id AS query_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
f AS (SELECT t.query_id, max(CASE WHEN rank <= 1 THEN 1 ELSE 0 END) AS h1, max(CASE WHEN rank <= 3 THEN 1 ELSE 0 END) AS h3, max(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) AS h5
  FROM tr t LEFT JOIN bm USING (query_id, doc_id) GROUP BY t.query_id)
SELECT count(*) AS questions, round(coalesce(avg(h1), 0), 6) AS hit_1, round(coalesce(avg(h3), 0), 6) AS hit_3, round(coalesce(avg(h5), 0), 6) AS hit_5 FROM f"""
)
def bm25_metrics(s, d):
    return evaluate.mean_flags(evaluate.hit_flags(bm25_topk(s, d), truth(s, d)), ["hit_1", "hit_3", "hit_5"])


OKAPI_CTE = """
d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS t FROM documents),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, s GROUP BY term),
m AS (SELECT avg(raw) AS mean FROM df),
hit AS (SELECT query_id, doc_id, round(sum(qtf * CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / a))), 6) AS score
  FROM qt JOIN df USING (term) JOIN tf USING (term), s, m GROUP BY query_id, doc_id),
al AS (SELECT * FROM hit UNION ALL SELECT b.item_id, f.doc_id, 0.0 FROM benchmark b, (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 10) f
  WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.query_id = b.item_id AND h.doc_id = f.doc_id)),
ok AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM al) WHERE rank <= 10)
"""


@query(f"WITH {OKAPI_CTE} SELECT query_id, doc_id, score, rank FROM ok")
def bm25_okapi_topk(s, d):
    return rank.bm25_okapi(documents(s, d), questions(s, d), k=10).select("query_id", "doc_id", "score", "rank")


def vector_queries(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").where("vec_id < 10").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


KNN = """SELECT query_id, vec_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM (
SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id < 10)) WHERE rank <= 5"""


@query(KNN)
def vector_knn(s, d):
    return rank.nearest(table(s, d, "embeddings"), vector_queries(s, d), k=5).select("query_id", "vec_id", "score", "rank")


def every_hundredth(s: SparkSession, d: str) -> DataFrame:
    """Every row whose id is divisible by 100, as queries; they grow with the table."""
    return table(s, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query("""SELECT query_id, vec_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM (
SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0)) WHERE rank <= 5""")
def vector_knn_hundredth(s, d):
    return rank.nearest_in_blocks(table(s, d, "embeddings"), every_hundredth(s, d), k=5).select("query_id", "vec_id", "score", "rank")


@query()
def vector_mmr(s, d):
    return rank.mmr(table(s, d, "embeddings"), every_hundredth(s, d))


@query(
    f"""WITH {BM25_CTE}, {OKAPI_CTE.replace("d AS (", "d2 AS (", 1).replace("qt AS (", "qt2 AS (", 1).replace("s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d)", "s2 AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d2)").replace("tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d)", "tf2 AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d2)").replace("df AS (", "df2 AS (", 1).replace("FROM tf, s GROUP BY term", "FROM tf2, s2 GROUP BY term").replace("AS mean FROM df)", "AS mean FROM df2)").replace("FROM qt JOIN df USING (term) JOIN tf USING (term), s, m", "FROM qt2 JOIN df2 USING (term) JOIN tf2 USING (term), s2, m")},
fu AS (SELECT query_id, doc_id, round(sum(w), 9) AS score FROM (SELECT query_id, doc_id, 0.5 / (60 + rank) AS w FROM bm UNION ALL SELECT query_id, doc_id, 0.5 / (60 + rank) FROM ok) GROUP BY ALL)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM fu"""
)
def rrf_fusion(s, d):
    return rank.fuse([bm25_topk(s, d), bm25_okapi_topk(s, d)], [0.5, 0.5]).select("query_id", "doc_id", "score", "rank")


ASKED = (
    (1, "AKTS ne demektir?"), (2, "Tez izleme komitesi nasıl oluşturulur?"), (3, "Yönetmeliğin amacı nedir?"), (4, "Doktora yeterlik sınavı ne zaman yapılır?"),
    (5, "Fen Fakültesi staj AKTS kaç kredi?"), (6, "Kaç öğretim üyesi bulunur?"), (7, "Merhaba"), (8, "ALES ve YÖK %C3%96%C4%9ER kimdir?"),
)


def asked(s: SparkSession) -> DataFrame:
    return s.createDataFrame(ASKED, "q long, question string")


def scored(s: SparkSession, d: str) -> DataFrame:
    """The articles of the documents that BM25 finds for each question, from the document's score up."""
    hits = bm25_topk(s, d).select(F.col("query_id").alias("q"), "doc_id", F.col("score").alias("base"))
    found = articled(s, d).join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    arts = legal.split_articles(found).select("doc_id", "seq", "article_no", "article_title", "content")
    named = arts.join(found.select("doc_id", "source", F.col("source").alias("title")), "doc_id")
    return rerank.score_rows(hits.join(named, "doc_id").join(questions(s, d).withColumnRenamed("query_id", "q"), "q"))


@query()
def rerank_rules(s, d):
    return scored(s, d).select("q", "doc_id", "seq", "intent", "rerank_score", "strong_match", F.array_join(F.transform("explanation", lambda e: e["reason"]), ",").alias("reasons"))


@query()
def query_intent_whole(s, d):
    return questions(s, d).select("query_id", rerank.intent(F.col("question")).alias("intent"))


@query()
def acronyms_whole(s, d):
    return questions(s, d).select("query_id", F.array_join(rerank.acronyms(F.col("question")), ",").alias("acronyms"))


@query("SELECT * FROM (VALUES (1, 'definition'), (2, 'procedure'), (3, 'purpose'), (4, 'deadline'), (5, 'fact'), (6, 'fact'), (7, 'general'), (8, 'fact')) t(q, intent)")
def query_intent(s, d):
    return asked(s).select(F.col("q").cast("int").alias("q"), rerank.intent(F.col("question")).alias("intent"))


@query("SELECT * FROM (VALUES (1, 'AKTS'), (2, ''), (3, ''), (4, ''), (5, 'AKTS'), (6, ''), (7, ''), (8, 'ALES,YÖK,ÖĞR')) t(q, acronyms)")
def acronyms(s, d):
    return asked(s).select(F.col("q").cast("int").alias("q"), F.array_join(rerank.acronyms(F.col("question")), ",").alias("acronyms"))


def fused_rows(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What both searches find, in fused order, and all documents, with the columns that retrieval reads."""
    rows = documents(s, d).select("doc_id", F.col("text").alias("content"), F.col("source").alias("title"), "source", *(F.lit(None).cast("string").alias(c) for c in ("article_no", "article_title")))
    return rrf_fusion(s, d).select("query_id", "doc_id", F.col("rank").alias("position")).join(rows, "doc_id"), rows


@query()
def retrieve(s, d):
    asked = questions(s, d).withColumn("question", T.clean_question(F.col("question")))
    hits, rows = fused_rows(s, d)
    found = retrieve_rows(inject(hits, asked, rows), asked)
    return found.select("query_id", "rank", F.sha2("content", 256).alias("h"), "source", "rerank_score", "strong_match")


FIRST_WORDS = "list_slice(string_split(text, ' '), 1, 2)"


@query(f"""WITH {BM25_CTE}, r AS (SELECT query_id, rank, source, doc_id, {NORM.format(x="text")} AS n FROM bm JOIN documents USING (doc_id)),
e AS (SELECT item_id AS query_id, 'src' || (item_id % 5) AS ed, item_id % 3 + 1 AS ea, {FIRST_WORDS} AS terms FROM benchmark),
j AS (SELECT e.query_id, e.terms, r.rank, r.n, coalesce(contains(r.source, e.ed), false) AS doc, coalesce(r.doc_id % 4 = e.ea, false) AS art FROM e LEFT JOIN r USING (query_id)),
g AS (SELECT query_id, any_value(terms) AS terms, coalesce(string_agg(n, ' ' ORDER BY rank), '') AS hay,
{", ".join(f"max(CASE WHEN {c} AND rank <= {k} THEN 1 ELSE 0 END) AS {name}_hit_{k}" for c, name in (("doc", "document"), ("art", "article")) for k in (1, 3, 5))} FROM j GROUP BY query_id)
SELECT * EXCLUDE (terms, hay), CASE WHEN len(list_filter(terms, lambda x: NOT contains(hay, {NORM.format(x="x")}))) = 0 THEN 1 ELSE 0 END AS expected_terms_hit_5 FROM g""")
def retrieval_evaluation(s, d):
    rows = documents(s, d).select("doc_id", "source", F.lit(None).cast("string").alias("title"), F.col("text").alias("content"), F.expr("nullif(doc_id % 4, 0)").alias("article_no"))
    expected = table(s, d, "benchmark").select(
        F.col("item_id").alias("query_id"), F.array(F.concat(F.lit("src"), F.col("item_id") % 5)).alias("expected_documents"),
        (F.col("item_id") % 3 + 1).alias("expected_article_no"), F.slice(F.split("text", " "), 1, 2).alias("expected_terms"),
    )
    return evaluate.evaluation(bm25_topk(s, d).join(rows, "doc_id"), expected)


# ---- normalisers, filters, cleaning ---------------------------------------


@query(f"SELECT doc_id, sha256({NORM.format(x='text')}) AS h FROM documents")
def normalize_eval(s, d):
    return documents(s, d).select("doc_id", F.sha2(T.casefold(F.translate(F.coalesce("text", F.lit("")), T.TURKISH, T.PLAIN)), 256).alias("h"))


@query(f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({TOKENS.format(x='text')}) AS term FROM documents) GROUP BY term HAVING count(*) >= 20")
def tokenize_counts(s, d):
    return tokenize_counts_whole(s, d).where("n >= 20")


@query(f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({TOKENS.format(x='text')}) AS term FROM documents) GROUP BY term")
def tokenize_counts_whole(s, d):
    each = documents(s, d).select("doc_id", F.explode(T.tokenize(F.col("text"))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("k"))
    return each.groupBy("term").agg(F.sum("k").alias("n"), F.count("*").alias("docs"))


STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


@query(f"""WITH t AS (SELECT doc_id, {STRIP.format(x='text')} AS s FROM documents), l AS (SELECT doc_id, s, len(list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '\\S'))) AS n FROM t)
SELECT doc_id, length(s) < 200 OR (n > 5 AND length(s) / n < 15) AS junk, length(s) >= 120 AS good FROM l""")
def junk_filter(s, d):
    return documents(s, d).select("doc_id", T.is_junk(F.col("text")).alias("junk"), T.quality_gate(F.col("text")).alias("good"))


@query(f"""SELECT doc_id, sha256({STRIP.format(x=r"regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '(?m)^([ \t]*[\p{L}\p{N}_ ]{1,30}[ \t]*\|)+[ \t]*[\p{L}\p{N}_ ]{1,30}[ \t]*$', '', 'g')")}) AS h FROM documents""")
def clean_markdown(s, d):
    return documents(s, d).select("doc_id", F.sha2(T.clean_markdown(F.col("text")), 256).alias("h"))


@query(r"WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS y FROM documents) SELECT doc_id, CASE WHEN length(y) <= 500 THEN y ELSE rtrim(left(y, 497)) || '...' END AS cut, CASE WHEN length(y) <= 500 THEN y ELSE left(y, 500) || '...' END AS added FROM c")
def compact_preview(s, d):
    return documents(s, d).select("doc_id", T.preview_cut(F.col("text")).alias("cut"), T.preview_append(F.col("text")).alias("added"))


# ---- pages and links ------------------------------------------------------

DECODE = "replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"
LINKS = f"""
h AS (SELECT page_id, url AS base, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS href FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"''>]*)["'']', 1) AS a FROM pages)),
g AS (SELECT page_id, pos, base, trim({DECODE.format(x="href")}) AS href FROM h),
ab AS (SELECT page_id, pos, regexp_extract(base, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') || href AS u FROM g WHERE href LIKE '/%' AND href NOT LIKE '//%'),
nf AS (SELECT page_id, pos, regexp_replace(u, '#.*$', '') AS u FROM ab),
nn AS (SELECT page_id, pos, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')) AS f, substr(u, length(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')) + 1) AS r FROM nf),
links AS (SELECT page_id, CAST(min(pos) AS INTEGER) AS pos, f || CASE WHEN r = '/' THEN r ELSE regexp_replace(r, '/+$', '') END AS url FROM nn GROUP BY page_id, f || CASE WHEN r = '/' THEN r ELSE regexp_replace(r, '/+$', '') END)
"""


def linked(s: SparkSession, d: str) -> DataFrame:
    return html.links(table(s, d, "pages"))


@query(f"SELECT page_id, trim({DECODE.format(x="regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}) AS title FROM pages")
def html_title(s, d):
    return table(s, d, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query(f"WITH {LINKS} SELECT page_id, pos, url FROM links")
def html_links(s, d):
    return linked(s, d)


def with_pdfs(found: DataFrame) -> DataFrame:
    """Every fifth page's links as PDF files."""
    return found.withColumn("url", F.when(F.col("page_id") % 5 == 0, F.concat("url", F.lit(".pdf"))).otherwise(F.col("url")))


@query(f"""WITH {LINKS}, p AS (SELECT page_id, url || '.pdf' AS url FROM links WHERE page_id % 5 = 0)
SELECT url, count(DISTINCT page_id) AS pages, trim(regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$'), '(?i)\\.pdf$', ''), '[-_]+', ' ', 'g')) AS title FROM p GROUP BY url""")
def pdf_inventory(s, d):
    return html.pdf_inventory(with_pdfs(linked(s, d)))


@query()
def page_text(s, d):
    return table(s, d, "pages").select("page_id", html.page_text(F.col("html")).alias("content"))


@query()
def page_documents(s, d):
    return html.page_documents(table(s, d, "pages"))


@query(
    """WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS h, lower(url) AS l FROM pages),
c AS (SELECT *, regexp_extract(regexp_extract(regexp_replace(regexp_extract(regexp_replace(l, '^[a-z]+://[^/?#]*', ''), '^[^?#]*'), '/+$', ''), '[^/]*$'), '\\.[^.]*$') AS e FROM p)
SELECT page_id, CASE WHEN e IN ('.pdf', '.docx', '.xlsx', '.pptx', '.doc', '.xls') THEN 'document' WHEN e IN ('.jpg', '.jpeg', '.png', '.gif', '.svg', '.ico', '.webp', '.mp4', '.mp3', '.avi', '.mov', '.wmv', '.zip', '.rar', '.7z', '.tar', '.gz', '.css', '.js', '.map', '.woff', '.woff2', '.ttf', '.eot', '.otf', '.xml', '.rss', '.atom') THEN 'skip' ELSE 'text_page' END AS class,
h = 'example.com' OR h LIKE '%.example.com' AS inside, contains(l, '/en/') OR contains(l, '/login') OR contains(l, '/admin/') OR contains(l, '/en?') OR contains(l, '?lang=en') OR contains(l, '/api/') OR contains(l, 'tel:') AS excluded,
h <> '' AND (l LIKE 'http://%' OR l LIKE 'https://%') AS valid FROM c"""
)
def url_class(s, d):
    u = F.col("url")
    return table(s, d, "pages").select("page_id", U.url_class(u).alias("class"), U.in_domains(u, ["example.com"]).alias("inside"), U.is_excluded(u).alias("excluded"), U.is_valid(u).alias("valid"))


@query(f"""WITH {LINKS}, s AS (SELECT page_id, url, CAST(contains(lower(url), 'the') AS INTEGER) + CAST(contains(lower(url), 'and') AS INTEGER) AS score FROM links)
SELECT page_id, url, score, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, url) AS INTEGER) AS rank FROM s""")
def link_priority(s, d):
    return html.rank_links(linked(s, d), ("the", "and")).select("page_id", "url", "score", "rank")


# ---- enrichment -----------------------------------------------------------

DATED = "CASE doc_id % 4 WHEN 0 THEN '15.0' || CAST(doc_id % 9 + 1 AS VARCHAR) || '.2024 ' WHEN 1 THEN '2023-' || CAST(doc_id % 12 + 1 AS VARCHAR) || '-7 ' WHEN 2 THEN '3 Mart 2022 ' ELSE '' END || text"


def dated(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).withColumn("text", F.expr(DATED.replace("VARCHAR", "STRING")))


@query(f"""WITH t AS (SELECT doc_id, left({DATED}, 1000) AS h FROM documents),
x AS (SELECT doc_id, nullif(regexp_extract(h, '[0-9]{{1,2}}[./][0-9]{{1,2}}[./]20[0-9]{{2}}'), '') AS a, nullif(regexp_extract(h, '20[0-9]{{2}}-[0-9]{{1,2}}-[0-9]{{1,2}}'), '') AS b, nullif(regexp_extract(h, '[0-9]{{1,2}}\\s+(?:Ocak|Şubat|Mart|Nisan|Mayıs|Haziran|Temmuz|Ağustos|Eylül|Ekim|Kasım|Aralık)\\s+20[0-9]{{2}}'), '') AS c FROM t)
SELECT doc_id, coalesce(CASE WHEN a IS NOT NULL THEN coalesce(strftime(try_strptime(a, '%d.%m.%Y'), '%Y-%m-%d'), strftime(try_strptime(a, '%d/%m/%Y'), '%Y-%m-%d'), a) END, CASE WHEN b IS NOT NULL THEN coalesce(strftime(try_strptime(b, '%Y-%m-%d'), '%Y-%m-%d'), b) END, c) AS content_date FROM x""")
def extract_date(s, d):
    return dated(s, d).select("doc_id", enrich.extract_date(F.col("text")).alias("content_date"))


UNIT_URL = "'https://' || CASE doc_id % 5 WHEN 0 THEN 'fen.example.edu/x' WHEN 1 THEN 'www.example.edu/ogrenci/duyuru' WHEN 2 THEN 'example.edu/a/staj' WHEN 3 THEN 'kariyer.example.edu/takvim' ELSE 'abc.example.edu/q' END"


@query(f"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Fen Fakültesi' WHEN 1 THEN 'Öğrenci İşleri' WHEN 3 THEN 'Kariyer Merkezi' ELSE 'Genel' END AS unit,
CASE doc_id % 5 WHEN 0 THEN 'genel' WHEN 1 THEN 'duyuru' WHEN 2 THEN 'staj' WHEN 3 THEN 'akademik_takvim' ELSE 'genel' END AS doc_type,
CASE doc_id % 5 WHEN 0 THEN '[Bağlam: Fen Fakültesi — ' || source || ']' WHEN 1 THEN '[Bağlam: Öğrenci İşleri — ' || source || ' — Duyuru]' WHEN 2 THEN '[Bağlam: ' || source || ' — Staj]' WHEN 3 THEN '[Bağlam: Kariyer Merkezi — ' || source || ' — Akademik Takvim]' ELSE '[Bağlam: ' || source || ']' END AS summary
FROM (SELECT doc_id, source, {UNIT_URL} AS url FROM documents)""")
def enrich_chunks(s, d):
    rows = documents(s, d).select("doc_id", F.expr(UNIT_URL).alias("source"), F.col("source").alias("title"), F.lit("").alias("content"), F.lit(None).cast("string").alias("header_1"), F.lit(None).cast("string").alias("header_2"), F.lit(None).cast("string").alias("crawled_at"))
    return enrich.enrich(rows, now="2024-01-01T00:00:00+00:00").select("doc_id", "unit", "doc_type", "summary")


# ---- segmentation ---------------------------------------------------------


def headed(s: SparkSession, d: str) -> DataFrame:
    """Every fourth line, whole, as a header, of levels 1 to 3 in turn."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 4 == 0, F.concat(F.repeat(F.lit("#"), (F.floor(i / 4) % 3 + 1).cast("int")), F.lit(" "), x)).otherwise(x))
    return documents(s, d).select("doc_id", F.array_join(lines, "\n").alias("text"))


@query()
def header_sections(s, d):
    return chunk.header_sections(headed(s, d)).withColumn("route", chunk.section_route(F.length("content")))


@query()
def recursive_chunks(s, d):
    return chunk.recursive_chunks(documents(s, d))


@query()
def semantic_chunks(s, d):
    return chunk.semantic_chunks(documents(s, d))


def articled(s: SparkSession, d: str) -> DataFrame:
    """Every third line opens an article; in documents with an even id the numbers run to 3 and begin again."""
    number = lambda i: F.when(F.col("doc_id") % 2 == 0, F.floor(i / 3) % 3 + 1).otherwise(F.floor(i / 3) + 1).cast("string")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("MADDE "), number(i), F.lit(" - "), x)).otherwise(x))
    return documents(s, d).select("doc_id", "source", F.array_join(lines, "\n").alias("text"))


ARTICLED = """
l0 AS (SELECT doc_id, source, generate_subscripts(a, 1) - 1 AS i, unnest(a) AS x FROM (SELECT doc_id, source, string_split(text, chr(10)) AS a FROM documents)),
l1 AS (SELECT doc_id, source, i, CASE WHEN i % 3 = 0 THEN 'MADDE ' || CAST(CASE WHEN doc_id % 2 = 0 THEN (i // 3) % 3 + 1 ELSE i // 3 + 1 END AS VARCHAR) || ' - ' || x ELSE x END AS x FROM l0)
"""


@query(f"""WITH {ARTICLED}, n AS (SELECT doc_id, i, x, nullif(regexp_extract(x, '(?i)^[ \\t]*MADDE\\s+(\\d+)', 1), '') AS no FROM l1),
q AS (SELECT *, sum(CAST(no IS NOT NULL AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS seq FROM n)
SELECT doc_id, CAST(seq AS BIGINT) AS seq, max(no) AS article_no, sha256(regexp_replace(string_agg(regexp_replace(x, '\\s+$', ''), chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g')) AS h FROM q WHERE seq > 0 GROUP BY doc_id, seq""")
def article_split(s, d):
    return legal.split_articles(articled(s, d)).select("doc_id", "seq", "article_no", F.sha2("content", 256).alias("h"))


@query()
def article_titles(s, d):
    return legal.split_articles(articled(s, d)).select("doc_id", "seq", "article_no", "article_title", "title_source")


@query()
def article_pages(s, d):
    pages = articled(s, d).withColumn("page", F.col("doc_id").cast("int"))
    return legal.split_pages(pages).select("source", "seq", "article_no", "page_start", "page_end", F.sha2("content", 256).alias("h"))


@query()
def article_dedup(s, d):
    return legal.dedup_articles(legal.split_articles(articled(s, d))).select("doc_id", "seq", "article_no", "first_seq", "duplicate_source_count", "duplicate_warning")


@query(f"WITH {ARTICLED} SELECT doc_id, CASE WHEN count(DISTINCT regexp_extract(x, '(?i)^[ \\t]*MADDE\\s+(\\d+)', 1)) FILTER (WHERE regexp_matches(x, '(?i)^[ \\t]*MADDE\\s+\\d+')) >= 2 THEN 'legal' ELSE 'fallback' END AS route FROM l1 GROUP BY doc_id")
def legal_detector(s, d):
    return legal.route(articled(s, d)).select("doc_id", "route")


# ---- store ----------------------------------------------------------------


def tall(s: SparkSession, d: str) -> DataFrame:
    none = lambda t: F.lit(None).cast(t)
    entry = lambda k, st, i, fl, b: F.struct(F.lit(k).alias("key"), st.alias("string_value"), i.alias("int_value"), fl.alias("float_value"), b.alias("bool_value"))
    rows = F.array(
        entry("source", F.col("source"), none("bigint"), none("double"), none("boolean")), entry("n_chars", none("string"), F.col("n_chars"), none("double"), none("boolean")),
        entry("long", none("string"), none("bigint"), none("double"), F.col("n_chars") > 1000),
    )
    return documents(s, d).select(F.col("doc_id").alias("id"), F.explode(rows).alias("e")).select("id", "e.*")


@query("SELECT doc_id AS id, source, CAST(n_chars AS VARCHAR) AS n_chars, CASE WHEN n_chars > 1000 THEN 'true' ELSE 'false' END AS long FROM documents")
def eav_pivot(s, d):
    return store.pivot_metadata(tall(s, d), ["source", "n_chars", "long"])


@query("SELECT doc_id AS id, source || '|' || CAST(n_chars AS VARCHAR) || '|' || CASE WHEN n_chars > 1000 THEN 'true' ELSE 'false' END AS all_values FROM documents")
def eav_typed_value(s, d):
    made = store.metadata_map(tall(s, d))
    return made.select("id", F.concat_ws("|", F.col("metadata")["source"], F.col("metadata")["n_chars"], F.col("metadata")["long"]).alias("all_values"))


def as_chunks(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).select(F.col("doc_id").alias("chunk_id"), "source", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Title "), "source")).alias("title"), F.col("lang").alias("source_type"), F.lit(None).cast("string").alias("unit"), "doc_id", "text")


@query("""SELECT source, count(*) AS chunks, CASE WHEN bool_or(doc_id % 3 = 0) THEN 'Title ' || source END AS title, arg_min(lang, doc_id) AS source_type FROM documents GROUP BY source""")
def source_inventory(s, d):
    return report.source_inventory(as_chunks(s, d))


@query("""SELECT 'total' AS dimension, NULL AS value, count(*) AS chunks FROM documents UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source UNION ALL SELECT 'source_type', lang, count(*) FROM documents GROUP BY lang""")
def coverage_grouping_sets(s, d):
    return report.coverage(as_chunks(s, d), ["source", "source_type", "unit"])


@query(f"""WITH {ARTICLED}, n AS (SELECT source, doc_id, i, nullif(regexp_extract(x, '(?i)^[ \\t]*MADDE\\s+(\\d+)', 1), '') AS no FROM l1),
f AS (SELECT source, no, min(doc_id * 1000000 + i) AS pos, count(*) AS n FROM n WHERE no IS NOT NULL GROUP BY source, no)
SELECT source, CAST(sum(n) AS BIGINT) AS chunk_count, count(*) AS article_count, array_to_string(list(no ORDER BY pos)[1:10], ',') AS first_articles, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_numbers FROM f GROUP BY source""")
def source_article_stats(s, d):
    arts = legal.split_articles(articled(s, d)).join(documents(s, d).select("doc_id", "source"), "doc_id")
    return report.article_stats(arts.withColumn("pos", F.col("doc_id") * 1000000 + F.col("start_line")))


@query("SELECT count(*) AS chunks, count(DISTINCT source) AS sources, CASE WHEN count(*) = 0 THEN 'empty' ELSE 'ok' END AS status FROM documents")
def health_report(s, d):
    return report.health(documents(s, d))


@query("SELECT 'src' || CAST(i AS VARCHAR) AS url FROM range(0, 40) t(i) WHERE 'src' || CAST(i AS VARCHAR) NOT IN (SELECT source FROM documents)")
def manifest_missing(s, d):
    return report.missing_from(s.range(40).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("url")), documents(s, d))


EXPECTED = ((1, ["the", "example"]), (2, ["/fr/", "page=2", "ref"]), (3, []), (4, ["nowhere"]))


def expected(s: SparkSession) -> DataFrame:
    return s.createDataFrame(EXPECTED, "id int, keywords array<string>")


EXPECTED_SQL = "e AS (SELECT * FROM (VALUES (1, ['the', 'example']), (2, ['/fr/', 'page=2', 'ref']), (3, []::VARCHAR[]), (4, ['nowhere'])) t(id, keywords))"


@query(f"""WITH {EXPECTED_SQL}, m AS (SELECT DISTINCT id, url FROM e, pages WHERE len(list_filter(keywords, lambda k: contains(lower(url), k))) >= least(2, len(keywords))),
c AS (SELECT id, count(*) AS u, array_to_string(list(url ORDER BY url)[1:10], ' ') AS urls FROM m GROUP BY id),
n AS (SELECT id, count(*) AS matches FROM e, pages WHERE len(list_filter(keywords, lambda k: contains(lower(url), k))) >= least(2, len(keywords)) GROUP BY id)
SELECT e.id, coalesce(matches, 0) AS matches, coalesce(urls, '') AS urls FROM e LEFT JOIN c USING (id) LEFT JOIN n USING (id)""")
def expected_url_match(s, d):
    return report.expected_urls(table(s, d, "pages"), expected(s))


@query(f"""WITH {EXPECTED_SQL}, h AS (SELECT string_agg(lower(url), ' ') AS t FROM pages) SELECT id, len(keywords) > 0 AND len(list_filter(keywords, lambda k: contains(t, k))) >= least(2, len(keywords)) AS found FROM e, h""")
def expected_coverage(s, d):
    return report.expected_coverage(table(s, d, "pages").select(F.col("url").alias("source"), F.lit("").alias("title")), expected(s))


@query("""WITH b AS (SELECT * FROM (VALUES (true), (false)) t(v)), r AS (SELECT * FROM (VALUES (true), (false), (NULL)) t(v)),
x AS (SELECT a.v AS active, p.v AS requires_permission, i.v AS include_inactive, m.v AS authorized_mode, o.v AS robots_override, r.v AS robots_allowed FROM b a, b p, b i, b m, b o, r),
y AS (SELECT *, CASE WHEN NOT active AND NOT include_inactive THEN 'inactive' WHEN requires_permission AND NOT authorized_mode THEN 'requires_permission' WHEN robots_allowed = false AND NOT (authorized_mode AND robots_override) THEN 'robots' ELSE 'none' END AS blocked_by FROM x)
SELECT *, blocked_by = 'none' AS can_fetch FROM y""")
def access_policy(s, d):
    flags = [F.explode(F.array(F.lit(True), F.lit(False))).alias(c) for c in ("active", "requires_permission", "include_inactive", "authorized_mode", "robots_override")]
    rows = s.range(1).select(F.explode(F.array(F.lit(True), F.lit(False), F.lit(None).cast("boolean"))).alias("robots_allowed"))
    for f in flags:
        rows = rows.select("*", f)
    return report.access(rows)


def snapshot(s: SparkSession, d: str) -> DataFrame:
    """An earlier state: two thirds of the documents, half of those with another hash."""
    hashed = F.when(F.col("doc_id") % 3 == 1, F.lit("old")).otherwise(F.sha2("text", 256))
    return documents(s, d).where("doc_id % 3 <> 0").select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.lit("success").alias("status"), F.lit("2024-01-01").alias("crawled_at"), hashed.alias("content_hash"), F.lit(0).alias("seq"))


def crawled(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.sha2("text", 256).alias("content_hash"))


@query("SELECT 'u' || CAST(doc_id AS VARCHAR) AS url, CASE doc_id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'changed' ELSE 'same' END AS change FROM documents")
def cdc_classify(s, d):
    return store.classify_changes(crawled(s, d), snapshot(s, d)).select("url", "change")


@query("SELECT 'u' || CAST(doc_id AS VARCHAR) AS source, CASE doc_id % 3 WHEN 2 THEN 'stored' ELSE 'fetched' END AS origin FROM documents")
def cdc_apply(s, d):
    kept = snapshot(s, d).select(F.col("url").alias("source"), F.lit("stored").alias("origin"))
    fresh = crawled(s, d).select(F.col("url").alias("source"), F.lit("fetched").alias("origin"))
    return store.apply_changes(kept, store.classify_changes(crawled(s, d), snapshot(s, d)), fresh)


@query("SELECT 'u' || CAST(doc_id AS VARCHAR) AS url, CASE WHEN doc_id % 4 = 0 THEN 'error' ELSE 'success' END AS status, CASE doc_id % 3 WHEN 1 THEN 'old' ELSE sha256(text) END AS content_hash FROM documents WHERE doc_id % 3 <> 0")
def purge_failed(s, d):
    failed = documents(s, d).where("doc_id % 4 = 0").select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"))
    _, state = store.purge_failed(snapshot(s, d).select(F.col("url").alias("source")), snapshot(s, d), failed)
    return state.select("url", "status", "content_hash")


@query("""SELECT 'u' || CAST(doc_id AS VARCHAR) AS url, CASE WHEN doc_id % 2 = 0 THEN 'error' ELSE 'success' END AS status,
CASE WHEN doc_id % 2 = 0 THEN CASE doc_id % 3 WHEN 1 THEN 'old' WHEN 2 THEN sha256(text) END WHEN doc_id % 3 = 1 THEN 'old' ELSE sha256(text) END AS content_hash FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 <> 0""")
def upsert_state(s, d):
    incoming = documents(s, d).where("doc_id % 2 = 0").select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.lit("error").alias("status"), F.lit("2024-02-01").alias("crawled_at"), F.lit(None).cast("string").alias("content_hash"), F.lit(1).alias("seq"))
    return store.upsert(snapshot(s, d), incoming).select("url", "status", "content_hash")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash, count(*) AS copies FROM documents GROUP BY text")
def dedup_exact(s, d):
    return store.dedup_exact(documents(s, d))


@query("SELECT source, CAST(doc_id % 10 AS INTEGER) AS page, left(text, 120) AS head, min(doc_id) AS doc_id FROM documents GROUP BY ALL")
def dedup_composite(s, d):
    return store.dedup_composite(documents(s, d).withColumn("page", (F.col("doc_id") % 10).cast("int")))


@query("SELECT event_id FROM events WHERE event_type IN (SELECT min(event_type) FROM events) AND floor((epoch(TIMESTAMP '2030-01-01') - epoch(ts)) / 86400) > (SELECT floor((epoch(TIMESTAMP '2030-01-01') - epoch(max(ts))) / 86400) + 10 FROM events)")
def stale_expiry(s, d):
    e = table(s, d, "events")
    now = datetime(2030, 1, 1)
    last, first = e.agg(F.max("ts").cast("timestamp_ntz"), F.min("event_type")).first()
    crawled = F.concat(F.col("ts").cast("timestamp_ntz").cast("string"), F.lit("Z"))  # with its parts of a second
    rows = e.select("event_id", F.when(F.col("event_type") == first, "duyuru").otherwise("genel").alias("doc_type"), crawled.alias("crawled_at"))
    return store.stale(rows, f"{now}Z", days=(now - (last or now)).days + 10).select("event_id")


# ---- graph ----------------------------------------------------------------


def page_edges(s: SparkSession, d: str) -> DataFrame:
    """Links between hosts' pages: to a page's links, and from a link to the page whose id is the link's length modulo 40."""
    urls = table(s, d, "pages").select("page_id", F.col("url").alias("src"))
    out = linked(s, d).join(urls, "page_id").select("src", F.col("url").alias("dst"))
    back = linked(s, d).select(F.col("url").alias("src"), (F.length("url") % 40).cast("long").alias("page_id")).join(urls.withColumnRenamed("src", "dst"), "page_id").select("src", "dst")
    return materialize(out.union(back).distinct(), "edges")


EDGES = f"""{LINKS}, ed AS (SELECT DISTINCT p.url AS src, l.url AS dst FROM links l JOIN pages p USING (page_id) UNION SELECT l.url, p.url FROM links l JOIN pages p ON p.page_id = length(l.url) % 40)"""


@query(f"""WITH RECURSIVE {EDGES}, b(url, depth) AS (SELECT url, 0 FROM pages WHERE page_id = 0 UNION SELECT ed.dst, depth + 1 FROM b JOIN ed ON ed.src = b.url WHERE depth < 4)
SELECT url, min(depth) AS depth FROM b GROUP BY url""")
def bfs_depth(s, d):
    return graph.depths(page_edges(s, d), table(s, d, "pages").where("page_id = 0").select("url"), max_depth=4)


@query()
def bfs_budgeted(s, d):
    e = page_edges(s, d)
    seeds = table(s, d, "pages").where("page_id = 0").select("url")
    ok = e.select(F.col("src").alias("url")).distinct()
    return graph.crawl(e, seeds, ok, domains=["example.com"], max_depth=4, max_pages=50)


# ---- reports and prompts ----------------------------------------------------


@query("""WITH a AS (SELECT source, count(*) AS n FROM documents GROUP BY source), b AS (SELECT source, count(*) AS n FROM documents WHERE doc_id % 2 = 0 AND source <> 'src1' GROUP BY source)
SELECT a.source, a.n AS current, b.n AS baseline, a.n - b.n AS delta FROM a LEFT JOIN b USING (source)""")
def report_delta(s, d):
    count = lambda df: df.groupBy("source").agg(F.count("*").alias("n"))
    return evaluate.delta(count(documents(s, d)), count(documents(s, d).where("doc_id % 2 = 0 AND source <> 'src1'")), "source", "n")


def _stripped(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g')"


def _listed(x: str) -> str:
    n = f"regexp_replace(replace(strip_accents(lower({x})), 'ı', 'i'), '\\s+', ' ', 'g')"
    items = f"len(regexp_extract_all({n}, '\\b[0-9]+\\.\\s+.*?\\bparca\\b'))"
    return f"(contains({n}, '{prompt.LISTING_PHRASE}') OR regexp_matches({n}, 'toplam:\\s*[0-9]+\\s+benzersiz kaynak') OR {items} >= 8)"


def _tail(x: str, limit: int) -> str:
    return f"CASE WHEN length({x}) <= {limit} THEN {x} ELSE '[gecmis kisaltildi]' || chr(10) || right({x}, {limit} - 20) END"


HISTORY_TURNS = "SELECT conv_id, turn, role, CASE WHEN conv_id % 5 = 0 AND turn = 0 THEN 'Toplam: 12 benzersiz kaynak' WHEN conv_id % 5 = 1 THEN repeat(coalesce(text, '') || ' ', 9) ELSE coalesce(text, '') END AS text FROM conversations"


@query(f"""WITH t AS ({HISTORY_TURNS}), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM t),
m AS (SELECT conv_id, turn, coalesce(role, '') || ': ' || CASE WHEN {_listed("text")} THEN '{prompt.LISTED_TURN}' ELSE {_tail("text", 800)} END AS x FROM r WHERE b <= 6),
h AS (SELECT conv_id, {_stripped("string_agg(x, chr(10) ORDER BY turn)")} AS h FROM m GROUP BY conv_id),
l AS (SELECT conv_id, h, unnest(string_split(h, chr(10))) AS line, generate_subscripts(string_split(h, chr(10)), 1) AS i FROM h),
f AS (SELECT *, {_listed("line")} AS listed, min(CASE WHEN {_listed("line")} THEN i END) OVER (PARTITION BY conv_id) AS first FROM l),
k AS (SELECT conv_id, any_value(h) AS h, {_stripped(f"coalesce(string_agg(CASE WHEN listed THEN '{prompt.LISTED_HISTORY}' ELSE line END, chr(10) ORDER BY i) FILTER (WHERE NOT listed OR i = first), '')")} AS kept FROM f GROUP BY conv_id)
SELECT conv_id, CASE WHEN h = '' THEN '' WHEN {_listed("h")} THEN '{prompt.LISTED_HISTORY}' ELSE {_tail("kept", 2500)} END AS history FROM k""")
def chat_history(s, d):
    text = F.coalesce("text", F.lit(""))
    said = F.when(F.expr("conv_id % 5 = 0 AND turn = 0"), "Toplam: 12 benzersiz kaynak").when(F.expr("conv_id % 5 = 1"), F.repeat(F.concat(text, F.lit(" ")), 9)).otherwise(text)
    return prompt.chat_history(table(s, d, "conversations").withColumn("text", said))


@query(f"""WITH {BM25_CTE}, c AS (
  SELECT query_id, rank, text, doc_id, CASE WHEN doc_id % 3 = 0 THEN 'https://www.example.edu/' || source || '/a.pdf' WHEN doc_id % 3 = 1 THEN '' ELSE source || '.pdf' END AS src,
    CASE WHEN doc_id % 7 = 0 THEN 'Y%C3%B6nerge_1234567890.pdf' ELSE '' END AS title, source FROM bm JOIN documents USING (doc_id)),
b AS (SELECT query_id, rank, concat_ws(chr(10),
    '[' || rank || '] Kaynak: ' || CASE WHEN title <> '' THEN 'Yönerge' WHEN doc_id % 3 = 0 THEN 'www.example.edu' WHEN doc_id % 3 = 1 THEN 'Bilinmeyen Belge' ELSE source END,
    CASE WHEN doc_id % 2 = 0 THEN 'Madde: ' || (doc_id % 50) || CASE WHEN doc_id % 4 = 0 THEN ' - Amaç' ELSE '' END END,
    CASE WHEN doc_id % 5 < 3 THEN 'Sayfa: ' || (doc_id % 9 + 1) || CASE WHEN doc_id % 5 = 1 THEN '-' || (doc_id % 9 + 2) ELSE '' END END,
    CASE WHEN doc_id % 3 = 0 THEN 'URL: ' || src END, 'İçerik:', text) AS block FROM c),
t AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS c FROM b GROUP BY query_id)
SELECT query_id, CASE WHEN length(c) > 5000 THEN left(c, 5000) || chr(10) || '...[bağlam kısaltıldı]' ELSE c END AS context FROM t""")
def context_builder(s, d):
    pick = lambda condition, value: F.when(F.expr(condition), F.expr(value))
    rows = bm25_topk(s, d).join(documents(s, d).select("doc_id", "source", F.col("text").alias("content")), "doc_id")
    rows = rows.withColumns({
        "source": pick("doc_id % 3 = 0", "concat('https://www.example.edu/', source, '/a.pdf')").when(F.expr("doc_id % 3 = 1"), "").otherwise(F.concat("source", F.lit(".pdf"))),
        "title": pick("doc_id % 7 = 0", "'Y%C3%B6nerge_1234567890.pdf'"), "article_no": pick("doc_id % 2 = 0", "doc_id % 50"), "article_title": pick("doc_id % 4 = 0", "'Amaç'"),
        "page": pick("doc_id % 5 = 0", "doc_id % 9 + 1"), "page_start": pick("doc_id % 5 IN (1, 2)", "doc_id % 9 + 1"), "page_end": pick("doc_id % 5 = 1", "doc_id % 9 + 2"),
    })
    return prompt.context(rows)


@query(r"""WITH a AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations),
p AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN t || chr(10) || '- https://x.example.edu/a.pdf with words' || chr(10) || 'gone' || chr(10) || chr(10) || 'kept' ELSE t END AS t FROM a)
SELECT conv_id, turn, regexp_replace(t, '^\s+|\s+$', '', 'g') AS answer FROM (
  SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN regexp_replace(t, '\n- https://x[^\n]*\ngone\n\n', chr(10)) ELSE t END AS t FROM p)""")
def strip_sources(s, d):
    linked_ = F.when(F.expr("conv_id % 2 = 0"), "\n- https://x.example.edu/a.pdf with words\ngone\n\nkept").otherwise("")
    made = F.concat(F.coalesce("text", F.lit("")), linked_, F.lit("\n## kaynaklar :\n- a.pdf\n\nhttps://y.example.edu/b.pdf"))
    return table(s, d, "conversations").select("conv_id", "turn", prompt.strip_sources(made).alias("answer"))


# ---- streams --------------------------------------------------------------


@query("SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_window_counts(s, d):
    return changes.window_counts(table(s, d, "events")).withColumn("window_start", F.unix_micros("window_start"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL '30 minutes' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g)
SELECT user_id, epoch_us(min(ts)) AS session_start, count(*) AS n FROM k GROUP BY user_id, i""")
def stream_session(s, d):
    return changes.sessions(table(s, d, "events")).withColumn("session_start", F.unix_micros("session_start"))
