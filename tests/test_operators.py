import json
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import url as U
from tessera.operators import chunk, enrich, evaluate, graph, html, legal, prompt, rank, report, rerank, store
from tessera.plans import catalogue
from tessera.sources import manifest, pages, pdf, sinks
from tessera.streaming import changes

DIR = "/root/testdata/sf0.001"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("value", ["ÖĞRENCİ İşleri  ", "I ı İ i", "Stra%C3%9Fe", "a+b%2", None, "Âlim  ŞEKİL"])
def test_native_rerank_form_equals_the_exact_one(spark, value):
    native, exact = spark.createDataFrame([(value,)], "x string").select(T.normalize_rerank(F.col("x")), T.normalize_exact("x")).first()
    assert native == exact


def test_normalisers_differ(spark):
    assert one(spark, "ISPARTA %C4%B0", T.normalize_eval) == "isparta i"
    assert one(spark, "ISPARTA", T.normalize_filter) == "isparta"
    assert one(spark, "a+b%zz%20", T.unquote) == "a+b%zz "
    assert one(spark, "Tez nasıl olur ve doktora", T.query_tokens) == ["tez", "olur", "doktora"] or one(spark, "Tez nasıl ve doktora", T.query_tokens) == ["tez", "doktora"]


def test_question_cleaning(spark):
    assert one(spark, '1. "AKTS   nedir?"', T.clean_question) == "AKTS nedir?"


def test_urls(spark):
    assert one(spark, "HTTP://A.Example.com/X/#f", U.normalize_crawl) == "http://a.example.com/X"
    assert one(spark, "http://a.com/", U.normalize_crawl) == "http://a.com/"
    assert one(spark, "http://a.com/f.PDF/", U.url_class) == "document"
    assert one(spark, "http://a.com/f.png?x=.pdf", U.url_class) == "skip"
    assert one(spark, "https://x.b.com:8080/", lambda u: U.in_domains(u, ["b.com"])) is True
    assert one(spark, "https://xb.com/", lambda u: U.in_domains(u, ["b.com"])) is False
    assert one(spark, "ftp://b.com/", U.is_valid) is False


LEGAL = "BİRİNCİ BÖLÜM\nTanımlar\nMADDE 4 - (1) AKTS sistemi. Devam.\nikinci satır\nMADDE 5 – Esaslar\nMetin."


def test_articles(spark):
    docs = spark.createDataFrame([(1, LEGAL), (2, "MADDE 1 - Amaç\nBirinci.\n\n[Bağlam: eski]\nMADDE 2 - Kapsam\nİkinci."), (3, None)], "doc_id long, text string")
    rows = {(r.doc_id, r.article_no): r for r in legal.split_articles(docs).collect()}
    assert set(rows) == {(1, "4"), (1, "5"), (2, "1"), (2, "2")}
    assert (rows[1, "4"].article_title, rows[1, "4"].title_source) == ("Tanımlar", "preceding_heading")
    assert rows[1, "4"].content == "MADDE 4 - (1) AKTS sistemi. Devam.\nikinci satır"
    assert "Bağlam" not in rows[2, "1"].content
    assert [r.route for r in legal.route(docs).orderBy("doc_id").collect()] == ["legal", "legal", "fallback"]


def test_page_bounds(spark):
    p = spark.createDataFrame([("s", 1, "MADDE 1 - Amaç\nMetin"), ("s", 2, "devam eder.\nMADDE 2 - Kapsam\nSon.")], "source string, page int, text string")
    rows = {r.article_no: (r.page_start, r.page_end) for r in legal.split_pages(p).collect()}
    assert rows == {"1": (1, 2), "2": (2, 2)}


def test_article_dedup(spark):
    a = spark.createDataFrame([(1, 0, "58", "kısa metin"), (1, 1, "58", "uzun kısa metin burada"), (1, 2, "57", "elma armut"), (1, 3, "57", "başka bir konu")], "doc_id long, seq long, article_no string, content string")
    rows = legal.dedup_articles(a).collect()
    assert sorted((r.article_no, r.seq, r.duplicate_warning) for r in rows) == [("57", 2, "duplicate_articles_kept_distinct"), ("57", 3, "duplicate_articles_kept_distinct"), ("58", 1, "deduplicated_contained_articles")]


def test_headers_and_recursion(spark):
    d = spark.createDataFrame([(1, "önce\n# A\nx\n## B\ny\n# C\nz")], "doc_id long, text string")
    rows = chunk.header_sections(d).orderBy("section").collect()
    assert [(r.header_1, r.header_2, r.content) for r in rows] == [(None, None, "önce"), ("A", None, "# A\nx"), ("A", "B", "## B\ny"), ("C", None, "# C\nz")]
    parts = chunk.split_recursive("w " * 2000, 100, 20)
    assert all(len(p) <= 100 for p in parts) and len(parts) > 40
    assert chunk.split_recursive("x" * 3000) == ["x" * 3000]


def test_rule_scores(spark):
    rows = spark.createDataFrame(
        [("AKTS nedir?", "AKTS: Avrupa Kredi Transfer Sistemi", "Tanımlar", "4", "Lisansüstü Yönetmelik", ""), ("Merhaba", None, None, None, None, None)],
        "question string, content string, article_title string, article_no string, title string, source string",
    ).withColumn("base", F.lit(0.0))
    a, b = rerank.score_rows(rows).orderBy(F.desc("rerank_score")).collect()
    # 8 + 5 (definition) + 8 + 20 + 8 + 8 + 25 (akts) + 10 + 5 + 5 (acronym)
    assert a.rerank_score == 102.0 and a.strong_match and a.intent == "definition"
    assert b.rerank_score == 0.0 and not b.strong_match
    assert rerank.variant_allowed(F.lit("a"), F.lit("b")) is not None


def test_enrichment(spark):
    assert one(spark, "son 15.09/2024", enrich.extract_date) == "15.09/2024"
    assert one(spark, "2024-9-5 ve 01.02.2023", enrich.extract_date) == "2023-02-01"
    assert one(spark, "31.02.2024", enrich.extract_date) == "31.02.2024"
    assert one(spark, None, enrich.extract_date) is None


def test_html(spark):
    page = "<html><head><title>A &amp; B</title><script>x</script></head><body><nav>menu</nav><article><h1>Baş <b>lık</b></h1><p>metin</p></article><a href='/x#y'>l</a><a href='mailto:q'>m</a></body></html>"
    d = spark.createDataFrame([(1, "http://h.com/a/b", page)], "page_id long, url string, html string")
    assert d.select(html.title(F.col("html")), html.first_heading(F.col("html"))).first()[:] == ("A & B", "Baş lık")
    assert [r.url for r in html.links(d).collect()] == ["http://h.com/x"]
    assert "menu" not in d.select(html.page_text("html")).first()[0]


def test_changes_and_state(spark):
    state = spark.createDataFrame([("a", "h1"), ("b", "h2")], "url string, content_hash string")
    now = spark.createDataFrame([("a", "h1"), ("b", "x"), ("c", "y")], "url string, content_hash string")
    assert {r.url: r.change for r in store.classify_changes(now, state).collect()} == {"a": "same", "b": "changed", "c": "new"}
    full = "url string, status string, crawled_at string, content_hash string, seq int"
    old = spark.createDataFrame([("a", "success", "1", "h1", 0)], full)
    new = spark.createDataFrame([("a", "error", "2", None, 1), ("b", "success", "2", "h", 1)], full)
    assert {r.url: (r.status, r.content_hash) for r in store.upsert(old, new).collect()} == {"a": ("error", "h1"), "b": ("success", "h")}


def test_crawl_budget(spark):
    u = lambda x: f"http://a.com/{x}"
    e = spark.createDataFrame([(u("s"), u("1")), (u("s"), u("2")), (u("s"), u("d.pdf")), (u("s"), "http://z.org/"), (u("1"), u("s")), (u("1"), u("3"))], "src string, dst string")
    seeds = spark.createDataFrame([(u("s"),)], "url string")
    ok = spark.createDataFrame([(u("s"),), (u("1"),), (u("2"),)], "url string")
    rows = {r.url: r.outcome for r in graph.crawl(e, seeds, ok, domains=["a.com"], max_depth=2, max_pages=3).collect()}
    assert rows == {u("s"): "page", u("1"): "page", u("2"): "page", u("d.pdf"): "document", "http://z.org/": "out_of_domain", u("3"): "budget"}


def test_prompts(spark):
    assert one(spark, "Cevap.\nKaynaklar:\n- x", prompt.strip_sources) == "Cevap."
    assert one(spark, "request too large", prompt.error_class) == "prompt_size"
    assert one(spark, "x" * 30, lambda c: T.trim_tail(c, 20)) is not None


def test_hit_flags(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "query_id long, doc_id long, rank int")
    truth = spark.createDataFrame([(1, 11), (3, 5)], "query_id long, doc_id long")
    rows = {r.query_id: (r.hit_1, r.hit_3) for r in evaluate.hit_flags(ranked, truth).collect()}
    assert rows == {1: (0, 1), 3: (0, 0)}


def test_sources(spark, tmp_path):
    (tmp_path / "u.txt").write_text("http://a\n# no\n\nhttp://b\nhttp://a\n")
    assert [r.url for r in manifest.url_list(spark, str(tmp_path / "u.txt")).orderBy("pos").collect()] == ["http://a", "http://b"]
    (tmp_path / "m.json").write_text(json.dumps({"crawl_seeds": [{"id": "1", "url": "x"}], "known_direct_sources": [{"id": "2", "url": "x"}, {"id": "3", "url": "y", "active": False, "requires_permission": True}]}))
    items = manifest.manifest(spark, str(tmp_path / "m.json"))
    assert [r.id for r in manifest.enabled(items).collect()] == ["1"]
    assert sorted(r.id for r in manifest.enabled(items, True).collect()) == ["1", "3"]
    (tmp_path / "p.html").write_text("<p>hi</p>")
    spark.dataSource.register(pages.HttpPages)
    rows = spark.read.format("http_pages").option("urls", json.dumps([f"file://{tmp_path}/p.html", "nonsense"])).option("retries", 1).load().collect()
    assert {r.html for r in rows} == {"<p>hi</p>", None} and all(r.error for r in rows if r.html is None)
    (tmp_path / "a.pdf").write_bytes(b"one\fTwo\f \f")
    got = pdf.pdf_pages(spark, str(tmp_path), lambda b: b.decode().split("\f")).collect()
    assert sorted((r.page, r.text) for r in got) == [(1, "one"), (2, "Two")]


def test_sinks(spark, tmp_path):
    c = spark.createDataFrame([("s", 0, "t")], "source string, pos int, content string")
    sinks.write_store(sinks.with_chunk_id(c), str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 1
    with pytest.raises(ValueError):
        sinks.write_store(c.limit(0), str(tmp_path / "store"))
    with pytest.raises(ValueError):
        sinks.rebuild(c, "x/", "x")


def test_batched_stream(spark, tmp_path):
    spark.range(20).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    changes.ingest_in_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_window_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = changes.window_counts(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert spark.table("windows").count() == changes.window_counts(e).count()


def test_access(spark):
    rows = spark.createDataFrame([(True, False, False, False, False, None), (True, True, False, True, True, False)], "active boolean, requires_permission boolean, include_inactive boolean, authorized_mode boolean, robots_override boolean, robots_allowed boolean")
    assert [r.can_fetch for r in report.access(rows).collect()] == [True, True]


def test_headed_documents_are_whole(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = catalogue.headed(spark, DIR).join(docs.select("doc_id", F.col("text").alias("t")), "doc_id").collect()
    assert all([re.sub(r"^#{1,3} ", "", x) if i % 4 == 0 else x for i, x in enumerate(r.text.split("\n"))] == [re.sub(r"^#{1,3} ", "", x) if i % 4 == 0 else x for i, x in enumerate(r.t.split("\n"))] for r in rows)


def test_vector_queries_grow_with_the_table(spark):
    ids = {r.vec_id for r in spark.read.parquet(f"{DIR}/embeddings.parquet").where("vec_id % 100 = 0").collect()}
    assert {r.query_id for r in catalogue.vector_mmr(spark, DIR).collect()} == ids
    vectors = spark.read.parquet(f"{DIR}/embeddings.parquet")
    q = catalogue.every_hundredth(spark, DIR)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(rank.nearest_in_blocks(vectors, q, k=5, block=2)) == key(rank.nearest(vectors, q, k=5))


def test_rules_run_over_the_tables(spark):
    items = {r.item_id for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()}
    rows = catalogue.rerank_rules(spark, DIR).collect()
    hits = {(r.query_id, r.doc_id) for r in catalogue.bm25_topk(spark, DIR).collect()}
    assert {(r.q, r.doc_id) for r in rows} <= hits and len({r.doc_id for r in rows}) > 6 and len(rows) > len(hits)
    for made in (catalogue.query_intent_whole(spark, DIR), catalogue.acronyms_whole(spark, DIR)):
        assert {r.query_id for r in made.collect()} == items


def test_rules_over_stated_articles(spark):
    arts = [
        (1, "AKTS: Avrupa Kredi Transfer Sistemini ifade eder.", "4", "Tanımlar", "Lisansüstü Eğitim Yönetmeliği", "https://x.example.edu/lisansustu-yonetmelik.pdf"),
        (2, "Tez izleme komitesi üç öğretim üyesinden oluşur.", "44", "Tez izleme komitesi", "Lisansüstü Eğitim Yönetmeliği", "https://x.example.edu/a.pdf"),
        (6, "", None, "Yatay geçiş", None, None),
    ]
    rows = catalogue.asked(spark).crossJoin(spark.createDataFrame(arts, "a long, content string, article_no string, article_title string, title string, source string")).withColumn("base", F.lit(0.0))
    best = {}
    for r in rerank.score_rows(rows).collect():
        best[r.q] = max(best.get(r.q, (-1e9, 0)), (r.rerank_score, r.a))
    assert best[1][1] == 1 and best[2][1] == 2


def test_rare_terms_are_counted(spark):
    made = catalogue.tokenize_counts_whole(spark, DIR)
    assert made.where("n < 20").count() > 0 and made.where("n = 1").count() > 0


def test_robots_block_outside_the_budget(spark):
    e = spark.createDataFrame([("http://a.com/s", f"http://{h}/{p}") for h, p in (("no.a.com", "1"), ("no.a.com", "d.pdf"), ("un.a.com", "2"), ("a.com", "3"))] + [("http://no.a.com/1", "http://a.com/x")], "src string, dst string")
    seeds = spark.createDataFrame([("http://a.com/s",)], "url string")
    robots = spark.createDataFrame([("a.com", True), ("no.a.com", False), ("null.a.com", None)], "host string, allowed boolean")
    ok = e.select(F.col("dst").alias("url")).union(seeds)
    rows = {r.url: r.outcome for r in graph.crawl(e, seeds, ok, domains=["a.com"], max_depth=3, max_pages=2, robots=robots).collect()}
    assert rows == {"http://a.com/s": "page", "http://a.com/3": "page", "http://no.a.com/1": "robots_blocked", "http://no.a.com/d.pdf": "robots_blocked", "http://un.a.com/2": "robots_blocked"}
    urls = spark.createDataFrame([("http://no.a.com/1",), ("http://null.a.com/1",), ("http://un.a.com/1",)], "url string")
    assert {r.url: r.error for r in pages.scan(urls, robots).collect()} == {r.url: "robots_blocked" for r in urls.collect()}


def test_history_keeps_tails_and_notes_listings(spark):
    turns = [(1, 0, "user", "old"), (1, 1, "user", "x" * 900), (1, 2, "assistant", "Toplam: 7 benzersiz kaynak"), (1, 3, "user", None), (2, 0, "user", "merhaba")]
    made = {r.conv_id: r.history for r in prompt.chat_history(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"), max_pairs=2).collect()}
    assert made[1] == "\n".join(["user: old", "user: [gecmis kisaltildi]\n" + "x" * 780, f"assistant: {prompt.LISTED_TURN}", "user:"])
    assert made[2] == "user: merhaba"
    long = "\n".join(["a" * 30, "toplam:  3 benzersiz kaynak", "Toplam: 4 benzersiz kaynak", "b" * 30])
    assert one(spark, long, prompt.clean_history) == prompt.LISTED_HISTORY  # the whole text is one
    assert one(spark, "a" * 5000, prompt.clean_history) == "[gecmis kisaltildi]\n" + "a" * 2480
    assert one(spark, "  ", prompt.clean_history) == "" and one(spark, None, prompt.clean_history) == ""


def test_sources_labels_questions_and_errors(spark):
    answer = "Cevap [1].\n- https://a.example.edu/x ek metin\nbuna bagli satir\n\nkalan\n\n  ### KAYNAK : a\nb"
    assert one(spark, answer, prompt.strip_sources) == "Cevap [1].\nkalan"
    label = lambda t, s: spark.range(1).select(prompt.source_label(F.lit(t), F.lit(s))).first()[0]
    assert label("Y%C3%B6nerge_1234567890.PDF", "x") == "Yönerge_1234567890"[:7] and label(None, "https://a.example.edu/b/c.pdf") == "a.example.edu"
    assert label("", "dir\\sub/ad.pdf") == "ad" and label(None, None) == "Bilinmeyen Belge" and label("", "") == "Bilinmeyen Belge"
    asked = ["doktora yeterlik sınavı ne zaman yapılır", "onda tez izleme komitesi kimlerden oluşur", "az önce sorduğum doktora sınavı ne zaman", "bir iki üç dört", "devam et doktora yeterlik sinavi ne"]
    assert [one(spark, q, prompt.independent) for q in asked] == [True, False, False, False, False]
    said = ["Error 413", "Payload too large", "rate limit hit", "TPM exceeded", "requested 9 tokens over the limit", "Collection x does not exist", "error getting collection", "no such table", None]
    assert [one(spark, m, prompt.error_class) for m in said] == ["prompt_size"] * 5 + ["collection"] * 2 + ["other"] * 2
    assert one(spark, "-5 kredi", T.clean_question) == "-5 kredi" and one(spark, "+ 12 ) `AKTS` nedir", T.clean_question) == "AKTS` nedir"
    assert one(spark, "ﬁ ① x", T.clean_markdown) == "fi 1 x" and one(spark, "y" * 900, lambda c: T.trim_tail(c, 25)) == "[gecmis kisaltildi]\n" + "y" * 5
    assert one(spark, "Example AKTS kac", lambda c: T.query_tokens(c, ("example",))) == ["akts"]


def test_dedup_articles_share_and_pages(spark):
    rows = [(1, 0, "4", " ".join(f"w{i}" for i in range(20)), 3, 4), (1, 1, "4", "w1  w2   w3 w4 w5 w6 yeni", 1, 9), (1, 2, "5", "a b c", 2, 2), (1, 3, "5", "d e f g", 5, 5)]
    made = legal.dedup_articles(spark.createDataFrame(rows, "doc_id long, seq int, article_no string, content string, page_start int, page_end int"))
    got = {(r.article_no, r.seq): (r.page_start, r.page_end, r.duplicate_source_count, r.duplicate_warning) for r in made.collect()}
    assert got == {("4", 0): (1, 9, 2, "deduplicated_contained_articles"), ("5", 2): (2, 2, 2, "duplicate_articles_kept_distinct"), ("5", 3): (5, 5, 2, "duplicate_articles_kept_distinct")}


def test_bm25_searches_the_title(spark):
    d = spark.createDataFrame([(1, "tez", "izleme"), (2, "baska", "metin"), (3, None, None)], "doc_id long, title string, text string")
    q = spark.createDataFrame([("q", "tez")], "query_id string, question string")
    assert [r.doc_id for r in rank.bm25(d, q).collect()] == [1]


def test_staleness_counts_parts_of_a_second(spark, tmp_path):
    """A row in the first second of a day isn't yet a whole day older; an empty table has no stale rows."""
    rows = [(1, "2024-01-30 12:00:00.5"), (2, "2024-01-20 00:00:00.000001"), (3, "2024-01-20 00:00:00"), (4, "2024-01-19 23:59:59.999999"), (5, None)]
    events = spark.createDataFrame([(*x, "click") for x in rows], "event_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for made, want in ((events, [3, 4]), (events.limit(0), [])):
        at = tmp_path / str(len(want))
        made.coalesce(1).write.parquet(f"{at}/events.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{at}/events.parquet/*.parquet'")
        got = sorted(r.event_id for r in catalogue.stale_expiry(spark, str(at)).collect())
        assert got == want == sorted(x for x, in con.execute(catalogue.ORACLES["stale_expiry"]).fetchall())


def test_semantic_cuts_in_one_pass(spark):
    """No exchange, each row on its own, values by hand, blocks as the whole; a text's own model can take the place of the counts."""
    text = "Red fox. Red fox. Red fox. Blue sky! Blue sky! Blue sky!"
    rows = [(1, text), (1, "a. b"), (2, None), (3, "x. " * 500), (None, "one")]
    made = chunk.semantic_chunks(spark.createDataFrame(rows, "doc_id long, text string"), percentile=0.5)
    assert not re.search("Exchange|Window|Generate", made._jdf.queryExecution().executedPlan().toString())
    got = [tuple(r) for r in made.collect()]
    assert [g for g in got if g[0] == 2] == [(2, 0, "")] and [g for g in got if g[0] is None] == [(None, 0, "one")]
    assert (1, 0, "a. b") in got and "".join(c for k, _, c in got if k == 3).count("x.") == 500

    def topic(sentences, start, stop):
        return [[1.0, 0.0] if "Red" in s else [0.0, 1.0] for s in sentences[start:stop]]

    assert chunk.split_semantic(text, vectors=topic) == ["Red fox. Red fox. Red fox.", "Blue sky! Blue sky! Blue sky!"]
    long = " ".join(f"w{i % 97} z{i * i % 13}." for i in range(500))
    assert chunk.split_semantic(long, block=7) == chunk.split_semantic(long) and len(chunk.split_semantic(long)) > 5
    v = chunk.sentence_vectors(["a b.", "c", "d. c"], 0, 3)
    assert v.sum(axis=1).tolist() == [3.0, 5.0, 3.0]
