import pytest
from pyspark.sql import functions as F

from tessera import vocab
from tessera.operators import evaluate, prompt
from tessera.operators.retrieve import inject, retrieve

HIT = "query_id long, position int, content string, title string, source string, article_no string, article_title string, relevance double"


def hits(spark, rows):
    full = [(q, p, c, "t", "s", None, None, r) for q, p, c, r in rows]
    return spark.createDataFrame(full, HIT)


def asked(spark, *rows):
    return spark.createDataFrame(rows, "query_id long, question string")


def order(df):
    return [r.content for r in df.orderBy("query_id", "rank").collect()]


def test_ties_keep_the_order_and_repeats_go(spark):
    found = retrieve(hits(spark, [(1, 1, "b", None), (1, 2, "a", None), (1, 3, "b", None), (1, 4, None, None), (1, 5, "", None)]), asked(spark, (1, "soru")))
    assert order(found) == ["b", "a", None]
    assert {r.rerank_score for r in found.collect()} == {0.0}


def test_rules_lift_a_row_and_the_cut_comes_after_them(spark):
    rows = [(1, i, f"metin {i}", None) for i in range(60)] + [(1, 60, "En az uc ogretim uyesi bulunur", None)]
    found = retrieve(hits(spark, rows), asked(spark, (1, "ogretim uyesi")), top_k=2)
    top = found.orderBy("rank").collect()
    assert [(r.content, r.strong_match) for r in top] == [("En az uc ogretim uyesi bulunur", True), ("metin 0", False)]


def test_reranked_rows_follow_the_strong_and_precede_the_rest(spark):
    rows = [(1, 1, "x", None), (1, 2, "y", 0.7), (1, 3, "z", 0.9), (1, 4, "uc ogretim uyesi", None)]
    found = retrieve(hits(spark, rows), asked(spark, (1, "ogretim uyesi")), relevance="relevance")
    assert order(found) == ["uc ogretim uyesi", "z", "y", "x"]


@pytest.mark.parametrize(("score", "low"), [(0.59, True), (0.6, False), (None, False)])
def test_low_confidence_leaves_a_notice(spark, score, low):
    found = retrieve(hits(spark, [(1, 1, "x", score), (1, 2, "y", None)]), asked(spark, (1, "soru")), relevance="relevance").orderBy("rank").collect()
    assert [(r.rank, r.content, r.source) for r in found] == ([(1, vocab.LOW_CONFIDENCE_NOTICE, "Sistem")] if low else [(1, "x", "s"), (2, "y", "s")])


def test_definition_rows_join_the_questions_that_want_them(spark):
    law = ("AKTS: kredi", "Lisans%C3%BCst%C3%BC Yönetmeliği", "u", "4", "Tanımlar")
    rows = spark.createDataFrame([(i, *law) for i in (5, 4, 3, 2)] + [(1, "AKTS", "Staj", "u", "4", "Tanımlar"), (0, None, None, None, None, None)], "doc_id long, content string, title string, source string, article_no string, article_title string")
    questions = asked(spark, (1, "AKTS nedir?"), (2, "Staj AKTS kaç?"), (3, "Merhaba"), (4, None))
    out = inject(hits(spark, [(1, 1, "x", None)]), questions, rows)
    assert sorted((r.query_id, r.position > 1, r.content) for r in out.collect()) == [(1, False, "x")] + [(1, True, "AKTS: kredi")] * 3
    assert order(retrieve(out, questions, top_k=1)) == ["AKTS: kredi"]


def test_empty_tables(spark):
    none = hits(spark, [])
    assert retrieve(none, asked(spark, (1, "soru"))).count() == 0
    assert retrieve(none, asked(spark, (1, "soru")), relevance="relevance").count() == 0


def test_evaluation_by_hand(spark):
    results = spark.createDataFrame(
        [(1, 1, "http://a/x.pdf", "Genel", "MADDE 7 - Tez", None), (1, 2, "http://a/y.pdf", "Yönerge", "İzleme", "4"), (1, 6, "z", "late", "kayıp", "9"), (2, 1, None, None, None, None)],
        "query_id long, rank int, source string, title string, content string, article_no string",
    )
    wanted = spark.createDataFrame(
        [(1, ["yonerge"], "4", ["tez", "izleme"]), (1, ["late"], "7", ["kayip"]), (2, [], None, None), (3, ["a"], "1", ["a"]), (None, None, None, None)],
        "query_id long, expected_documents array<string>, expected_article_no string, expected_terms array<string>",
    )
    out = evaluate.evaluation(results, wanted)
    names = [f"{c}_hit_{k}" for c in ("document", "article") for k in (1, 3, 5)] + ["expected_terms_hit_5"]
    assert out.columns == ["query_id", *names]
    assert sorted([tuple(r) for r in out.collect()], key=repr) == sorted([(1, 0, 1, 1, 0, 1, 1, 1), (1, 0, 0, 0, 1, 1, 1, 0), (2, 0, 0, 0, 0, 0, 0, 1), (3, 0, 0, 0, 0, 0, 0, 0), (None, 0, 0, 0, 0, 0, 0, 1)], key=repr)
    means = evaluate.mean_flags(out, names).first()
    assert (means.questions, means.document_hit_3, means.expected_terms_hit_5) == (5, 0.2, 0.6)


def test_inventory_questions(spark):
    rows = spark.createDataFrame([("Veritabanında hangi kaynaklar var?",), ("Index'te PDF listele, göster",), ("AKTS nedir?",), (None,), ("Kaynak listesi",)], "x string")
    assert [r[0] for r in rows.select(prompt.asks_inventory(F.col("x"))).collect()] == [True, True, False, False, True]
