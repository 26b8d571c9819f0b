import corpus_pipeline
from tessera.llm import langid

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    extra = spark.createDataFrame([(9001, "123 456", None, "src0", 7), (9002, docs.first().text, "en", "src1", 1)], docs.schema)
    docs = docs.unionByName(extra)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "pii", "mixing", "packing"]
    told = corpus_pipeline.identify_language(spark, docs, DIR).cache()
    assert told.columns == docs.columns and told.where("doc_id = 9001").isEmpty()
    assert told.count() >= 0.95 * docs.count()
    once = corpus_pipeline.drop_near_copies(spark, told, DIR).cache()
    assert once.columns == docs.columns and once.where("doc_id = 9002").isEmpty() and not once.isEmpty()
    texts = [r.text for r in once.collect()]
    assert len(set(texts)) == len(texts)
    clean = corpus_pipeline.redact_personal_data(spark, once, DIR).cache()
    assert clean.count() == once.count() and clean.where("n_chars <> length(text)").isEmpty()
    mixed = corpus_pipeline.mix_sources(spark, clean, DIR).cache()
    assert 0 < mixed.count() <= clean.count()
    packed = corpus_pipeline.pack_sequences(spark, mixed, DIR)
    assert packed.select("doc_id").distinct().count() == mixed.count()


def test_run(spark):
    assert langid.WINDOW and corpus_pipeline.run(spark, DIR).count() > 0
