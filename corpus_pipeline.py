"""From raw documents to packed token sequences, in five stages.

Each stage takes all rows that the one before it kept, as Parquet. Rejected
documents go: of unknown or doubtful language (1), near copies of an earlier
document (2), and those that the mixture doesn't draw (4). Stage 3 rewrites
texts. All but the last return the columns of ``documents``; the last returns
the pieces and their places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid
from tessera.llm.mixing import sample_mixture
from tessera.llm.ngram_join import jaccard_components
from tessera.llm.packing import pack
from tessera.llm.pii import redact_documents
from tessera.llm.queries import tokenizer_path
from tessera.storage import materialize

#: Least pooled probability of a document's language.
LEAST_SCORE = 0.34
#: Share of the remaining tokens that the mixture draws.
BUDGET = 0.7


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is told; a missing ``lang`` is filled in."""
    told = langid.identify(docs, langid.fit(docs))
    kept = told.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of near copies: five-word shingles, similarity 0.8 or more."""
    groups = jaccard_components(docs, shingle=5, percent=80)
    copies = materialize(groups.where("component_id < doc_id").select("doc_id").distinct(), "copies")
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in every text; ``n_chars`` follows."""
    return redact_documents(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw documents towards the target shares of sources, languages and topics."""
    return sample_mixture(docs, budget=BUDGET)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the texts' tokens into sequences of 2048."""
    return pack(docs, tokenizer_path(), capacity=2048, end_id=0)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The network, the mixture's draw and the packing can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
