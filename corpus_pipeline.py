"""A training-text pipeline of five operators over ``documents``.

Each stage takes what the one before it kept, written as Parquet and read again.

1. language_id: documents without a predictable language go.
2. near_duplicates: the document with the smallest id of each group stays.
3. decontamination: documents contaminated by the benchmark go.
4. secrets: spans are replaced by marks; every document stays.
5. encoding: token ids of every document.

All but the last return the columns of ``documents``. Columns of the input that share a name with a column an
operator adds keep their values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlab.llm import bpe, decontamination, langid, minhash, secretscan
from cohortlab.llm.queries import PIECES, WORD_BPE, held_out
from cohortlab.llm.store import measured, written

#: Near duplicates share four in five of their shingles of five words.
SHINGLE, PERCENT = 5, 80

#: SQL cannot express the first and the last stage.
ORACLE_SQL = None


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list]:
    """``docs`` with clashing columns renamed, and the columns that undo it."""
    clash = {c: f"_own_{c}" for c in docs.columns if c.lower() in names}
    back = [F.col(clash[c]).alias(c) if c in clash else F.col(c) for c in docs.columns]
    return docs.withColumnsRenamed(clash), back


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. A null text, or one without a letter, goes."""
    model = langid.learned(docs, langid.read_pieces(PIECES), ~held_out(F.col("doc_id")))
    rows, back = _aside(docs, "lang_pred", "score")
    return langid.predicted(rows, model).filter("lang_pred <> 'und'").select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id (of different texts under one id, the one with the
    smallest hash; of equal rows, one). Documents are told apart by id and text. Rows without an id stay."""
    found, _ = written(minhash.near_duplicates(docs, shingle=SHINGLE, percent=PERCENT), "groups")
    key = F.xxhash64("text").alias("_key")
    if not found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").take(1):
        return docs.join(measured(found.filter("NOT kept").select("doc_id")), "doc_id", "left_anti").select(*docs.columns)
    first = found.filter("doc_id IS NOT NULL").groupBy("group").agg(F.min(F.struct("doc_id", "text_key")).alias("x")).select(F.col("x.doc_id").alias("_id"), F.col("x.text_key").alias("_text")).distinct()
    rows, back = _aside(docs, "_id", "_text", "_key")
    named = rows.filter("doc_id IS NOT NULL").withColumn("_key", key)
    kept = named.join(measured(first), (F.col("doc_id") == F.col("_id")) & (F.col("_key") == F.col("_text")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_key"]).drop("_key").unionByName(rows.filter("doc_id IS NULL")).select(*back)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark's contamination rule does not hit."""
    rows, back = _aside(docs, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items")
    return decontamination.contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("NOT contaminated").select(*back)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by marks."""
    found = secretscan.secrets(docs, repo=F.col("doc_id"), owner=F.col("source"))
    return secretscan.redacted(docs, found)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of every document."""
    return bpe.encoded(docs.select("doc_id", "lang", "source", "text"), WORD_BPE).drop("text")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_free),
    ("secrets", without_secrets),
    ("encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, from ``documents`` below ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
