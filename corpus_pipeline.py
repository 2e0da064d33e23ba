"""A corpus pipeline of five stages, each a DataFrame in and a DataFrame out; part of the ``llm`` subpackage.

Every stage is written as Parquet and read again before the next one, so each can be resumed on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import langid, mixing, neardup, pii
from voxloom.llm.common import scratch_dir
from voxloom.llm.queries import encoded_digests, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows that go to a Python worker at once. Whole texts are long, and both the executor and its workers hold a batch.
BATCH = 1000


def in_small_batches(spark: SparkSession) -> None:
    """Every stage sets this for the session, as it counts when the stage is written."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determinable language go; the predicted language replaces the given one.

    Rejected are texts that are null or have no letter. The model learns from the rows that carry a language. A table
    without any language rejects all, as nothing can be predicted."""
    in_small_batches(spark)
    found = langid.predict(docs, langid.train(docs))
    kept = found.filter(F.col("lang_pred") != langid.UNDETERMINED).withColumn("lang", F.col("lang_pred"))
    return kept.select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity 0.8 or more. Texts without words are alike
    to nothing and stay, as do all rows that share a kept id."""
    in_small_batches(spark)
    return neardup.kept_one_each(docs).select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the new text. No document goes."""
    in_small_batches(spark)
    return pii.redact(docs, pii.train(docs)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed by temperature; every document appears once or more, no source over 1.5 times as often. No document goes."""
    in_small_batches(spark)
    return mixing.mixed(docs, repeats=1.5)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every appearance of a document as piece ids, checked by decoding them. No document goes."""
    in_small_batches(spark)
    return encoded_digests(docs.select("doc_id", "text"))


STAGES = [("language", language), ("near_duplicates", one_of_each), ("personal_data", private), ("mixing", weights), ("sentencepiece", pieces)]

#: Learned models and signatures have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        path = f"{scratch_dir(spark)}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
