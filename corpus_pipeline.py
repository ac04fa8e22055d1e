"""From documents to token ids: quality rules, near-duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the columns of documents, but for the last.
Defined cases are those of the operators; a document is a row, so rows that repeat are documents each and near-duplicates of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm._shared import save
from lattica.llm.mixing import mixed
from lattica.llm.pii import redacted
from lattica.llm.quality_rules import quality_rules
from lattica.llm.sentencepiece_codec import digest, encoded
from lattica.llm.simhash_dedup import one_of_each

#: What the operators set of the session.
BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs, DOCUMENTS).where("kept").select(*DOCUMENTS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, then the smallest content hash."""
    return one_of_each(docs, DOCUMENTS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return redacted(docs, DOCUMENTS).withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENTS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by the probabilities that bring sources, languages and topics to their targets."""
    return mixed(docs, DOCUMENTS).where("sampled").select(*DOCUMENTS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, n_bytes, ids_sha256, round_trip."""
    return digest(encoded(docs, ["doc_id", "text"]))


STAGES = [("quality rules", quality), ("near duplicates", near_dedup), ("personal data", personal_data), ("mixing", mixing), ("encoding", encoding)]
#: No stage but the base counts can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, which are saved like the others', so that the caller's session is as it was when they are read."""
    before = spark.conf.get(BATCHES, None)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*DOCUMENTS)
    try:
        for k, (_, stage) in enumerate(STAGES):
            docs = save(stage(spark, docs, sf_dir), f"stage-{k}")
    finally:
        spark.conf.unset(BATCHES) if before is None else spark.conf.set(BATCHES, before)
    return docs
