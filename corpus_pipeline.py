"""The corpus pipeline: language ID, near-dedup, benchmark decontamination, secret redaction, packing.

Each stage works on what its predecessor kept, written as Parquet in the shared folder and read again. All but the last
return the columns of documents. Null and empty texts: language ID drops them (they have no language). An empty table
passes through every stage and gives no pieces; columns beyond those of documents are carried along to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontamination, language_crf, minhash, packing, secrets
from gleaner.llm.shared import written

#: A text whose words have a smaller mean of their largest marginals than this is in no language the model knows.
LEAST_EVIDENCE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, or in several. The model learns from those whose id it may learn from. Equal rows fare alike."""
    model = language_crf.fit(language_crf.sample(docs.filter(~language_crf.held_out(F.col("doc_id")))))
    found = language_crf.identify(docs, model)
    return found.filter((F.col("lang_pred") != language_crf.UNKNOWN) & (F.col("evidence") >= LEAST_EVIDENCE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more: the smallest id."""
    return minhash.without_near_duplicates(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no 10-word window of a benchmark item occurs."""
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows the text."""
    model = secrets.train(secrets.labelled_tokens(docs))
    found = secrets.scan(docs, model, out="_found")
    hit = F.size("_found.spans") > 0
    clean = found.withColumn("text", secrets.redact(F.col("text"), F.col("_found.spans")))
    return clean.withColumn("n_chars", F.when(hit, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) \
        .select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 1024 tokens."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate),
          ("redact_secrets", redact_secrets), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
