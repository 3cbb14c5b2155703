"""From raw documents to packed training sequences: five stages, each over all that its predecessor kept.

A stage is (name, function) and takes (spark, docs, sf_dir). It is written as Parquet and read again before the next one, which then drops
the intermediate tables of those before it. All but the last return the columns of ``documents``.
"""

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontamination, ngram_join, packing, pii, quality_classifier
from millrace.llm.common import staged, workspace


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose predicted quality is 1."""
    return quality_classifier.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of five-word Jaccard 0.8 or more."""
    return ngram_join.keep(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages."""
    return decontamination.keep(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redacts personal data and the terms that disclose it; n_chars is that of the new text."""
    return pii.sanitize(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", staged(quality)),
    ("ngram_join", staged(near_duplicates)),
    ("decontamination", staged(decontaminate)),
    ("pii", staged(personal_data)),
    ("packing", staged(pack)),
]

#: SQL cannot express the classifier, the tokeniser and the packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = workspace(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
