"""An inverted table for arrays of terms: which rows hold a term, without reading the rows.

Postings (term, id) are written once a term and row, sorted by term, in folders by a hash of the term. A search reads the folders of
its terms alone, and of these the row groups that may hold them.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _bucket(term, n: int):
    return F.pmod(F.xxhash64(term), F.lit(n)).cast("int")


def build(rows: DataFrame, key: str, terms: str, path: str, buckets: int = 64, parts: int = 8) -> None:
    """Writes the postings of ``terms`` (an array column; null arrays and terms have none). A bucket is written by ``parts`` tasks, so a
    frequent term is not one task's work."""
    posted = rows.select(F.col(key).alias("id"), F.explode(F.array_distinct(F.array_compact(F.col(terms)))).alias("term")).withColumn("bucket", _bucket("term", buckets))
    posted = posted.repartition(buckets, "bucket", F.pmod(F.xxhash64("id"), F.lit(parts))).sortWithinPartitions("bucket", "term", "id")
    posted.write.partitionBy("bucket").parquet(path)
    rows.sparkSession.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(f"{path}/_buckets")


def _postings(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    n = spark.read.parquet(f"{path}/_buckets").first().buckets
    named = spark.createDataFrame([(t,) for t in terms], "term string")
    wanted = sorted({r.b for r in named.select(_bucket("term", n).alias("b")).collect()})  # of the terms asked for
    return spark.read.parquet(path).where(F.col("bucket").isin(wanted) & F.col("term").isin(terms))


def containing_all(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """id of the rows that hold every one of ``terms`` (one at least)."""
    asked = sorted(set(terms))
    return _postings(spark, path, asked).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(asked)).select("id")


def containing_any(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """id of the rows that hold one of ``terms``."""
    return _postings(spark, path, sorted(set(terms))).select("id").distinct()
