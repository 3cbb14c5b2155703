"""Event-time operators as Structured Streaming; the same functions serve batch DataFrames."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of event files; zoneless times count as UTC."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str, late: str = "1 hour") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("started"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str, step: str, late: str = "1 hour") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("started"), "n")


def first_by_key(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: an idempotent feed."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def within(left: DataFrame, right: DataFrame, key: str, span: str, late: str = "1 hour") -> DataFrame:
    """Events of ``left`` with those of ``right`` of the same key up to ``span`` later: event_id, other_id, key. State is kept as long as ``late`` and ``span`` ask for."""
    a = left.withWatermark("ts", late).alias("a")
    b = right.select(F.col("event_id").alias("other_id"), F.col("ts").alias("other_ts"), F.col(key).alias("other_key")).withWatermark("other_ts", late).alias("b")
    near = (F.col("other_ts") >= F.col("ts")) & (F.col("other_ts") <= F.col("ts") + F.expr(f"interval {span}"))
    return a.join(b, (F.col(key) == F.col("other_key")) & near).select("event_id", "other_id", key)


def run(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything there is now, then stop; progress is kept in ``checkpoint``, so a second run takes only what is new."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()


def upsert_batches(stream: DataFrame, merge, checkpoint: str) -> None:
    """Gives every micro-batch to ``merge(batch, batch_id)``, which has to be idempotent by batch_id."""
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
