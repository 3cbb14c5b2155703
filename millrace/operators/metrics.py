"""Metrics over run logs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of a run.
STATUSES = ("RUNNING", "SUCCESS", "PARTIAL_SUCCESS", "FAILED", "STOPPED")


def one_hot(latest: DataFrame, key: str, status: str, states: tuple[str, ...]) -> DataFrame:
    """A row for each source and state, with 1.0 for the state that it is in. ``states`` is a closed vocabulary."""
    return latest.select(key, F.explode(F.array(*map(F.lit, states))).alias("state"), F.col(status).alias("_now")).select(key, "state", F.when(F.col("_now") == F.col("state"), 1.0).otherwise(0.0).alias("value"))


def gauges(rows: DataFrame, label: str, **metrics: Column) -> DataFrame:
    """Long format: metric, label, value."""
    return rows.select(label, F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in metrics.items()))).alias("m")).select("m.metric", label, "m.value")


def held_for(samples: DataFrame, key: str, ts: str, bad: Column, seconds: int) -> DataFrame:
    """Stretches of consecutive bad samples that last ``seconds`` or more: key, began, ended."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(ts)
    marked = samples.withColumn("_bad", bad).withColumn("_run", F.sum(F.when(~F.col("_bad"), 1).otherwise(0)).over(w))
    runs = marked.where("_bad").groupBy(key, "_run").agg(F.min(ts).alias("began"), F.max(ts).alias("ended")).drop("_run")
    return runs.where(F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("began").cast("timestamp")) >= seconds * 1_000_000)


def counter_rates(samples: DataFrame, series: list[str], ts: str, value: str, window: str = "5 minutes", step: str = "1 minute") -> DataFrame:
    """``series``, at, rate: increase a second of counters over the ``window`` before every ``step``.

    A fall of a counter is a reset: what it had counted before is added. The increase between the first and the last sample of a window
    is carried on to the window's ends: by the whole gap where that is at most 1.1 of the mean distance of samples, else by half that
    distance; and at the beginning no further than to where the counter was 0. A window with one sample has no rate.
    """
    from pyspark.sql import Window

    before = F.lag(value).over(Window.partitionBy(*series).orderBy(ts))
    moved = samples.select(*series, F.col(ts).cast("timestamp").alias("_ts"), F.col(value).cast("double").alias("_v"), F.when(before > F.col(value), before.cast("double")).otherwise(0.0).alias("_lost"))
    # Windows hold their end, not their beginning: samples move by a microsecond.
    w = F.window(F.col("_ts") - F.expr("interval 1 microsecond"), window, step)
    grouped = moved.groupBy(*series, w.alias("_w")).agg(
        F.count("*").alias("n"), F.min("_ts").alias("first"), F.max("_ts").alias("last"), F.min_by("_v", "_ts").alias("v0"), F.max_by("_v", "_ts").alias("v1"), F.sum("_lost").alias("lost"), F.min_by("_lost", "_ts").alias("lost0"),
    )
    seconds = lambda a, b: (F.unix_micros(b) - F.unix_micros(a)) / 1e6
    rows = grouped.where("n > 1 and last > first").select(
        *series, F.col("_w.end").alias("at"), "v0", seconds(F.col("first"), F.col("last")).alias("span"), "n", (F.col("v1") - F.col("v0") + F.col("lost") - F.col("lost0")).alias("up"),
        seconds(F.col("_w.start"), F.col("first")).alias("head"), seconds(F.col("last"), F.col("_w.end")).alias("tail"), seconds(F.col("_w.start"), F.col("_w.end")).alias("size"),
    )
    mean = F.col("span") / (F.col("n") - 1)
    edge = lambda gap: F.when(gap >= 1.1 * mean, mean / 2).otherwise(gap)
    head = edge(F.col("head"))
    head = F.when((F.col("up") > 0) & (F.col("v0") >= 0), F.least(head, F.col("span") * F.col("v0") / F.col("up"))).otherwise(head)
    return rows.select(*series, "at", (F.col("up") * (F.col("span") + head + edge(F.col("tail"))) / F.col("span") / F.col("size")).alias("rate"))


def by_label(samples: DataFrame, labels: list[str], value: str, least: float | None = None) -> DataFrame:
    """``labels``, total, highest, mean of samples of the same labels; values below ``least`` count as that."""
    v = F.col(value) if least is None else F.greatest(F.col(value), F.lit(float(least)))
    return samples.groupBy(*labels).agg(F.sum(v).alias("total"), F.max(v).alias("highest"), F.avg(v).alias("mean"))


def observed_write(rows: DataFrame, path: str, **counters: Column) -> dict:
    """Writes ``rows`` as Parquet; the counters (aggregates) are taken on the way, without a second pass."""
    from pyspark.sql import Observation

    seen = Observation("counters")
    rows.observe(seen, *(c.alias(n) for n, c in counters.items())).write.parquet(path)
    return seen.get

