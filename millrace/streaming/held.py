"""Conditions that hold for a while, over a stream: arbitrary state and event-time timers (transformWithState)."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

_STATE = "pending array<struct<at:bigint,good:boolean,bad:boolean>>, began bigint, ended bigint"


class _Held(StatefulProcessor):
    """Samples wait, in order of time, until the watermark has passed them; then they start, prolong or end the stretch of their key.

    State of a key: the samples that wait (those of the allowed lateness), and the stretch that is open. One timer, for the first sample
    that waits.
    """

    def __init__(self, seconds: int):
        self.least = seconds * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", _STATE)

    def _load(self) -> tuple[dict[int, tuple[bool, bool]], int | None, int | None]:
        if not self.state.exists():
            return {}, None, None
        pending, began, ended = self.state.get()
        return {p[0]: (p[1], p[2]) for p in pending or []}, began, ended

    def _save(self, pending: dict[int, tuple[bool, bool]], began: int | None, ended: int | None) -> None:
        if pending:
            self.handle.registerTimer(-(-min(pending) // 1000))
        if pending or began is not None:
            self.state.update(([(at, *flags) for at, flags in sorted(pending.items())], began, ended))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pending, began, ended = self._load()
        passed = timerValues.getCurrentWatermarkInMs()
        for some in rows:
            for at, bad in zip(some["at"].tolist(), some["bad"].tolist(), strict=True):
                if -(-at // 1000) > passed:
                    good, was = pending.get(at, (False, False))
                    pending[at] = (good or not bad, was or bool(bad))
        self._save(pending, began, ended)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pending, began, ended = self._load()
        passed = timerValues.getCurrentWatermarkInMs()
        out = {}
        for at in sorted(t for t in pending if -(-t // 1000) <= passed):
            good, bad = pending.pop(at)
            if good:
                began = ended = None
            if bad:
                began, ended = (at if began is None else began), at
                if ended - began >= self.least:
                    out[began] = ended
        self._save(pending, began, ended)
        if out:
            yield pd.DataFrame({"key": [key[0]] * len(out), "began": list(out), "ended": list(out.values())})

    def close(self) -> None:
        pass


def held_for(samples: DataFrame, key: str, ts: str, bad: Column, seconds: int, late: str) -> DataFrame:
    """``key``, began, ended of stretches of bad samples that have held for ``seconds``, told again whenever they get longer (update mode).

    Samples may come ``late``; what comes later still is dropped. One instant with good and bad samples ends a stretch and starts one.
    """
    spark = samples.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = samples.withWatermark(ts, late).select(F.col(key).cast("long").alias("key"), ts, F.unix_micros(ts).alias("at"), F.coalesce(bad, F.lit(False)).alias("bad"))
    schema = StructType([StructField("key", LongType()), StructField("began", LongType()), StructField("ended", LongType())])
    found = rows.groupBy("key").transformWithStateInPandas(_Held(seconds), schema, outputMode="Update", timeMode="EventTime")
    return found.select(F.col("key").alias(key), F.timestamp_micros("began").alias("began"), F.timestamp_micros("ended").alias("ended"))


def run_held(spark: SparkSession, stretches: DataFrame, key: str, out: str, checkpoint: str) -> DataFrame:
    """Runs all there is; every batch replaces itself under its number. Of each stretch the last word counts."""
    query = stretches.writeStream.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}")).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stretches.schema).option("recursiveFileLookup", "true").parquet(out).groupBy(key, "began").agg(F.max("ended").alias("ended"))
