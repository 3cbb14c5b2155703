"""Streams give what the batch form gives; progress is kept between runs."""

import pytest
from pyspark.sql import functions as F

from millrace.streaming import events

SF = "/root/testdata/sf0.001"


@pytest.fixture
def batch(spark):
    return spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.fixture
def folder(spark, tmp_path):
    """The events as a folder of files; a stream reads folders."""
    spark.read.parquet(f"{SF}/events.parquet").coalesce(1).write.parquet(str(tmp_path / "events"))
    return str(tmp_path / "events")


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("make", [lambda e: events.tumbling(e, "1 hour"), lambda e: events.sliding(e, "5 minutes", "1 minute"), lambda e: events.sessions(e, "30 minutes")], ids=["tumbling", "sliding", "sessions"])
def test_closed_windows_equal_the_batch(spark, batch, folder, tmp_path, make):
    events.run(make(events.read(spark, folder)), str(tmp_path / "out"), str(tmp_path / "state"))
    got, want = rows(spark.read.parquet(str(tmp_path / "out"))), rows(make(batch))
    assert got <= want and len(got) > 0.95 * len(want)


def test_second_run_takes_only_what_is_new(spark, tmp_path):
    source, state, seen = tmp_path / "in", str(tmp_path / "state"), []
    merge = lambda df, i: seen.append(df.count())
    data = spark.read.parquet(f"{SF}/events.parquet")
    data.where("event_id < 100").coalesce(1).write.parquet(str(source))
    events.upsert_batches(events.read(spark, str(source)), merge, state)
    data.where("event_id between 100 and 149").coalesce(1).write.mode("append").parquet(str(source))
    events.upsert_batches(events.read(spark, str(source)), merge, state)
    assert [n for n in seen if n] == [100, 50]


def test_keys_come_once(spark, folder, tmp_path):
    stream = events.first_by_key(events.read(spark, folder), ["event_id"])
    events.run(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("event_id").distinct().count() == 1000
