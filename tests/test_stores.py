import datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators import metrics
from millrace.sources import containment
from millrace.sources.stored import StoredTable


@pytest.fixture
def stored(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "t"))
    t.create(spark.range(100).select("id", F.lit("old").alias("v"), F.lit(1).alias("k")), ["id"], 10)
    return t


def test_merge_copies_only_the_buckets_that_it_touches(spark, stored):
    before = stored.buckets()
    assert stored.merge(spark.createDataFrame([(5, "new", 9), (200, "new", 9)], "id long, v string, k int"), keep=("k",)) == 2
    after = stored.buckets()
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 2 and all(after[b] == before[b] for b in before if b not in changed)
    assert sorted(map(tuple, stored.read().where("v = 'new'").collect())) == [(5, "new", 1), (200, "new", 9)]
    assert stored.read().count() == 101 and stored.read(1).where("v = 'new'").count() == 0
    assert [tuple(r) for r in stored.lookup(5).collect()] == [(5, "new", 1)] and stored.lookup(999).count() == 0
    assert len(stored.lookup(5).inputFiles()) < len(stored.read().inputFiles())


def test_a_failed_write_leaves_the_old_version(spark, stored):
    bad = spark.range(3).select("id", F.raise_error(F.lit("broken")).cast("string").alias("v"), F.lit(2).alias("k"))
    with pytest.raises(Exception, match="broken"):
        stored.merge(bad)
    assert stored.version() == 1 and stored.read().where("v = 'old'").count() == 100


def test_the_second_of_two_writers_fails(spark, stored):
    stored.merge(spark.createDataFrame([(1, "x", 1)], "id long, v string, k int"))
    manifest = stored._manifest(1)
    with pytest.raises(Exception):
        stored._commit(1, manifest)
    assert stored.version() == 2 and stored.read().where("v = 'x'").count() == 1


def test_an_empty_merge_changes_nothing(spark, stored):
    assert stored.merge(spark.createDataFrame([], "id long, v string, k int")) == 1


def test_rates_add_resets_and_reach_to_the_edges(spark):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [("a", s, v) for s, v in ((30, 10), (90, 20), (150, 5), (210, 15), (270, 25))] + [("b", 60, 1), ("c", 10, 3), ("c", 20, 3)]
    df = spark.createDataFrame([(k, t0 + datetime.timedelta(seconds=s), v) for k, s, v in rows], "k string, ts timestamp, v int")
    got = {(r.k, (r["at"] - t0).total_seconds()): r.rate for r in metrics.counter_rates(df, ["k"], "ts", "v").collect()}
    # At 300 s: 10, 20 | 5, 15, 25 is an increase of 35 in 240 s; both gaps of 30 s are within 1.1 of the mean of 60 s.
    assert got["a", 300.0] == pytest.approx(35 * (240 + 30 + 30) / 240 / 300)
    # At 180 s the first gap is longer than 66 s: half a mean distance, but no further than to where the counter was 0 (10 / 15 of 120 s).
    assert got["a", 180.0] == pytest.approx(15 * (120 + 30 + 30) / 120 / 300)
    assert ("b", 300.0) not in got and got["c", 60.0] == 0
    by = metrics.by_label(spark.createDataFrame([("x", -1.0), ("x", 3.0)], "l string, r double"), ["l"], "r", 0).first()
    assert (by.total, by.highest, by.mean) == (3.0, 3.0, 1.5)


def test_counters_come_with_the_write(spark, tmp_path):
    group = f"observed-{tmp_path.name}"
    spark.sparkContext.setJobGroup(group, "one write")
    got = metrics.observed_write(spark.range(1000), str(tmp_path / "out"), n=F.count("*"), top=F.max("id"), odd=F.count_if(F.col("id") % 2 == 1))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {"n": 1000, "top": 999, "odd": 500} and len(jobs) == 1


def test_searches_read_the_buckets_of_their_terms(spark, tmp_path):
    path = str(tmp_path / "postings")
    rows = spark.createDataFrame([(1, ["a", "b", "a", None]), (2, ["b"]), (3, None), (4, []), (5, ["c", "a", "b"])], "id long, t array<string>")
    containment.build(rows, "id", "t", path, buckets=32, parts=2)
    assert sorted(r.id for r in containment.containing_all(spark, path, ["a", "b", "a"]).collect()) == [1, 5]
    assert sorted(r.id for r in containment.containing_any(spark, path, ["c", "zzz"]).collect()) == [5]
    plan = containment.containing_any(spark, path, ["c"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
