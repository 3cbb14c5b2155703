"""Steps whose cost has to grow no faster than their input."""

import json
import os

import pytest
from pyspark.sql import functions as F

from millrace.functions import compound, markdown, numbers, text
from millrace.operators import records
from millrace.plans import catalog
from millrace.session import spread
from millrace.sources import paged

SF = "/root/testdata/sf0.01"


def cleans(df):
    """How often a plan takes tags out of a text."""
    return df._jdf.queryExecution().analyzed().toString().count("<[^>]+>")


def test_rows_of_a_small_file_are_dealt(spark):
    rows = spark.range(12_001).coalesce(1)
    assert spread(rows, 5000).rdd.getNumPartitions() == 3 and spread(rows, 5000).distinct().count() == 12_001
    assert spread(rows, 50_000).rdd.getNumPartitions() == 1 and spread(rows.where("id < 0")).count() == 0


@pytest.mark.parametrize("name", "array_rules compound_metadata documentation_pages fallback_explanations labelled_blocks markdown_answers merged_text_codes sql_function_rules source_projections".split())
def test_heavy_rows_have_many_tasks(spark, monkeypatch, name):
    from millrace import session

    monkeypatch.setattr(session.spread, "__defaults__", (500,))
    made = catalog.QUERIES[name](spark, SF)
    assert "Repartition 4, true" in made._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_cleaned_once(spark):
    rows = spark.createDataFrame([("a <b>1.5 KB</b> &amp; image pdf",), (None,)], "x string")
    for f in (text.without_navigation, numbers.parse_bytes, numbers.modalities, numbers.parse_bool):
        assert cleans(rows.select(f(F.col("x")).alias("y"))) == 1
    assert [r[0] for r in rows.select(numbers.parse_bytes(F.col("x"))).collect()] == [1500, None]
    assert [r[0] for r in rows.select(F.array_join(numbers.modalities(F.col("x")), ",")).collect()] == ["text,image", ""]
    assert [r[0] for r in rows.select(text.clean(F.col("x"))).collect()] == ["a 1.5 KB & image pdf", None]


def test_schema_rows_are_cleaned_once_each(spark):
    rows = spark.sql("SELECT array(named_struct('name', 'A', 'description', 'x', 'data_type', 'int', 'max_length', null, 'unit', ''), named_struct('name', 'a', 'description', 'X', 'data_type', 'INT', 'max_length', null, 'unit', '')) AS s")
    once = rows.select(records.distinct_columns(F.col("s")).alias("s"))
    assert cleans(once) == 6 and [c["name"] for c in once.first().s] == ["A"]


def test_points_are_found_once(spark):
    made = spark.createDataFrame([("[1] n - first point of it\nsecond point of it",)], "x string").select(markdown.fallback_explanation(F.lit("p"), F.col("x"), F.col("x")).alias("y"))
    assert made._jdf.queryExecution().analyzed().toString().count("(?:src|source|source_code)") == 2
    assert "first point of it 또한 second point of it." in made.first()[0]


def test_a_label_twice_with_one_value(spark):
    rows = spark.createDataFrame([("Publisher a Cycle: b Publisher a",), ("Publisher a Publisher c",)], "x string")
    assert [r[0] for r in rows.select(text.labelled_values(F.col("x"), ["Publisher", "Cycle"])).collect()] == [{"Cycle": "b", "Publisher": "a"}, {"Publisher": "c"}]


def test_hangul_is_counted_by_runs(spark):
    rows = spark.createDataFrame([("한국 1, ab",), ("abc",), ("12",), (None,)], "x string").select(text.hangul_ratio(F.col("x")).alias("r"))
    assert [r[0] for r in rows.collect()] == [0.5, 0.0, 0.0, 0.0]
    assert "[^A-Za-z가-힣]+" in rows._jdf.queryExecution().analyzed().toString()


def test_kinds_of_variants_are_read_once(spark):
    rows = spark.sql("SELECT parse_json('[]') v")
    plan = rows.select(compound.people(rows.v, "a", "b", "c").alias("p"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("schema_of_variant") <= 24
    doubled = spark.sql("""SELECT parse_json('[{"typeName": "a", "value": 1}, {"typeName": "b", "value": 2}, {"typeName": "a", "value": 1}]') v""")
    assert doubled.select(F.map_keys(compound.fields(doubled.v)).alias("k")).first().k == ["b", "a"]


def put(root, n, per):
    for p in range(1, n + 1):
        os.makedirs(f"{root}/size={per}/page={p}")
        with open(f"{root}/size={per}/page={p}/part-0.txt", "w") as f:
            json.dump({"hits": [{"id": i} for i in range(per * p - per, per * p)]}, f)


def test_many_responses_share_partitions(spark, tmp_path):
    put(tmp_path, 130, 3)
    parts = paged._PageReader({"path": str(tmp_path), "sizes": "3"}).partitions()
    assert len(parts) == 44 and sorted(r for p in parts for r in p.requests) == [(3, p) for p in range(1, 131)]
    assert sorted(int(r.key) for r in paged.read(spark, str(tmp_path), sizes="3").collect()) == list(range(390))


def test_many_saves_share_a_batch(spark, tmp_path):
    put(tmp_path / "in", 13, 3)
    run = lambda name, **more: paged.collect_run(spark, str(tmp_path / "in"), f"{tmp_path}/out", name, sizes="3", saveEvery="2", **more)
    assert run("a", stop_after=3) == "STOPPED" and spark.read.parquet(f"{tmp_path}/out/records").count() == 6
    assert run("b") == "SUCCESS"
    told = spark.read.parquet(f"{tmp_path}/out/progress").where("status = 'RUNNING' and collected > 0").orderBy("batch", "save").collect()
    assert [r.collected for r in told] == [2] * 19 + [1] and [r.key for r in told][:4] == ["1", "3", "5", "7"]
    assert len([d for d in os.listdir(f"{tmp_path}/out/records") if d.startswith("batch=")]) <= 4
    assert sorted(int(r.key) for r in spark.read.parquet(f"{tmp_path}/out/records").collect()) == list(range(39))


def test_a_small_level_is_one_job(spark):
    """However many shuffle partitions there are: a local iterator runs a job for each."""
    from millrace.llm.url_filter import BloomCascade

    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    sc = spark.sparkContext
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        sc.setJobGroup("cascade", "levels of a cascade")
        universe = spark.range(300).select(F.col("id").cast("string").alias("key"))
        cascade = BloomCascade.build(universe.where("key < '2'"), universe)
        jobs = len(sc.statusTracker().getJobIdsForGroup("cascade"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert jobs < 15 * len(cascade.levels)
    assert {r.key for r in universe.where(cascade.contains(F.col("key"))).collect()} == {str(i) for i in range(300) if str(i) < "2"}


def test_sketches_are_kept_by_group_alone(spark):
    """Not by (group, key): the exact distinct count is an aggregation of its own, and no aggregate holds a group's values."""
    plan = catalog.QUERIES["approx_distinct_and_quantiles"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    lines = [x for x in plan.splitlines() if "approx_count_distinct" in x]
    assert lines and all("l_partkey" not in x.split("[")[1].split("]")[0] for x in lines) and "percentile(" not in plan
    assert not any("distinct " in x or "count(distinct" in x for x in lines)


def test_sketches_of_odd_groups_are_near(spark):
    from millrace.plans.relational import sketches_near

    rows = [("a", i % 7, float(i)) for i in range(500)] + [(None, None, None), (None, 1, 2.0), ("empty", None, None), ("one", 3, float("nan"))]
    got = sketches_near(spark.createDataFrame(rows, "flag string, part long, quantity double"), "flag", "part", "quantity")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", True, True, 500), (None, True, True, 2), ("empty", True, True, 1), ("one", True, True, 1)], key=str)
