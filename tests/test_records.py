"""Record operators on rows that are odd: nulls, empty values, other types, repeated and missing keys."""

import json

from millrace.functions import arrays, markdown, text
from millrace.operators import listing, records
from millrace.sources import files
from pyspark.sql import functions as F


def _raw(spark, *values):
    return spark.createDataFrame([(v if isinstance(v, str) or v is None else json.dumps(v),) for v in values], "raw string")


def test_odd_raw_records(spark):
    rows = _raw(spark, None, "", "no json", {}, {"id": 5, "title": None, "tags": "one, two", "files": [{"size": "1 KB"}, {"size": "x"}, "y"]}, {"id": "a/b", "title": " <b>T</b> ", "tags": ["x", "X ", "", {"no": 1}], "is_public": "false"})
    got = records.from_source(rows, records.SOURCES["FIGSHARE"]).collect()
    assert len(got) == 6 and [r.source_dataset_key for r in got[4:]] == ["5", "a/b"]
    assert all(r.title is None and r.access_type == "OPEN" and r.dataset_size_bytes is None for r in got[:4])
    assert (got[4].tags, got[4].dataset_size_bytes, len(got[4].resources_json), got[4].title) == (["one", "two"], 1000, 2, "5")
    assert (got[5].title, got[5].tags, got[5].access_type, got[5].is_restricted) == ("T", ["x"], "RESTRICTED", True)
    for source in records.SOURCES.values():
        assert records.from_source(rows, source).count() == 6


def test_merge_prefers_what_means_something(spark):
    made = lambda *v: records.from_source(_raw(spark, *v), records.SOURCES["FIGSHARE"]).drop("source_code")
    first = made({"id": "1", "title": "-", "tags": ["a"]}, {"id": "2", "title": "only first"}).withColumn("title", F.when(F.col("title") == "1", "-").otherwise(F.col("title")))
    out = {r.source_dataset_key: r for r in records.merge(first, made({"id": "1", "title": "Kept", "tags": ["A", "b"]}, {"id": "3", "title": "only second"})).collect()}
    assert (out["1"].title, out["1"].tags, out["2"].title, out["3"].title) == ("Kept", ["A", "b"], "only first", "only second")


def test_table_rows(spark):
    raw = {"id": "123", "title": "123", "description": "One. Two.", "tags": ["x", "추천데이터 로그인"], "figshare_url": "https://a.example.org/x", "downloads": "7"}
    row = records.table_rows(records.from_source(_raw(spark, raw, None), records.SOURCES["FIGSHARE"])).collect()
    assert (row[0].title, row[0].description_short, row[0].tags, row[0].canonical_url) == (None, "One. Two.", ["x"], "https://a.example.org/x")
    assert json.loads(row[0].metrics_json) == {"downloads": 7.0} and row[0].field_presence.has["title"] is False and len(row[1].record_hash) == 64


def test_texts(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "x string").select(c(F.col("x")).alias("y")).first().y
    assert one(text.unescape, "&amp;lt; &#0; &#xD800; &nope; & &#65;") == "&lt; � � &nope; & A"
    assert one(text.clean, "  ") is None and one(text.clean, None) is None
    assert one(lambda x: markdown.light(x), "#\n###### a\n1. b\n> \n") == "#\n### a\n- b"
    assert one(markdown.card_reason, "마무리 제안: x") is None and len(one(markdown.card_reason, "y" * 500)) == 160
    assert one(lambda x: arrays.unique_ci(F.split(x, ",")), "a, A,b,,<i>") == ["a", "b"]
    assert one(lambda x: text.without_navigation(x), "Paper | Project Page | Released Resources | Repo") is None


def test_reading_order_numbers(spark, tmp_path):
    spark.range(0, 100, 1, 5).selectExpr("id").write.parquet(str(tmp_path / "n"))
    rows = files.numbered(spark.range(0, 100, 1, 5), "row_index").collect()
    assert sorted((r.id, r.row_index) for r in rows) == [(i, i + 1) for i in range(100)]
    assert files.after_key(files.numbered(spark.range(5), "row_index"), "id", 99).count() == 5


def test_run_counters_of_a_long_list(spark):
    events = spark.createDataFrame([(1, i, "error") for i in range(25)] + [(2, 99, "view")], "user_id long, event_id long, event_type string")
    got = {r.user_id: r for r in listing.run_counters(events).collect()}
    assert got[1].summary.endswith("error 19\n... and 5 more") and got[1].status == "FAILED" and got[2].summary is None and got[2].status == "SUCCESS"


def test_schema_tables_and_sections(spark):
    pages = spark.createDataFrame([("<table><tr><th>Type</th><th>Name</th></tr><tr><td>int</td><td>a</td></tr></table><h1></h1><p>x <code>y</code></p>",), ("<table><tr><td>1</td></tr></table>",), (None,)], "h string")
    got = pages.select(files.schema_rows("h").alias("t"), files.sections("h").alias("s")).collect()
    assert [(r.name, r.data_type) for r in got[0].t] == [("a", "int")] and got[1].t == [] and got[2].s == []
    assert [(s.kind, s.text) for s in got[0].s] == [("paragraph", "x y")]
