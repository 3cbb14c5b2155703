import json

from millrace.sources import files


def test_sniffed_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿ name ; size \n x ;1\ny; 2\n", encoding="utf-8")
    rows = files.read_csv(spark, str(tmp_path / "a.csv"), start=1).collect()
    assert [tuple(r) for r in rows] == [("y", "2", 2)]
    assert files.sniff("a,b;c,d") == "," and files.sniff("a\tb") == "\t" and files.sniff("one") == ","


def test_replayed_pages(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.json").write_text(json.dumps({"result": {"items": [{"id": i * 10 + k} for k in range(3)]}}))
    (tmp_path / "3.json").write_text(json.dumps({"result": {"items": [{"id": 99}]}}))  # after a gap
    rows = files.read_pages(spark, str(tmp_path), "$.result.items")
    assert sorted((r.page, r.position, json.loads(r.item)["id"]) for r in rows.collect()) == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 10), (1, 1, 11), (1, 2, 12)]


def test_details_enrich_a_list(spark):
    items = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, title string, kind string")
    details = spark.createDataFrame([(1, "better")], "id int, title string")
    assert sorted(map(tuple, files.with_details(items, details, "id", "title").collect())) == [(1, "x", "better"), (2, "y", "b")]


def test_links_and_tables(spark):
    pages = spark.createDataFrame([(1, '<a href="/data/1">x</a><a href="/about">y</a><a href="/data/1">z</a><table><tr><th>a</th></tr><tr><td> b <b>c</b></td></tr></table>')], "page_id int, html string")
    assert [tuple(r) for r in files.links(pages, "html", "^/data/").collect()] == [(1, "/data/1")]
    assert pages.select(files.html_tables("html").alias("t")).first().t == [[["a"], ["b c"]]]


def test_run_summaries(spark):
    lines = spark.createDataFrame([(1, '{"n": 1}'), (2, "noise"), (3, '{"n": 5}'), (4, 'INFO dataset_collection {"source": "a", "n": 2}')], "line_no int, value string")
    assert files.last_json_line(lines, "n int").first().n == 5
    assert [tuple(r) for r in files.event_lines(lines, "dataset_collection", "source string, n int").collect()] == [("a", 2)]


def test_partitioned_sink(spark, tmp_path):
    files.write_by_source(spark.createDataFrame([("a", 1), ("b", 2)], "source string, n int"), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("source=*")) == ["source=a", "source=b"]


def test_csv_is_split_by_lines_and_numbered_in_order(spark, tmp_path):
    for name, low in (("a", 0), ("b", 3000)):
        (tmp_path / f"{name}.csv").write_text("k,v\n" + "".join(f"{i},{'x' * (i % 50)}\n" for i in range(low, low + 3000)), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        rows = files.read_csv(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 4
        assert sorted((r.row_index, int(r.k)) for r in rows.collect()) == [(i + 1, i) for i in range(6000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "c.csv").write_text('k,v\n1,"two\nlines"\n2,b\n', encoding="utf-8")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "c.csv"), start=0).orderBy("row_index").collect()] == [("1", "two\nlines", 1), ("2", "b", 2)]


def test_yaml_by_name_and_pages_in_folders(spark, tmp_path):
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "one.yaml").write_text("a: 1\nb: [x]\n")
    (tmp_path / "y" / "list.yaml").write_text("- 1\n")
    assert [tuple(r) for r in files.read_yaml(spark, str(tmp_path / "y")).collect()] == [("one.yaml", '{"a": 1, "b": ["x"]}')]
    for i in range(2):
        (tmp_path / "p" / f"page={i}").mkdir(parents=True)
        (tmp_path / "p" / f"page={i}" / "part-0.txt").write_text(json.dumps({"items": [i]}))
    assert sorted((r.page, r.item) for r in files.read_pages(spark, str(tmp_path / "p")).collect()) == [(0, "0"), (1, "1")]
