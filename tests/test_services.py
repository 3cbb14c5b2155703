import datetime
import json
import os

import pytest

from millrace.functions import compound
from millrace.operators import jsonld
from millrace.sources import paged
from millrace.streaming import held


def put(root, size, page, body):
    os.makedirs(f"{root}/size={size}/page={page}", exist_ok=True)
    with open(f"{root}/size={size}/page={page}/part-0.txt", "w") as f:
        f.write(body if isinstance(body, str) else json.dumps(body))


def hits(*ids):
    return {"hits": {"hits": [{"id": i} for i in ids]}}


@pytest.fixture
def service(tmp_path):
    """Pages of 4, of which the third is no JSON and the fifth comes after a gap; pages of 2; the last one is empty."""
    for p in (1, 2, 5):
        put(tmp_path, 4, p, hits(*range(4 * p - 4, 4 * p)))
    put(tmp_path, 4, 3, "<html>")
    for p in range(1, 9):
        put(tmp_path, 2, p, hits(*range(2 * p - 2, 2 * p)))
    put(tmp_path, 2, 9, hits())
    put(tmp_path, 2, 10, hits(99))
    return str(tmp_path)


SEEN = [0, 1, 2, 3, 4, 5, 6, 7, *range(4, 16)]


def keys(df):
    return [int(r.key) for r in df.orderBy(df.size.desc(), "page", "position").collect()]


def test_batches_follow_the_service(spark, service):
    assert keys(paged.read(spark, service, sizes="4,2")) == SEEN
    assert keys(paged.read(spark, service, sizes="2")) == list(range(16))
    assert keys(paged.read(spark, service, sizes="4")) == list(range(8))
    assert keys(paged.read(spark, service, sizes="2", checkpoint=(3, "4"))) == list(range(5, 16))
    assert keys(paged.read(spark, service, sizes="2", checkpoint=(3, "unknown"))) == list(range(6, 16))
    assert keys(paged.read(spark, f"{service}/nothing", sizes="2")) == []


def test_conditions_leave_pages_unread(spark, service):
    reader = paged._PageReader({"path": service, "sizes": "4,2"})
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains

    assert len(list(reader.pushFilters([EqualTo(("size",), 2), GreaterThan(("page",), 7), StringContains(("key",), "1")]))) == 3
    assert [p.value for p in reader.partitions()] == [(2, 8), (2, 9), (2, 10)]


def test_offsets_are_read_again_alike(service):
    stream = paged._RecordStream({"path": service, "sizes": "4,2", "saveEvery": "3"})
    at, seen = stream.initialOffset(), []
    while True:
        rows, end = stream.read(at)
        rows = list(rows)
        assert list(stream.readBetweenOffsets(at, end)) == rows and len(rows) <= 3
        seen += [int(r[3]) for r in rows]
        if end == at:
            break
        at = json.loads(json.dumps(end))
    assert seen == SEEN and at["done"]


def test_equal_keys_on_a_page_do_not_loop(tmp_path):
    put(tmp_path, 5, 1, hits(7, 1, 7, 2, 7, "", 3))
    stream = paged._RecordStream({"path": str(tmp_path), "sizes": "5", "saveEvery": "1"})
    at, seen = stream.initialOffset(), []
    while not at["done"]:
        rows, at = stream.read(at)
        seen += [r[3] for r in rows]
    assert seen == ["7", "1", "7", "2", "7", "3"]


def test_a_stopped_run_goes_on(spark, service, tmp_path):
    out = f"{tmp_path}/run"
    options = {"sizes": "4,2", "saveEvery": "5"}
    assert paged.collect_run(spark, service, out, "a", stop_after=2, **options) == "STOPPED"
    assert spark.read.parquet(f"{out}/records").count() == 10
    assert paged.collect_run(spark, service, out, "b", **options) == "SUCCESS"
    assert keys(spark.read.parquet(f"{out}/records")) == SEEN
    told = {(r.run_id, r.status): r.collected for r in spark.read.parquet(f"{out}/progress").where("batch < 0").collect()}
    assert told == {("a", "STOPPED"): 10, ("b", "SUCCESS"): 10}


GRAPH = {
    "@graph": [
        {"@id": "d", "@type": ["dcat:Dataset"], "dcat:distribution": [{"@id": "x"}, {"@id": "y"}, {"@id": "x"}, {"title": "inline"}], "dct:publisher": "p"},
        {"@id": "x", "@type": "dcat:Distribution", "dct:publisher": {"@id": "p"}}, {"@id": "y"}, {"@id": "p", "parent": {"@id": "q"}}, {"@id": "q", "http://x#parent": {"@id": "d"}}, 5,
    ]
}


def test_references_through_chains_and_cycles(spark):
    rows = [(1, json.dumps(GRAPH)), (2, json.dumps([{"id": "a", "type": "Thing"}, {"id": "b", "type": "Distribution"}])), (3, "{bad"), (4, None), (5, json.dumps({"@type": "Dataset", "distribution": {"u": 1}, "parent": "gone"}))]
    docs = spark.createDataFrame(rows, "doc long, j string")
    reached = {(r.doc, r.node_id): (r.depth, r.node is not None) for r in jsonld.resolved(docs, "doc", "j", "distribution", "publisher", "parent").collect()}
    assert reached == {(1, "d"): (0, True), (1, "x"): (1, True), (1, "y"): (1, True), (1, "p"): (1, True), (1, "q"): (2, True), (2, "a"): (0, True), (5, "_:0"): (0, True), (5, "gone"): (1, False)}
    named = sorted((r.doc, r.nth, r.node_id) for r in jsonld.distributions(docs, "doc", "j").collect())
    assert named == [(1, 0, "x"), (1, 1, "y"), (1, 3, None), (2, 1, "b"), (5, 0, None)]


def test_compounds(spark):
    author = [
        {"authorName": {"typeName": "authorName", "value": "A B"}, "authorAffiliation": {"value": "Uni"}}, {"value": [{"typeName": "authorName", "value": "C"}, {"typeName": "authorEmail", "value": "c@x"}]},
        " Solo ", {"value": []}, {"authorAffiliation": {"value": "x"}}, 7, {"value": "Plain"}, {"authorName": " "},
    ]
    row = spark.createDataFrame([(json.dumps(author),)], "j string").selectExpr("parse_json(j) v")
    got = row.select(compound.people(row.v, "authorName", "authorAffiliation", "authorEmail").alias("p"), compound.compound_texts(row.v, "authorName").alias("t")).first()
    assert [tuple(p) for p in got.p] == [("A B", "Uni", None), ("C", None, "c@x"), ("Solo", None, None), ("Plain", None, None)]
    assert got.t == ["A B", "C", "Solo", "Plain"]
    nothing = spark.sql("SELECT CAST(NULL AS VARIANT) v, parse_json('null') w")
    assert tuple(nothing.select(compound.people(nothing.v, "a", "b", "c"), compound.multi_text(nothing.w), compound.text(nothing.w)).first()) == ([], [], None)


def test_leaves_at_any_depth(spark):
    rows = spark.sql("""SELECT 1 AS key, parse_json('{"a": [1, {"b": {"c": ["x", [true, null]]}}], "d": " "}') AS v UNION ALL SELECT 2, parse_json('{}')""")
    assert sorted(map(tuple, compound.leaves(rows, "key", "v").collect())) == [(1, "a.0", "1"), (1, "a.1.b.c.0", "x"), (1, "a.1.b.c.1.0", "true")]


def test_held_takes_late_rows_in_order(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    at = lambda s: t0 + datetime.timedelta(seconds=s)
    files = [[(1, 0, 1.0), (1, 200, 1.0), (2, 0, 1.0)], [(1, 100, 9.0), (2, 119, 1.0), (2, 121, 1.0)], [(1, 350, 1.0), (1, 350, 9.0), (1, 480, 1.0)], [(3, 90_000, 9.0)], [(1, 10, 9.0)], [(3, 200_000, 9.0)]]
    for i, rows in enumerate(files):  # the second file has a row between those of the first; the fifth comes too late
        spark.createDataFrame([(k, at(s), v) for k, s, v in rows], "user_id int, ts timestamp, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        os.utime([f"{tmp_path}/in/{f}" for f in sorted(os.listdir(f"{tmp_path}/in")) if f.endswith(".parquet")][0])
        for f in os.listdir(f"{tmp_path}/in"):
            if f.endswith(".parquet") and not f.startswith("x"):
                os.rename(f"{tmp_path}/in/{f}", f"{tmp_path}/in/x{i}.parquet")
                os.utime(f"{tmp_path}/in/x{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema("user_id int, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = held.run_held(spark, held.held_for(stream, "user_id", "ts", stream.value < 5, 120, "1 hour"), "user_id", f"{tmp_path}/out", f"{tmp_path}/progress")
    got = sorted((r.user_id, int((r.began - t0).total_seconds()), int((r.ended - t0).total_seconds())) for r in found.collect())
    assert got == [(1, 350, 480), (2, 0, 121)]
