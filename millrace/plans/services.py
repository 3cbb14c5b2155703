"""Paged services through the data source, runs that stop and go on, linked and compound metadata. Responses and documents are made of the given tables."""

from pyspark.sql import functions as F

from millrace.functions import compound
from millrace.operators import jsonld
from millrace.plans.registry import query
from millrace.session import spread, table, workspace
from millrace.sources import paged
from millrace.streaming import events as streams
from millrace.streaming import held


def _stored(rows, path: str, size: int, page, wrap: str, broken: int | None = None) -> None:
    """Responses of ``size`` items; the one of page ``broken`` is no JSON."""
    items = F.to_json(F.array_sort(F.collect_list("item")))
    body = F.concat(F.lit(wrap.partition("[]")[0]), items, F.lit(wrap.partition("[]")[2]))
    made = rows.groupBy(page.alias("page")).agg(body.alias("value"))
    if broken is not None:
        made = made.withColumn("value", F.when(F.col("page") == broken, "<html>502</html>").otherwise(F.col("value")))
    _write(spread(made.withColumn("size", F.lit(size)), 200), path)


def _write(rows, path: str) -> None:
    """A folder a page, by many tasks; each task moves its own folders in place (version 2 of the committer), not the driver all of them."""
    rows.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("size", "page").text(path)


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")).alias("item"))


@query("""
WITH a AS (SELECT p_partkey AS id, 100 AS size, (p_partkey - (SELECT min(p_partkey) FROM part)) // 100 + 1 AS page FROM part), b AS (SELECT p_partkey AS id, 25 AS size, (p_partkey - (SELECT min(p_partkey) FROM part)) // 25 + 1 AS page FROM part)
SELECT CAST(size AS INTEGER) AS size, CAST(page AS INTEGER) AS page, id FROM a WHERE page < 2 UNION ALL SELECT CAST(size AS INTEGER), CAST(page AS INTEGER), id FROM b WHERE page >= 2""")
def service_page_size_fallback(spark, sf_dir):
    """A service whose second page fails at 100 items: from there on it is asked for 25."""
    rows, path = _parts(spark, sf_dir), workspace(spark, "service")
    place = F.col("n") - F.lit(rows.agg(F.min("n")).first()[0])
    for size, broken in ((100, 2), (25, None)):
        _stored(rows, path, size, F.floor(place / size) + 1, '{"hits": {"hits": []}}', broken)
    return paged.read(spark, path).select("size", "page", F.get_json_object("item", "$.id").cast("bigint").alias("id"))


@query("""
WITH a AS (SELECT p_partkey AS id, p_name AS name, (p_partkey - (SELECT min(p_partkey) FROM part)) // 50 * 50 AS page FROM part), g AS (SELECT * FROM a WHERE page >= 100)
SELECT id, name, CAST(page AS INTEGER) AS page FROM g WHERE NOT (page = 100 AND id <= (SELECT min(id) + 9 FROM g))""")
def service_offset_resume(spark, sf_dir):
    """A service with offsets, from the record after the one that was saved last; requests before its page are not read."""
    rows, path = _parts(spark, sf_dir), workspace(spark, "service")
    low = rows.agg(F.min("n")).first()[0]
    _stored(rows, path, 50, F.floor((F.col("n") - low) / 50) * 50, '{"result": {"results": []}}')
    read = paged.read(spark, path, checkpoint=(100, str(low + 109)), sizes="50", first="0", step="50", items="result.results")
    return read.select(F.get_json_object("item", "$.id").cast("bigint").alias("id"), F.get_json_object("item", "$.name").alias("name"), "page")


@query("SELECT event_id AS id, round(epoch(ts), 3) AS modified FROM events ORDER BY modified DESC, id LIMIT 200")
def iterator_by_last_modified(spark, sf_dir):
    """What an iterator of a client library gave, an item a line; the latest come first."""
    e, path = table(spark, sf_dir, "events"), workspace(spark, "iterator")
    line = F.to_json(F.struct(F.col("event_id").alias("id"), F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 3).alias("lastModified")))
    lines = e.select(line.alias("value"), F.lit(1).alias("size"), (F.col("event_id") / 1000).cast("int").alias("page"))
    _write(lines.repartition(max(1, -(-e.count() // 50_000)), "page"), path)
    read = paged.read(spark, path, sizes="1", first="0", lines="true", key="id")
    rows = read.select(F.get_json_object("item", "$.id").cast("bigint").alias("id"), F.get_json_object("item", "$.lastModified").cast("double").alias("modified"))
    return rows.orderBy(F.desc("modified"), "id").limit(200)


@query("""
SELECT 'record' AS what, s_suppkey AS id, s_name AS text FROM supplier
UNION ALL SELECT 'STOPPED', CAST(least(7, count(*)) AS BIGINT), 'first' FROM supplier UNION ALL SELECT 'SUCCESS', CAST(greatest(count(*) - 7, 0) AS BIGINT), 'second' FROM supplier
UNION ALL SELECT 'RUNNING', CAST((count(*) + 6) // 7 AS BIGINT), 'batches' FROM supplier""")
def stopped_and_resumed_run(spark, sf_dir):
    """A run over a stream with offsets, seven records a checkpoint, stopped after one; a second run goes on where it was."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("n"), F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).alias("item"))
    path, out = workspace(spark, "service"), workspace(spark, "run")
    low = rows.agg(F.min("n")).first()[0]
    _stored(rows, path, 6, F.floor((F.col("n") - low) / 6) + 1, "[]")
    options = {"sizes": "6", "items": "", "key": "id", "saveEvery": "7"}
    paged.collect_run(spark, path, out, "first", stop_after=1, **options)
    paged.collect_run(spark, path, out, "second", **options)
    records = spark.read.parquet(f"{out}/records").select(F.lit("record").alias("what"), F.col("key").cast("bigint").alias("id"), F.get_json_object("item", "$.name").alias("text"))
    progress = spark.read.parquet(f"{out}/progress")
    ends = progress.where("batch < 0").select("status", "collected", "run_id")
    return records.union(ends).union(progress.where("status = 'RUNNING' and collected > 0").groupBy("status").agg(F.count("*").alias("n")).select("status", "n", F.lit("batches")))


@query("""
WITH m AS (SELECT user_id, ts, event_id, value < 20 AS bad FROM events),
r AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM m)
SELECT CAST(user_id AS BIGINT) AS user_id, min(ts) AS began, max(ts) AS ended FROM r WHERE bad GROUP BY user_id, run HAVING max(ts) - min(ts) >= INTERVAL 120 SECOND""")
def stream_condition_held(spark, sf_dir):
    """Stretches over which a condition held for two minutes, from a stream whose files are out of order; a last sample far off closes it."""
    e, path = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value"), workspace(spark, "events")
    e.repartition(2, "event_id").write.parquet(path)
    end = e.agg((F.max("ts") + F.expr("interval 90 days")).alias("ts")).select(F.lit(-1).cast(e.schema["event_id"].dataType).alias("event_id"), "ts", F.lit(-1).cast(e.schema["user_id"].dataType).alias("user_id"), F.lit("end").alias("event_type"), F.lit(1e9).alias("value"))
    end.coalesce(1).write.mode("append").parquet(path)
    stretches = held.held_for(streams.read(spark, path, 1), "user_id", "ts", F.col("value") < 20, 120, "60 days")
    found = held.run_held(spark, stretches, "user_id", workspace(spark, "held"), workspace(spark, "progress"))
    return found.select("user_id", F.col("began").cast("timestamp_ntz").alias("began"), F.col("ended").cast("timestamp_ntz").alias("ended"))


@query("""
WITH RECURSIVE o AS (SELECT o_custkey AS c, o_orderkey AS k FROM orders WHERE o_orderkey % 5 = 0),
e AS (SELECT c, 'c' || c AS a, 'o' || k AS b FROM o UNION SELECT c, 'o' || k, 'n' || c_nationkey FROM o JOIN customer ON c = c_custkey UNION SELECT c, 'n' || c_nationkey, 'r' || n_regionkey FROM (SELECT DISTINCT c FROM o) JOIN customer ON c = c_custkey JOIN nation ON n_nationkey = c_nationkey
      UNION SELECT c, 'r' || n_regionkey, 'c' || c FROM (SELECT DISTINCT c FROM o) JOIN customer ON c = c_custkey JOIN nation ON n_nationkey = c_nationkey),
w AS (SELECT DISTINCT c, 'c' || c AS node, 0 AS depth FROM o UNION SELECT w.c, e.b, w.depth + 1 FROM w JOIN e ON e.c = w.c AND e.a = w.node WHERE w.depth < 6)
SELECT c AS doc, node, min(depth) AS depth, CASE substr(node, 1, 1) WHEN 'r' THEN NULL WHEN 'o' THEN 'dcat:Distribution' WHEN 'c' THEN 'dcat:Dataset' END AS type FROM w GROUP BY c, node""")
def linked_nodes(spark, sf_dir):
    """JSON-LD graphs: a dataset, its distributions, their publisher, that one's parent, and a link back: chains of three steps, and a cycle."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("doc"), F.concat(F.lit("o"), "o_orderkey").alias("o"))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select(F.col("c_custkey").alias("doc"), F.concat(F.lit("n"), "n_nationkey").alias("n"), F.concat(F.lit("r"), "n_regionkey").alias("r"))
    link = lambda x: F.struct(x.alias("@id"))
    own = o.groupBy("doc").agg(F.array_sort(F.collect_list("o")).alias("os")).join(c, "doc")
    me = F.concat(F.lit("c"), F.col("doc").cast("string"))
    graph = F.concat(
        F.transform("os", lambda x: F.to_json(F.struct(x.alias("@id"), F.lit("dcat:Distribution").alias("@type"), F.col("n").alias("dct:publisher")))),
        F.array(
            F.to_json(F.struct(me.alias("@id"), F.array(F.lit("dcat:Dataset")).alias("@type"), F.transform("os", link).alias("dcat:distribution"))),
            F.to_json(F.struct(F.col("n").alias("id"), link(F.col("r")).alias("http://schema.org/parent"))),
            F.to_json(F.struct(F.col("r").alias("@id"), link(me).alias("parent"))),
        ),
    )
    docs = own.select("doc", F.concat(F.lit('{"@graph": ['), F.array_join(graph, ","), F.lit("]}")).alias("json"))
    found = jsonld.resolved(docs, "doc", "json", "distribution", "publisher", "parent")
    return found.select("doc", F.col("node_id").alias("node"), "depth", F.get("types", F.lit(0)).alias("type"))


@query("""
SELECT p_partkey AS key, p_name AS title, 'Brand ' || p_brand || '|' || p_type AS subjects, p_type || '|' || p_brand AS notes, p_type || '/' || p_brand || '/-|' || p_name || '/-/' || p_partkey || '@x|Solo/-/-' AS people, 6 + CAST(p_partkey % 2 AS INT) AS leaves FROM part""")
def compound_metadata(spark, sf_dir):
    """Fields nested to different depths: texts, lists of texts, compounds in lists and under their names; and how many leaves there are."""
    field = lambda name, value, kind: F.struct(F.lit(name).alias("typeName"), F.lit(kind).alias("typeClass"), value.alias("value"))
    child = lambda name, value: F.struct(F.lit(name).alias("typeName"), value.alias("value"))
    p = spread(table(spark, sf_dir, "part"))
    authors = F.concat_ws(
        ",",
        F.to_json(F.struct(child("authorName", F.col("p_type")).alias("authorName"), child("authorAffiliation", F.col("p_brand")).alias("authorAffiliation"))),
        F.to_json(F.struct(F.array(child("authorName", F.concat(F.lit(" "), F.col("p_name"))), child("authorEmail", F.concat(F.col("p_partkey").cast("string"), F.lit("@x")))).alias("value"))),
        F.lit('" Solo "'), F.lit('{"authorAffiliation": {"value": "nobody"}}'),
    )
    notes = F.to_json(F.array(F.struct(child("note", F.col("p_type")).alias("note")), F.struct(child("note", F.col("p_brand")).alias("note")), F.struct(child("note", F.col("p_type")).alias("note"))))
    subjects = F.to_json(F.array(F.concat(F.lit("Brand "), "p_brand"), F.col("p_type"), F.concat(F.lit(" "), "p_type")))
    fields = F.concat(
        F.lit('[{"typeName": "title", "value": "old"},'), F.to_json(field("title", F.col("p_name"), "primitive")), F.lit(',{"typeName": "subject", "value": '), subjects,
        F.lit('},{"typeName": "note", "value": '), notes, F.lit('},{"typeName": "author", "value": ['), authors, F.lit("]}]"),
    )
    tree = F.concat(F.lit('{"a": [1, [true, {"b": "'), F.col("p_partkey").cast("string"), F.lit('", "c": null}], ["x", "y"]], "d": {"e": {"f": 2.5'), F.when(F.col("p_partkey") % 2 == 1, ', "g": [[7]]').otherwise(""), F.lit("}}, \"z\": \" \"}"))
    rows = p.select(F.col("p_partkey").alias("key"), compound.fields(F.parse_json(fields)).alias("f"), F.parse_json(tree).alias("tree"))
    shown = lambda x: F.coalesce(x, F.lit("-"))
    people = F.transform(compound.people(F.col("f")["author"], "authorName", "authorAffiliation", "authorEmail"), lambda x: F.concat_ws("/", x["name"], shown(x["affiliation"]), shown(x["email"])))
    told = rows.select(
        "key", compound.text(F.col("f")["title"]).alias("title"), F.array_join(compound.multi_text(F.col("f")["subject"]), "|").alias("subjects"),
        F.array_join(compound.compound_texts(F.col("f")["note"], "note"), "|").alias("notes"), F.array_join(people, "|").alias("people"),
    )
    leaves = compound.leaves(rows.select("key", "tree"), "key", "tree").groupBy("key").agg(F.count("*").cast("int").alias("leaves"))
    return told.join(leaves, "key")
