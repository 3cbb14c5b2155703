"""Feeds: files and pages read, resumed, enriched and stored; streams of events. Each query writes what it reads to the shared folder first."""

from pyspark.sql import functions as F

from millrace.operators import ingest, tables
from millrace.plans.registry import query
from millrace.session import spread, table, workspace
from millrace.sources import files
from millrace.streaming import events as streams


def _csv(spark, sf_dir):
    path = workspace(spark, "csv")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("﻿ key"), F.concat(F.lit("  "), "p_name", F.lit("; a")).alias(" name "), F.col("p_size").cast("string").alias("type"))
    rows.coalesce(1).write.option("header", True).option("sep", ";").csv(path)
    return path


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, trim(p_name) || '; a' AS name, CAST(p_size AS VARCHAR) AS type FROM part WHERE p_partkey >= 50")
def csv_scan(spark, sf_dir):
    """A delimiter-sniffed CSV from its 51st row on."""
    return files.read_csv(spark, _csv(spark, sf_dir), start=50).select("key", "name", "type")


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, p_partkey + 1 AS row_index FROM part WHERE p_partkey > 70")
def csv_resume(spark, sf_dir):
    """Rows after the one that was saved last."""
    return files.after_key(files.read_csv(spark, _csv(spark, sf_dir)), "key", "70").select("key", "row_index")


@query("SELECT CAST(p_partkey AS VARCHAR) AS key FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 > 0 ORDER BY p_partkey LIMIT 40")
def pending_api_rows(spark, sf_dir):
    """API rows of a list that are not done yet: the done keys are a stored set."""
    part = table(spark, sf_dir, "part").withColumn("kind", F.when(F.col("p_partkey") % 2 == 0, "API").otherwise("FILE"))
    done = workspace(spark, "done")
    part.where("p_partkey % 3 = 0").select("p_partkey").write.parquet(done)
    return part.where("kind = 'API'").join(spark.read.parquet(done), "p_partkey", "left_anti").orderBy("p_partkey").limit(40).select(F.col("p_partkey").cast("string").alias("key"))


def _json_pages(spark, sf_dir, per: int):
    """The suppliers as pages of a JSON service; page 7 is an error, so nothing after it counts."""
    path = workspace(spark, "pages")
    page = (F.col("s_suppkey") / per).cast("int")
    rows = table(spark, sf_dir, "supplier").groupBy(page.alias("page")).agg(F.to_json(F.struct(F.struct(F.array_sort(F.collect_list(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))).alias("results")).alias("result"))).alias("value"))
    rows = rows.withColumn("value", F.when(F.col("page") == 7, '{"error": 404}').otherwise(F.col("value")))
    rows.select("page", "value").repartition(1).write.partitionBy("page").text(path)
    return path


@query("SELECT s_suppkey AS id, s_name AS name, s_suppkey // 10 AS page FROM supplier WHERE s_suppkey < 70")
def json_pages(spark, sf_dir):
    """Items of a paged JSON service, up to the first page that is an error."""
    item = F.from_json("item", "struct<id:bigint,name:string>")
    return files.read_pages(spark, _json_pages(spark, sf_dir, 10), "$.result.results").select(item.alias("i"), F.col("page").cast("bigint").alias("page")).select("i.id", "i.name", "page")


@query("""
SELECT s_suppkey AS ref, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) END, s_name) AS title, coalesce(n, 0) AS n_files, total AS total_size FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS total FROM lineitem WHERE l_suppkey % 3 > 0 GROUP BY 1) ON l_suppkey = s_suppkey""")
def three_way_enrichment(spark, sf_dir):
    """A list, its views and its files: files are summed before they meet the list."""
    s = table(spark, sf_dir, "supplier")
    items = s.select(F.col("s_suppkey").alias("ref"), F.col("s_name").alias("title"))
    views = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("ref"), F.upper("s_name").alias("title"))
    parts = table(spark, sf_dir, "lineitem").where("l_suppkey % 3 > 0").select(F.col("l_suppkey").alias("ref"), F.col("l_quantity").cast("bigint").alias("size"))
    return files.with_files(items, views, parts, "ref", "title").select("ref", "title", "n_files", "total_size")


@query("SELECT n_name AS name, n_nationkey AS rows, 'slug' || n_nationkey || '.yaml' AS path FROM nation")
def yaml_catalogue(spark, sf_dir):
    """A catalogue of YAML files."""
    path = workspace(spark, "yaml")
    text = F.concat(F.lit("Name: '"), F.col("n_name"), F.lit("'\nResources:\n  - Type: bucket\n    Rows: "), F.col("n_nationkey").cast("string"), F.lit("\nTags: [a, b]\n"))
    table(spark, sf_dir, "nation").select(text.alias("value"), F.concat(F.lit("slug"), "n_nationkey").alias("slug")).write.partitionBy("slug").text(path)
    rows = files.read_yaml(spark, path, "slug=([^/]+)/").withColumn("path", F.concat("path", F.lit(".yaml")))
    return rows.select(F.get_json_object("record", "$.Name").alias("name"), F.get_json_object("record", "$.Resources[0].Rows").cast("int").alias("rows"), "path")


@query("""
WITH l AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS link FROM pages), k AS (SELECT *, regexp_extract(link, '^/([a-z]+)$', 1) AS source_key FROM l)
SELECT source_key, arg_min(link, {'p': page_id, 'l': link}) AS link, min(page_id) AS page_id FROM k WHERE source_key <> '' GROUP BY source_key""")
def detail_link_crawl(spark, sf_dir):
    """Detail links of list pages, each key once."""
    return files.detail_links(table(spark, sf_dir, "pages").select("page_id", "html"), "html", "^/[a-z]+$", "^/([a-z]+)$")


@query("""
SELECT p_partkey, 'heading|paragraph|code' AS kinds, p_name || '|' || p_type || ' of it|' || 'GET /' || p_partkey AS texts, 'col|' || p_brand AS columns, p_name AS decoded FROM part""")
def documentation_pages(spark, sf_dir):
    """Sections and schema tables of documentation pages; bytes of old Korean pages."""
    page = F.concat(F.lit("<h2> "), F.col("p_name"), F.lit("</h2><div><p>"), F.col("p_type"), F.lit(" <b>of</b>\n it</p></div><pre>GET /"), F.col("p_partkey").cast("string"), F.lit("</pre><table><tr><th>항목명</th><th>설명</th></tr><tr><td>col</td><td>"), F.col("p_brand"), F.lit("</td></tr></table><table><tr><td>x</td></tr></table>"))
    rows = spread(table(spark, sf_dir, "part")).select("p_partkey", files.sections(page).alias("s"), files.schema_rows(page).alias("c"), files.decoded(F.encode("p_name", "UTF-8")).alias("decoded"))
    return rows.select("p_partkey", F.array_join(F.transform("s", lambda x: x["kind"]), "|").alias("kinds"), F.array_join(F.transform("s", lambda x: x["text"]), "|").alias("texts"), F.concat_ws("|", F.col("c")[0]["name"], F.col("c")[0]["description"]).alias("columns"), "decoded")


#: The sources that are known.
_SOURCES = (("BUILDING",), ("MACHINERY",), ("HOUSEHOLD",))


@query("""
SELECT 'stored' AS what, c_custkey AS id, c_mktsegment AS source, c_name AS name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')
UNION ALL SELECT 'failed', count(*), c_mktsegment, NULL FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') GROUP BY c_mktsegment""")
def static_catalogue(spark, sf_dir):
    """Rows stored by source, of the sources that a catalogue in code knows; rows of unknown sources are counted instead."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("source"), F.col("c_name").alias("name"))
    path = workspace(spark, "by-source")
    failed = files.write_known(rows, files.catalogue(spark, list(_SOURCES), "source string"), path)
    stored = spark.read.parquet(path).select(F.lit("stored").alias("what"), "id", "source", "name")
    return stored.unionByName(failed.select(F.lit("failed").alias("what"), F.col("failed").alias("id"), "source", F.lit(None).cast("string").alias("name")))


@query("""
SELECT doc_id, 'new' AS what FROM documents WHERE source = 'src1' AND doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL (SELECT doc_id, 'again' FROM documents ORDER BY doc_id LIMIT 15) UNION ALL (SELECT page_id, 'like' FROM pages WHERE url LIKE 'https://%/en/%' ORDER BY page_id LIMIT 5 OFFSET 5)""")
def embedding_targets(spark, sf_dir):
    """Rows to embed: of one source without chunks, or all again; and targets by a pattern of their url, paged."""
    docs, done = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels")
    new = files.missing_embeddings(docs, done, "doc_id", source="src1")
    again = files.missing_embeddings(docs, done, "doc_id", again=True, limit=15)
    like = table(spark, sf_dir, "pages").where(F.col("url").like("https://%/en/%")).orderBy("page_id").offset(5).limit(5)
    return new.select("doc_id", F.lit("new").alias("what")).unionByName(again.select("doc_id", F.lit("again").alias("what"))).unionByName(like.select(F.col("page_id").alias("doc_id"), F.lit("like").alias("what")))


@query("SELECT n_nationkey AS id, n_name AS source_code, CASE WHEN n_nationkey % 2 = 0 THEN upper(n_name) || ' site' ELSE n_name END AS source_name FROM nation")
def source_dimension(spark, sf_dir):
    """Sources upserted by code: known ones keep their id, names are refreshed."""
    n = table(spark, sf_dir, "nation")
    old = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("source_code"), F.col("n_name").alias("source_name"))
    new = n.where("n_nationkey % 2 = 0").select(F.lit(-1).alias("id"), F.col("n_name").alias("source_code"), F.concat(F.upper("n_name"), F.lit(" site")).alias("source_name"))
    return tables.upsert(old, new, ["source_code"], keep=("id",))


@query("""
WITH c AS (SELECT doc_id, lang AS chunk_type, substr(text, 1, 20) AS chunk_text FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, lang, 'new ' || doc_id FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 1)
SELECT doc_id, chunk_type, CASE WHEN doc_id % 6 = 0 THEN 'new ' || doc_id ELSE chunk_text END AS chunk_text FROM c""")
def chunk_upsert(spark, sf_dir):
    """Chunks upserted by resource and type."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("chunk_type"), F.substring("text", 1, 20).alias("chunk_text"))
    new = d.where("doc_id % 3 = 0").withColumn("chunk_text", F.concat(F.lit("new "), F.col("doc_id")))
    return tables.upsert(d.where("doc_id % 2 = 0"), new, ["doc_id", "chunk_type"])


@query("SELECT user_id AS source, count(*) AS n, CAST(max(event_id) AS BIGINT) AS last FROM events GROUP BY user_id")
def run_summary_lines(spark, sf_dir):
    """Structured lines of a log, written as text and read back."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    path = workspace(spark, "log")
    e.select(F.concat(F.lit("INFO dataset_collection "), F.to_json(F.struct(F.col("user_id").alias("source"), "n", "last")))).union(e.select(F.lit("DEBUG noise {}"))).write.text(path)
    return files.event_lines(spark.read.text(path), "dataset_collection", "source bigint, n bigint, last bigint")


def _event_files(spark, sf_dir, parts: int = 3):
    path = workspace(spark, "events")
    table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value").repartition(parts, "event_id").write.parquet(path)
    return path


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_batch_counts(spark, sf_dir):
    """Counts of a stream, stored batch by batch under the batch's number, so that a repeated batch replaces itself."""
    out = workspace(spark, "counts")

    def store(batch, number):
        batch.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    streams.upsert_batches(streams.read(spark, _event_files(spark, sf_dir)), store, workspace(spark, "progress"))
    return spark.read.parquet(out).groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


@query("""
SELECT c.event_id AS click_id, p.event_id AS purchase_id, CAST(c.user_id AS BIGINT) AS user_id FROM events c JOIN events p ON c.user_id = p.user_id AND c.event_type = 'click' AND p.event_type = 'purchase' AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 20 MINUTE""")
def stream_stream_join(spark, sf_dir):
    """Clicks and the purchases within 20 minutes after them, both as streams with watermarks."""
    path, out = _event_files(spark, sf_dir), workspace(spark, "joined")
    clicks = streams.read(spark, path, 10).where("event_type = 'click'")
    purchases = streams.read(spark, path, 10).where("event_type = 'purchase'")
    streams.run(streams.within(clicks, purchases, "user_id", "20 minutes", "60 days"), out, workspace(spark, "progress"))
    return spark.read.parquet(out).select(F.col("event_id").alias("click_id"), F.col("other_id").alias("purchase_id"), "user_id")


@query("SELECT CAST(event_id AS BIGINT) AS event_id, event_type FROM events")
def stream_first_by_key(spark, sf_dir):
    """Each event once, though every file comes twice."""
    path = _event_files(spark, sf_dir, 2)
    spark.read.parquet(path).write.mode("append").parquet(path)
    out = workspace(spark, "once")
    streams.run(streams.first_by_key(streams.read(spark, path, 10), ["event_id"], "60 days"), out, workspace(spark, "progress"))
    return spark.read.parquet(out).select("event_id", "event_type")


@query("SELECT p_partkey, p_name || ' ' || chr(10) || p_type AS chunk, sqrt(1.0) AS norm FROM part")
def embedded_chunks(spark, sf_dir):
    """Chunks of APIs and their vectors from a pluggable model, in batches inside tasks."""
    rows = ingest.chunks(table(spark, sf_dir, "part"), "p_partkey", DESCRIPTION=ingest.search_text(F.col("p_name"), F.col("p_type")), TAGS=F.lit(" "))
    made = ingest.embedded(rows, "chunk_text", ingest.hashing_embedder(32))
    norm = F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 4)
    return made.select("p_partkey", F.col("chunk_text").alias("chunk"), norm.alias("norm"))
