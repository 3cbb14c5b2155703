"""Stored tables by version, counters taken while rows are written, rates of counters, containment by an inverted table, rules as SQL functions."""

from pyspark.sql import functions as F

from millrace.functions import arrays, numbers, text
from millrace.functions import sql as sql_functions
from millrace.operators import metrics
from millrace.plans.registry import query
from millrace.session import spread, table, workspace
from millrace.sources import containment
from millrace.sources.stored import StoredTable


@query("""
SELECT 'now' AS version, c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'NEW' ELSE c_mktsegment END AS segment, c_acctbal AS balance FROM customer UNION ALL SELECT 'now', -1 - s_suppkey, 'SUPPLIER', s_acctbal FROM supplier
UNION ALL SELECT 'first', c_custkey, c_mktsegment, c_acctbal FROM customer""")
def stored_table_versions(spark, sf_dir):
    """A keyed table stored in buckets and merged twice: known keys keep their balance, new ones are added; the first version stays readable."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    stored = StoredTable(spark, workspace(spark, "stored"))
    stored.create(c, ["c_custkey"], 8)
    stored.merge(c.where("c_custkey % 9 = 0").withColumn("segment", F.lit("NEW")).withColumn("balance", F.lit(0.0)), keep=("balance",))
    stored.merge(table(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).alias("c_custkey"), F.lit("SUPPLIER").alias("segment"), F.col("s_acctbal").alias("balance")))
    rows = lambda name, version: stored.read(version).select(F.lit(name).alias("version"), "c_custkey", "segment", "balance")
    return rows("now", None).unionByName(rows("first", 1))


@query("""
SELECT doc_id, lang AS chunk_type, CAST(0 AS INTEGER) AS nth, CASE WHEN doc_id % 3 = 0 THEN 'again ' || doc_id ELSE substr(text, 1, 20) END AS chunk FROM documents
UNION ALL SELECT doc_id, lang, CAST(1 AS INTEGER), 'again ' || doc_id FROM documents WHERE doc_id % 3 = 0""")
def stored_chunks(spark, sf_dir):
    """Chunks stored by resource, type and order, and stored again for a third of the resources."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("chunk_type"), F.substring("text", 1, 20).alias("chunk"))
    stored = StoredTable(spark, workspace(spark, "chunks"))
    stored.create(d.select("doc_id", "chunk_type", F.lit(0).alias("nth"), "chunk"), ["doc_id", "chunk_type", "nth"], 16)
    again = d.where("doc_id % 3 = 0").select("doc_id", "chunk_type", F.explode(F.array(F.lit(0), F.lit(1))).alias("nth"), F.concat(F.lit("again "), "doc_id").alias("chunk"))
    stored.merge(again)
    return stored.read()


@query("SELECT CAST(count(*) AS BIGINT) AS collected, count(*) FILTER (event_type = 'purchase') AS upserted, count(*) FILTER (event_type = 'error') AS failed, round(sum(value), 2) AS total, CAST(max(event_id) AS BIGINT) AS last, CAST(count(*) AS BIGINT) AS stored FROM events")
def observed_run(spark, sf_dir):
    """What a run collected, stored and failed on, counted while its rows are written."""
    path = workspace(spark, "observed")
    kind = F.col("event_type")
    seen = metrics.observed_write(table(spark, sf_dir, "events"), path, collected=F.count("*"), upserted=F.count_if(kind == "purchase"), failed=F.count_if(kind == "error"), total=F.round(F.sum("value"), 2), last=F.max("event_id").cast("bigint"))
    return spark.read.parquet(path).agg(F.count("*").alias("stored")).select(*(F.lit(v).cast("double" if n == "total" else "bigint").alias(n) for n, v in seen.items()), "stored")


@query("""
WITH c AS (SELECT user_id, event_type, ts, floor(value) + CASE WHEN event_id % 7 = 0 THEN 0 ELSE row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) END AS v FROM events),
l AS (SELECT *, lag(v) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS before FROM c), m AS (SELECT user_id, event_type, ts, v, CASE WHEN before > v THEN before ELSE 0 END AS lost FROM l),
w AS (SELECT *, time_bucket(INTERVAL '12 hours', ts - INTERVAL 1 MICROSECOND) - k * INTERVAL '12 hours' AS began FROM m, range(0, 4) t(k)),
g AS (SELECT user_id, event_type, began, count(*) AS n, epoch_us(min(ts)) / 1e6 AS t0, epoch_us(max(ts)) / 1e6 AS t1, arg_min(v, ts) AS v0, arg_max(v, ts) AS v1, sum(lost) - arg_min(lost, ts) AS lost FROM w GROUP BY ALL),
e AS (SELECT *, t1 - t0 AS span, v1 - v0 + lost AS up, t0 - epoch_us(began) / 1e6 AS head, epoch_us(began + INTERVAL '48 hours') / 1e6 - t1 AS tail FROM g WHERE n > 1 AND t1 > t0),
x AS (SELECT *, CASE WHEN head >= 1.1 * span / (n - 1) THEN span / (n - 1) / 2 ELSE head END AS h, CASE WHEN tail >= 1.1 * span / (n - 1) THEN span / (n - 1) / 2 ELSE tail END AS t FROM e),
r AS (SELECT event_type, began + INTERVAL '48 hours' AS "at", up * (span + t + CASE WHEN up > 0 AND v0 >= 0 THEN least(h, span * v0 / up) ELSE h END) / span / 172800.0 AS rate FROM x)
SELECT "at", event_type, round(sum(greatest(rate, 0.0001)), 10) AS total, round(max(greatest(rate, 0.0001)), 10) AS highest, round(avg(greatest(rate, 0.0001)), 10) AS mean FROM r GROUP BY ALL""")
def counter_rates_by_type(spark, sf_dir):
    """Rates of counters that fall back now and then, over two days, every twelve hours; sums, greatest and means of a type, from 0.0001 on."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts"))
    c = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", (F.floor("value") + F.when(F.col("event_id") % 7 == 0, 0).otherwise(nth)).alias("v"))
    rates = metrics.counter_rates(c, ["user_id", "event_type"], "ts", "v", "48 hours", "12 hours")
    rows = metrics.by_label(rates, ["at", "event_type"], "rate", 0.0001)
    return rows.select(F.col("at").cast("timestamp_ntz").alias("at"), "event_type", *(F.round(c, 10).alias(c) for c in ("total", "highest", "mean")))


@query("""
WITH w AS (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS w FROM documents)
SELECT 'all' AS search, doc_id FROM w WHERE list_has_all(w, ['the', 'and']) UNION ALL SELECT 'any', doc_id FROM w WHERE list_has_any(w, ['und', 'que', 'nowhere'])""")
def containment_searches(spark, sf_dir):
    """Rows that hold all, or one, of some terms, from an inverted table of all terms."""
    path = workspace(spark, "postings")
    containment.build(table(spark, sf_dir, "documents").select("doc_id", F.split(F.lower("text"), " ").alias("words")), "doc_id", "words", path)
    found = containment.containing_all(spark, path, ["the", "and"]).select(F.lit("all").alias("search"), F.col("id").alias("doc_id"))
    return found.unionByName(containment.containing_any(spark, path, ["und", "que", "nowhere"]).select(F.lit("any").alias("search"), F.col("id").alias("doc_id")))


_RAW = "concat(' <b>', p_name, '</b> &amp;&#33;', chr(10), p_type)"


@query(r"""
SELECT p_partkey, p_name || ' &! ' || p_type AS tidy, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS free, CAST(CASE WHEN p_partkey % 2 = 0 THEN p_size * 1024 ELSE p_size END AS BIGINT) AS bytes,
  p_name || '|' || p_type AS terms, true AS as_columns FROM part""")
def sql_function_rules(spark, sf_dir):
    """The rules for texts, flags, sizes and lists in SQL alone, beside what the Columns say."""
    sql_functions.register(spark)
    part = spread(table(spark, sf_dir, "part"))
    part.createOrReplaceTempView("millrace_part")
    rows = spark.sql(f"""
      SELECT p_partkey, tidy_text({_RAW}) AS tidy, as_bool(CASE p_partkey % 3 WHEN 0 THEN ' Open ' WHEN 1 THEN '불가' ELSE 'maybe' END) AS free,
        as_bytes(concat('about ', p_size, CASE WHEN p_partkey % 2 = 0 THEN ' KiB' ELSE ' files' END)) AS bytes, distinct_fold(array(p_name, NULL, upper(p_name), ' ', p_type, p_name)) AS terms FROM millrace_part""")
    raw = F.expr(_RAW)
    k = F.col("p_partkey")
    said = part.select(
        "p_partkey", text.clean(raw).alias("c_tidy"), numbers.parse_bool(F.when(k % 3 == 0, " Open ").when(k % 3 == 1, "불가").otherwise("maybe")).alias("c_free"),
        numbers.parse_bytes(F.concat(F.lit("about "), F.col("p_size").cast("string"), F.when(k % 2 == 0, " KiB").otherwise(" files"))).alias("c_bytes"),
        arrays.unique_ci(F.array(F.col("p_name"), F.lit(None).cast("string"), F.upper("p_name"), F.lit(" "), F.col("p_type"), F.col("p_name"))).alias("c_terms"),
    )
    same = F.struct("tidy", "free", "bytes", "terms").eqNullSafe(F.struct(*(F.col(f"c_{c}").alias(c) for c in ("tidy", "free", "bytes", "terms"))))
    return rows.join(said, "p_partkey").select("p_partkey", "tidy", "free", "bytes", F.array_join("terms", "|").alias("terms"), same.alias("as_columns"))


@query("""
WITH RECURSIVE p AS (SELECT doc_id, CAST(-1 AS INTEGER) AS nth, '' AS part, text AS rest FROM documents WHERE text <> ''
UNION ALL SELECT doc_id, nth + 1, substr(rest, 1, n), substr(rest, n + 1) FROM (SELECT *, CASE WHEN length(rest) <= 500 OR NOT contains(substr(rest, 1, 500), ' ') THEN 500 ELSE 501 - strpos(reverse(substr(rest, 1, 500)), ' ') END AS n FROM p WHERE rest <> ''))
SELECT doc_id, nth, part FROM p WHERE nth >= 0""")
def table_function_parts(spark, sf_dir):
    """Texts in parts of 500 characters at most, by a table function in SQL."""
    sql_functions.register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("millrace_documents")
    return spark.sql("SELECT doc_id, t.nth, t.part FROM millrace_documents, LATERAL text_parts(text, 500) t")
