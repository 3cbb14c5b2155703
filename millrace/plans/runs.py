"""Run logs, inventories, merges, events. ``events`` stands for a log: user_id is the source, event_type the status."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import dates, nested
from millrace.operators import ingest, metrics, tables
from millrace.plans.registry import query
from millrace.session import table


#: The states of the log.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def _latest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return tables.latest(rows, ["user_id"], F.col("ts").desc_nulls_last(), F.col("event_id").desc())


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS n FROM events)
SELECT c_custkey, event_type AS last_status, event_id AS last_run, round(epoch(ts), 3) AS started_epoch FROM customer LEFT JOIN (SELECT * FROM r WHERE n = 1) ON user_id = c_custkey""")
def latest_run_per_source(spark, sf_dir):
    """The latest run of every source; sources without runs stay."""
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(_latest(spark, sf_dir), F.col("user_id") == F.col("c_custkey"), "left")
    return rows.select("c_custkey", F.col("event_type").alias("last_status"), F.col("event_id").alias("last_run"), F.round(dates.epoch_seconds(F.col("ts")), 3).alias("started_epoch"))


@query("""
SELECT n_name, count(c_custkey) FILTER (c_acctbal > 0) AS active, count(c_custkey) FILTER (c_acctbal < 0) AS failed, round(coalesce(sum(c_acctbal) FILTER (c_acctbal > 0), 0), 2) AS total, max(c_custkey) FILTER (c_mktsegment = 'BUILDING') AS last_id
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name""")
def source_inventory_filtered_aggs(spark, sf_dir):
    """Filtered aggregates of each source's rows; rows are summed before the join with the sources."""
    c = table(spark, sf_dir, "customer")
    up = F.col("c_acctbal") > 0
    sums = c.groupBy("c_nationkey").agg(
        F.count_if(up).alias("active"), F.count_if(F.col("c_acctbal") < 0).alias("failed"), F.sum(F.when(up, F.col("c_acctbal"))).alias("total"), F.max(F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_custkey"))).alias("last_id")
    )
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    rows = table(spark, sf_dir, "nation").join(sums, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("n_name", zero("active"), zero("failed"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"), "last_id")


@query("SELECT user_id, event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY ALL")
def runs_last_24h_by_status(spark, sf_dir):
    """Runs of the last day before ``as_of`` (the newest event)."""
    e = table(spark, sf_dir, "events")
    as_of = F.broadcast(e.agg(F.max("ts").alias("as_of")))  # one row
    return e.join(as_of, F.col("ts") >= F.col("as_of") - F.expr("interval 24 hours")).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS n FROM events), s AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS state)
SELECT user_id, state, CAST(CASE WHEN event_type = state THEN 1 ELSE 0 END AS DOUBLE) AS value FROM r, s WHERE n = 1""")
def latest_status_one_hot(spark, sf_dir):
    """Latest status as one number for each state of the (closed, small) vocabulary."""
    return metrics.one_hot(_latest(spark, sf_dir), "user_id", "event_type", EVENT_TYPES)


@query("SELECT user_id, round(greatest(0, (epoch((SELECT max(ts) FROM events)) - epoch(max(ts))) / 3600), 4) AS hours FROM events GROUP BY user_id")
def hours_since_last_event(spark, sf_dir):
    """Hours since each source's last event."""
    e = table(spark, sf_dir, "events")
    as_of = F.broadcast(e.agg(F.max("ts").alias("as_of")))  # one row
    return e.groupBy("user_id").agg(F.max("ts").alias("t")).join(as_of).select("user_id", F.round(dates.hours_since(F.col("t"), F.col("as_of")), 4).alias("hours"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT user_id, event_type, event_id, round(value, 6) AS value FROM r WHERE n = 1""")
def upsert_latest_wins(spark, sf_dir):
    """Keyed upsert of the log's second half into a table made of its first."""
    keys, newest = ["user_id", "event_type"], (F.desc("ts"), F.desc("event_id"))
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", F.round("value", 6).alias("value"))
    middle = F.lit("2024-01-16").cast("timestamp_ntz")
    old, new = (tables.latest(e.where(half), keys, *newest).drop("ts") for half in (F.col("ts") < middle, F.col("ts") >= middle))
    return tables.upsert(old, new, keys)


@query("""
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer UNION ALL SELECT -1 - s_suppkey, 'NEW', s_acctbal FROM supplier""")
def upsert_partial_columns(spark, sf_dir):
    """Upsert that keeps some columns of known rows."""
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = old.where("c_acctbal < 0").select("c_custkey", F.lit("NEW").alias("c_mktsegment"), F.lit(0.0).alias("c_acctbal"))
    new = new.unionByName(table(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"), F.col("s_acctbal").alias("c_acctbal")))
    return tables.upsert(old, new, ["c_custkey"], keep=("c_acctbal",))


@query("""
SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1995) THEN 'ACTIVE' ELSE 'INACTIVE' END ELSE 'ERROR' END AS status FROM customer""")
def reconcile_missing_inactive(spark, sf_dir):
    """Active rows that a full run has not seen become inactive."""
    known = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, "ACTIVE").otherwise("ERROR").alias("status"))
    seen = table(spark, sf_dir, "orders").where(F.year("o_orderdate") == 1995).select(F.col("o_custkey").alias("c_custkey"))
    return tables.reconcile(known, seen, "c_custkey", tables.may_reconcile(True, False, 0, 1))


@query("""
WITH d AS (SELECT doc_id, sha256('{"text":' || to_json(CASE WHEN trim(text) <> '' THEN text END) || '}') AS record_hash FROM documents)
SELECT record_hash, min(doc_id) AS first_doc, count(*) AS n FROM d GROUP BY record_hash""")
def record_hash_dedup(spark, sf_dir):
    """Records with one content hash."""
    d = table(spark, sf_dir, "documents").select("doc_id", ingest.record_hash(text=F.col("text")).alias("record_hash"))
    return d.groupBy("record_hash").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (json_extract_string(props, '$.k') IS NOT NULL) AS has_k, count(*) FILTER (json_extract_string(props, '$.missing') IS NOT NULL) AS has_missing FROM events GROUP BY event_type")
def field_presence_profile(spark, sf_dir):
    """How many records have each field."""
    p = ingest.presence(k=nested.get(F.col("props"), "k"), missing=nested.get(F.col("props"), "missing"))
    e = table(spark, sf_dir, "events").select("event_type", p.alias("p"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("p")["k"]).alias("has_k"), F.count_if(F.col("p")["missing"]).alias("has_missing"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(TRY_CAST(CASE WHEN regexp_matches(json_extract_string(props, '$.k'), '^[0-9]+$') THEN json_extract_string(props, '$.k') END AS BIGINT), 0) AS k_number FROM events")
def json_props_extract(spark, sf_dir):
    """A field of JSON as text and as a guarded number."""
    k = nested.get(F.col("props"), "k")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.coalesce(nested.integer_or_zero(k), F.lit(0)).alias("k_number"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS position FROM events ORDER BY position DESC, event_id DESC LIMIT 1")
def checkpoint_pick(spark, sf_dir):
    """The furthest checkpoint; numbers compare as numbers."""
    position = F.coalesce(nested.integer_or_zero(nested.get(F.col("props"), "k")), F.lit(0))
    return table(spark, sf_dir, "events").select("event_id", position.alias("position")).orderBy(F.desc("position"), F.desc("event_id")).limit(1)


@query("""
WITH s AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, count(*) OVER () AS n FROM nation)
SELECT n_nationkey, CAST(floor(240.0 * i / n) % 60 AS INTEGER) AS at_minute, CAST(floor(floor(240.0 * i / n) / 60) AS INTEGER) AS at_hour FROM s""")
def stagger_schedule(spark, sf_dir):
    """Sources spread evenly over four hours. The dimension of sources is small."""
    slots = table(spark, sf_dir, "nation").select("n_nationkey", (F.row_number().over(Window.orderBy("n_nationkey")) - 1).alias("i"), F.count("*").over(Window.partitionBy(F.lit(1))).alias("n"))
    at = F.floor(F.lit(240.0) * F.col("i") / F.col("n")).cast("int")
    return slots.select("n_nationkey", (at % 60).alias("at_minute"), F.floor(at / 60).cast("int").alias("at_hour"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS started, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_window_counts(spark, sf_dir):
    """Counts by hour and type."""
    e = table(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type")
    return e.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("started"), "event_type", "n", "total")


@query("""
WITH b AS (SELECT event_type, time_bucket(INTERVAL '1 minute', ts) AS m FROM events), s AS (SELECT event_type, m - to_minutes(k) AS started FROM b, range(0, 5) t(k))
SELECT started, event_type, round(count(*) / 300.0, 6) AS rate FROM s GROUP BY ALL""")
def sliding_rate_5m(spark, sf_dir):
    """Rate over five minutes, every minute."""
    e = table(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "5 minutes", "1 minute").alias("w"), "event_type")
    return e.agg(F.round(F.count("*") / 300.0, 6).alias("rate")).select(F.col("w.start").cast("timestamp_ntz").alias("started"), "event_type", "rate")


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, session""")
def session_gap_30m(spark, sf_dir):
    """Sessions that end after half an hour without events."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "30 minutes").alias("w"))
    return e.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n")


@query("""
WITH m AS (SELECT user_id, ts, event_id, value < 20 AS bad FROM events),
r AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM m)
SELECT user_id, min(ts) AS began, max(ts) AS ended FROM r WHERE bad GROUP BY user_id, run HAVING max(ts) - min(ts) >= INTERVAL 120 SECOND""")
def alert_condition_held(spark, sf_dir):
    """Stretches over which a condition held for two minutes or more."""
    return metrics.held_for(table(spark, sf_dir, "events"), "user_id", "ts", F.col("value") < 20, 120)


@query("""
WITH l AS (SELECT user_id, count(*) AS n, max(epoch(ts)) AS t FROM events GROUP BY user_id)
SELECT 'runs' AS metric, user_id, CAST(n AS DOUBLE) AS value FROM l UNION ALL SELECT 'last_epoch', user_id, round(t, 3) FROM l""")
def gauge_samples(spark, sf_dir):
    """Metrics in long format."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("t"))
    return metrics.gauges(rows, "user_id", runs=F.col("n"), last_epoch=F.round(dates.epoch_seconds(F.col("t")), 3))
