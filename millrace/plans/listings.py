"""Browsing: keyword search, paging, ratings, flags, references, counts."""

from pyspark.sql import functions as F

from millrace.operators import tables
from millrace.plans.registry import query
from millrace.session import table


@query("SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_name ILIKE '%ring%' OR p_name ILIKE '%a%' ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 40")
def active_keyword_page_latest(spark, sf_dir):
    """Third page of a keyword search."""
    hits = table(spark, sf_dir, "part").where(F.col("p_name").ilike("%ring%") | F.col("p_name").ilike("%a%")).select("p_partkey", "p_name", "p_retailprice")
    return tables.page(hits, 2, 20, F.desc("p_retailprice"), F.asc("p_partkey"))


@query("""
WITH r AS (SELECT l_partkey, round(avg(l_quantity), 6) AS rating FROM lineitem GROUP BY l_partkey)
SELECT p_partkey, p_name, rating FROM part LEFT JOIN r ON l_partkey = p_partkey ORDER BY rating DESC NULLS LAST, p_partkey LIMIT 20""")
def page_by_score_then_id(spark, sf_dir):
    """First page by average rating; ratings are aggregated before the join."""
    ratings = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.round(F.avg("l_quantity"), 6).alias("rating"))
    rows = table(spark, sf_dir, "part").join(ratings, F.col("l_partkey") == F.col("p_partkey"), "left").select("p_partkey", "p_name", "rating")
    return tables.page(rows, 0, 20, F.col("rating").desc_nulls_last(), F.asc("p_partkey"))


@query("SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'a') OR contains(lower(coalesce(p_type, '')), 'steel') ORDER BY p_size DESC, p_partkey LIMIT 30")
def two_column_keyword_search(spark, sf_dir):
    """Keyword in either of two columns."""
    hit = F.lower("p_name").contains("a") | F.lower(F.coalesce("p_type", F.lit(""))).contains("steel")
    return table(spark, sf_dir, "part").where(hit).orderBy(F.desc("p_size"), "p_partkey").limit(30).select("p_partkey", "p_name", "p_type")


@query("""
SELECT kind, id, name FROM (SELECT 0 AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 1, s_suppkey, s_name FROM supplier)
ORDER BY kind, id LIMIT 20 OFFSET (SELECT count(*) - 10 FROM customer)""")
def union_block_paging(spark, sf_dir):
    """The page on which the first block ends and the second begins."""
    first = table(spark, sf_dir, "customer").select(F.lit(0).alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    second = table(spark, sf_dir, "supplier").select(F.lit(1).alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return tables.page_of_blocks([first, second], first.count() - 10, 20, "id")


@query("SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages, 3 + 1 < ceil(count(*) / 20.0) AS has_next FROM orders WHERE o_orderstatus = 'F'")
def page_envelope_counts(spark, sf_dir):
    """Total, pages and whether there is a next one."""
    return tables.envelope(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), 3, 20)


@query("SELECT l_partkey, round(avg(l_quantity), 6) AS rating, count(*) AS n FROM lineitem WHERE l_partkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89) GROUP BY l_partkey")
def avg_rating_in_list(spark, sf_dir):
    """Average rating of given ids; the list is pushed to the scan."""
    return table(spark, sf_dir, "lineitem").where(F.col("l_partkey").isin(1, 2, 3, 5, 8, 13, 21, 34, 55, 89)).groupBy("l_partkey").agg(F.round(F.avg("l_quantity"), 6).alias("rating"), F.count("*").alias("n"))


@query("""
WITH r AS (SELECT l_partkey, avg(l_quantity) AS a FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey)
SELECT p_partkey, round(coalesce(a, 0), 6) AS rating FROM part LEFT JOIN r ON l_partkey = p_partkey""")
def avg_rating_materialized(spark, sf_dir):
    """The rating column of every item, 0 without reviews."""
    ratings = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.avg("l_quantity").alias("a"))
    return table(spark, sf_dir, "part").join(ratings, F.col("l_partkey") == F.col("p_partkey"), "left").select("p_partkey", F.round(F.coalesce("a", F.lit(0.0)), 6).alias("rating"))


@query("""
WITH b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT c_custkey, o_custkey IS NOT NULL AS is_bookmarked, NOT coalesce(CASE WHEN c_acctbal >= 0 THEN c_acctbal < 1000 END, false) AS is_free_listed, NOT (CASE WHEN c_acctbal >= 0 THEN c_acctbal < 1000 END) AS is_free_bookmarked
FROM customer LEFT JOIN b ON o_custkey = c_custkey""")
def bookmark_flag_left_join(spark, sf_dir):
    """Existence as a flag; an unknown price is free in listings and unknown among bookmarks."""
    marked = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey").distinct()
    paid = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") < 1000)
    rows = table(spark, sf_dir, "customer").join(marked, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("c_custkey", F.col("o_custkey").isNotNull().alias("is_bookmarked"), (~F.coalesce(paid, F.lit(False))).alias("is_free_listed"), (~paid).alias("is_free_bookmarked"))


@query("""
WITH d AS (SELECT 'DATASET' AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'OPEN_API', s_suppkey, s_name FROM supplier),
r AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'DATASET' ELSE 'OPEN_API' END AS kind, user_id AS id FROM events)
SELECT event_id, r.kind, r.id, name FROM r LEFT JOIN d ON d.kind = r.kind AND d.id = r.id""")
def polymorphic_reference_join(spark, sf_dir):
    """References by (type, id) to two tables."""
    dims = table(spark, sf_dir, "customer").select(F.lit("DATASET").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    dims = dims.unionByName(table(spark, sf_dir, "supplier").select(F.lit("OPEN_API").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))
    refs = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "DATASET").otherwise("OPEN_API").alias("kind"), F.col("user_id").alias("id"))
    return refs.join(dims, ["kind", "id"], "left").select("event_id", "kind", "id", "name")


@query("""
WITH p AS (SELECT o_orderkey, list(DISTINCT l_partkey) AS refs FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' GROUP BY o_orderkey),
e AS (SELECT o_orderkey, unnest(refs) AS ref FROM p)
SELECT o_orderkey, count(*) AS n_refs, count(p_partkey) AS n_active, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS active FROM e LEFT JOIN part ON p_partkey = ref AND p_size > 10 GROUP BY o_orderkey""")
def post_array_refs(spark, sf_dir):
    """Arrays of references resolved against the active catalogue."""
    posts = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey").join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    posts = posts.groupBy("o_orderkey").agg(F.collect_set("l_partkey").alias("refs"))
    active = table(spark, sf_dir, "part").where("p_size > 10").select("p_partkey")
    refs = posts.select("o_orderkey", F.explode("refs").alias("ref")).join(active, F.col("p_partkey") == F.col("ref"), "left")
    found = F.array_sort(F.collect_list("p_partkey"))
    return refs.groupBy("o_orderkey").agg(F.count("*").alias("n_refs"), F.count("p_partkey").alias("n_active"), F.nullif(F.array_join(found, ","), F.lit("")).alias("active"))


@query("""
SELECT o_orderkey, o_custkey, CASE WHEN c_custkey IS NULL THEN 'NOT_FOUND' END AS error, c_name AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 WHERE o_orderpriority = '2-HIGH'""")
def cards_and_errors(spark, sf_dir):
    """A card for every item that the active catalogue has, an error for every other."""
    active = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
    items = table(spark, sf_dir, "orders").where("o_orderpriority = '2-HIGH'").select("o_orderkey", "o_custkey")
    joined = items.join(active, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("o_orderkey", "o_custkey", F.when(F.col("c_custkey").isNull(), "NOT_FOUND").alias("error"), F.col("c_name").alias("name"))


@query("""
SELECT c_custkey, coalesce(o.n, 0) AS n_orders, coalesce(e.n, 0) AS n_events FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) e ON user_id = c_custkey""")
def profile_counts(spark, sf_dir):
    """Counts of two kinds for each user; each side is aggregated before it is joined."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("no"))
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("ne"))
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").join(e, F.col("user_id") == F.col("c_custkey"), "left")
    return rows.select("c_custkey", F.coalesce("no", F.lit(0)).alias("n_orders"), F.coalesce("ne", F.lit(0)).alias("n_events"))


@query("""
WITH r AS (SELECT l_partkey, avg(l_discount) AS d FROM lineitem GROUP BY l_partkey)
SELECT p_partkey, p_name, d < 0.05 AS is_free FROM part LEFT JOIN r ON l_partkey = p_partkey WHERE p_brand = 'Brand#1' OR contains(lower(p_name), 'e') AND d < 0.05 ORDER BY p_partkey LIMIT 10 OFFSET 10""")
def bookmark_filter_paging(spark, sf_dir):
    """Filtered by type, word and known flag; second page."""
    r = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.avg("l_discount").alias("d"))
    rows = table(spark, sf_dir, "part").join(r, F.col("l_partkey") == F.col("p_partkey"), "left").withColumn("is_free", F.col("d") < 0.05)
    rows = rows.where((F.col("p_brand") == "Brand#1") | F.lower("p_name").contains("e") & F.col("is_free"))
    return tables.page(rows.select("p_partkey", "p_name", "is_free"), 1, 10, F.asc("p_partkey"))


@query("SELECT d.doc_id, d.lang, d.n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def not_embedded_anti_join(spark, sf_dir):
    """Rows that have not been worked on; texts are not read."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def done_keys_anti_join(spark, sf_dir):
    """Rows whose key is not among the done ones."""
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(done, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def owners_semi_join(spark, sf_dir):
    """Existence check."""
    big = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select("o_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(big, F.col("o_custkey") == F.col("c_custkey"), "left_semi")


@query("SELECT c_custkey, s_suppkey, coalesce(c_nationkey, s_nationkey) AS nation FROM (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c FULL JOIN supplier ON s_suppkey = c_custkey")
def crawl_merge_full_join(spark, sf_dir):
    """Two feeds merged on their key; either may lack a record."""
    a = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    rows = a.join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("c_custkey"), "full_outer")
    return rows.select("c_custkey", "s_suppkey", F.coalesce("c_nationkey", "s_nationkey").alias("nation"))


@query("SELECT o_orderkey, o_custkey, coalesce(c_name, '') AS author FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment = 'BUILDING'")
def author_names_left_join(spark, sf_dir):
    """Names of authors, empty where there is none."""
    names = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(names, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("o_orderkey", "o_custkey", F.coalesce("c_name", F.lit("")).alias("author"))
