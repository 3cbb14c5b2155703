"""Optional filters, sorts, joins and aggregates of a catalogue's lists and detail pages."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import arrays, dates, nested
from millrace.operators import listing, tables
from millrace.plans.registry import query
from millrace.session import table


@query("""
SELECT 'none' AS asked, count(*) AS n FROM part UNION ALL SELECT 'id', count(*) FROM part WHERE p_partkey = 7 UNION ALL SELECT 'keyword', count(*) FROM part WHERE p_name ILIKE '%ring%'
UNION ALL SELECT 'both', count(*) FROM part WHERE p_name ILIKE '%ring%' AND p_brand = 'Brand#1' UNION ALL SELECT 'wildcard', count(*) FROM part WHERE p_name ILIKE '%r_ng%'""")
def optional_filters(spark, sf_dir):
    """Conditions that hold for all rows where they are not asked for; wildcards of a keyword are not escaped."""
    part = table(spark, sf_dir, "part")
    asked = {"none": {}, "id": {"equal": {"p_partkey": 7}}, "keyword": {"keyword": "ring"}, "both": {"keyword": "RING", "equal": {"p_brand": "Brand#1"}}, "wildcard": {"keyword": "r_ng"}}
    counts = [listing.optional(part, "p_name", **{"keyword": None, "equal": {}} | o).agg(F.count("*").alias("n")).select(F.lit(n).alias("asked"), "n") for n, o in asked.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("""
WITH c AS (SELECT c_custkey, c_acctbal < 0 AS is_deleted, CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-01-01' END AS deleted_at FROM customer)
SELECT c_custkey FROM c WHERE NOT is_deleted AND deleted_at IS NULL""")
def soft_deletes(spark, sf_dir):
    """Rows that neither of two marks has deleted."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") < 0).alias("is_deleted"), F.when(F.col("c_custkey") % 3 == 0, F.lit("2024-01-01").cast("timestamp")).alias("deleted_at"))
    return listing.active(rows).select("c_custkey")


@query("""
WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'dataset' ELSE 'api' END AS type, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 3 = 0 END AS free, p_retailprice AS score, strftime(DATE '2024-01-01' + CAST(p_size AS INTEGER), '%Y. %m. %d') AS updated FROM part)
SELECT p_partkey, 'paid' AS view, row_number() OVER (ORDER BY score DESC, p_partkey) AS place FROM c WHERE NOT coalesce(free, false)
UNION ALL SELECT p_partkey, 'latest datasets', row_number() OVER (ORDER BY updated DESC, p_partkey) FROM c WHERE type = 'dataset'
UNION ALL SELECT p_partkey, 'free and paid', row_number() OVER (ORDER BY score DESC, p_partkey) FROM c""")
def result_views(spark, sf_dir):
    """A result list by price and type, best or latest first. Each view is a whole list, so it is ranked whole, as a page of results is."""
    k = F.col("p_partkey")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")), "yyyy. MM. dd")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 2 == 0, "dataset").otherwise("api").alias("type"), F.when(k % 5 > 0, k % 3 == 0).alias("free"), F.col("p_retailprice").alias("score"), day.alias("updated"))
    views = {"paid": listing.result_view(rows, prices=("paid",)), "latest datasets": listing.result_view(rows, kind="dataset", latest=True), "free and paid": listing.result_view(rows, prices=("free", "paid"))}
    out = [v.select("p_partkey", F.lit(n).alias("view"), F.col("place").cast("bigint").alias("place")) for n, v in views.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""
WITH p AS (SELECT o_orderkey, o_custkey % 10 AS views, o_orderkey % 7 AS likes, o_orderdate AS created FROM orders)
(SELECT 'LATEST' AS sort, o_orderkey FROM p ORDER BY created DESC, o_orderkey LIMIT 10) UNION ALL (SELECT 'VIEW_COUNT', o_orderkey FROM p ORDER BY views DESC, created DESC, o_orderkey LIMIT 10) UNION ALL (SELECT 'FAVORITE', o_orderkey FROM p ORDER BY likes DESC, created DESC, o_orderkey LIMIT 10)""")
def post_sorts(spark, sf_dir):
    """First pages of posts by date, by views and by likes; each is a top-k."""
    posts = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 10).alias("views"), (F.col("o_orderkey") % 7).alias("likes"), F.col("o_orderdate").alias("created"))
    out = None
    for name in listing.POST_SORTS:
        one = tables.page(posts, 0, 10, *listing.post_order(name), F.asc("o_orderkey")).select(F.lit(name).alias("sort"), "o_orderkey")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
WITH p AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN (event_id % 59) || '분 전' WHEN 1 THEN (event_id % 23) || '시간 전' ELSE '방금 전' END AS shown, CASE event_id % 3 WHEN 0 THEN (event_id % 59) / 60.0 WHEN 1 THEN event_id % 23 ELSE 0 END AS hours FROM events)
SELECT event_id, shown FROM p ORDER BY hours, event_id LIMIT 25""")
def relative_time_sort(spark, sf_dir):
    """The newest posts by times such as "5분 전"."""
    k = F.col("event_id")
    shown = F.when(k % 3 == 0, F.concat((k % 59).cast("string"), F.lit("분 전"))).when(k % 3 == 1, F.concat((k % 23).cast("string"), F.lit("시간 전"))).otherwise("방금 전")
    return table(spark, sf_dir, "events").select("event_id", shown.alias("shown")).orderBy(dates.relative_hours(F.col("shown")), "event_id").limit(25)


@query("""
WITH t AS (SELECT conv_id, turn, conv_id * 1000 + turn AS turn_id, role FROM conversations WHERE role = 'user'), d AS (SELECT conv_id * 1000 + turn AS turn_id, max(turn) AS d_id FROM conversations WHERE turn % 4 = 0 GROUP BY 1), a AS (SELECT conv_id * 1000 + turn AS turn_id, length(text) AS a_len FROM conversations WHERE turn % 3 = 0)
SELECT t.turn_id, d_id, a_len FROM t LEFT JOIN d USING (turn_id) LEFT JOIN a USING (turn_id)""")
def recommendations_of_turns(spark, sf_dir):
    """What was recommended, of both kinds, for each user turn."""
    c = table(spark, sf_dir, "conversations").withColumn("turn_id", F.col("conv_id") * 1000 + F.col("turn"))
    data = c.where("turn % 4 = 0").groupBy("turn_id").agg(F.max("turn").alias("d_id"))
    apis = c.where("turn % 3 = 0").select("turn_id", F.char_length("text").alias("a_len"))
    return listing.of_user_turns(c, {"d": data, "a": apis}).select("turn_id", "d_id", "a_len")


@query("""
WITH i AS (SELECT 'dataset' AS type, c_custkey AS id, c_acctbal / 10000 AS score FROM customer UNION ALL SELECT 'api', s_suppkey, CASE WHEN s_suppkey % 4 > 0 THEN s_acctbal / 10000 END FROM supplier),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, type, id) AS rank FROM i), c AS (SELECT 'dataset' AS type, c_custkey AS id, c_name AS name FROM customer WHERE c_nationkey < 12 UNION ALL SELECT 'api', s_suppkey, s_name FROM supplier WHERE s_nationkey < 12)
SELECT type, id, CASE WHEN name IS NOT NULL THEN rank END AS rank, coalesce(name, '이름 없는 리소스') AS name, CASE WHEN name IS NULL THEN '상세 정보 로드 실패' END AS problem FROM r LEFT JOIN c USING (type, id) WHERE rank <= 40""")
def ranked_cards(spark, sf_dir):
    """The best items of two kinds in one ranking, with their cards; items without a card say so."""
    items = table(spark, sf_dir, "customer").select(F.lit("dataset").alias("type"), F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 10000).alias("score"))
    items = items.unionByName(table(spark, sf_dir, "supplier").select(F.lit("api").alias("type"), F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 4 > 0, F.col("s_acctbal") / 10000).alias("score")))
    cards = table(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.lit("dataset").alias("type"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    cards = cards.unionByName(table(spark, sf_dir, "supplier").where("s_nationkey < 12").select(F.lit("api").alias("type"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))
    return listing.ranked_cards(items, cards, 40).select("type", "id", F.col("rank").cast("bigint").alias("rank"), "name", "problem")


@query("""
SELECT l_partkey, avg(CASE WHEN l_linenumber % 3 > 0 THEN l_quantity END) AS rating, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n_flagged, count(*) AS n FROM lineitem GROUP BY l_partkey""")
def finite_ratings(spark, sf_dir):
    """Average over ratings that are numbers, and counts of flagged ones."""
    rating = F.when(F.col("l_linenumber") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", rating.alias("rating"), "l_returnflag")
    return rows.groupBy("l_partkey").agg(listing.finite_average("rating").alias("rating"), F.count_if(F.col("l_returnflag") == "R").alias("n_flagged"), F.count("*").alias("n"))


@query("""
WITH e AS (SELECT user_id, list('error ' || event_id ORDER BY event_id) AS errors FROM events WHERE event_type = 'error' GROUP BY user_id), c AS (SELECT user_id, count(*) AS collected, count(*) FILTER (event_type = 'purchase') AS upserted, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY user_id)
SELECT c.user_id, collected, upserted, failed, CASE WHEN failed > 0 THEN array_to_string(errors[1:3], chr(10)) || CASE WHEN failed > 3 THEN chr(10) || '... and ' || (failed - 3) || ' more' ELSE '' END END AS summary,
  CASE WHEN failed = 0 THEN 'SUCCESS' WHEN upserted > 0 THEN 'PARTIAL_SUCCESS' ELSE 'FAILED' END AS status FROM c LEFT JOIN e USING (user_id)""")
def run_counters(spark, sf_dir):
    """What a run collected, stored and failed on, with its first errors. Only the first errors of a run are gathered."""
    return listing.run_counters(table(spark, sf_dir, "events"), 3)


@query("SELECT doc_id, CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'and') AS INT) + CAST(contains(lower(text), 'der') AS INT) + CAST(contains(lower(text), 'que') AS INT) AS hits FROM documents")
def token_hits(spark, sf_dir):
    """How many of some words each text has."""
    from millrace.operators import records

    return table(spark, sf_dir, "documents").select("doc_id", records.hits(F.col("text"), ("the", "and", "der", "que")).alias("hits"))


@query("""
SELECT p_partkey, max_by(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS last_order FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY p_partkey""")
def latest_saved_key(spark, sf_dir):
    """The key saved last for each source: the greatest by time and id, aggregated before it meets the sources."""
    saved = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("o_orderkey") == F.col("l_orderkey"))
    last = saved.groupBy("l_partkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"))
    return table(spark, sf_dir, "part").select("p_partkey").join(last, F.col("l_partkey") == F.col("p_partkey")).select("p_partkey", "last_order")


@query("""
SELECT p_partkey, 'b,c' AS overlaid, CAST(3 AS INTEGER) AS n_over, p_name AS localized, p_brand AS node, p_type AS extra, 'title' AS local_name, CAST(p_size AS VARCHAR) AS at_path, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 0 END AS checkpoint, p_partkey % 2 = 0 AS has_columns,
  '{"a":"x","c":["y"]}' AS pruned, CASE WHEN p_size = 0 THEN NULL ELSE p_size END AS n_label FROM part""")
def json_rules(spark, sf_dir):
    """Values of JSON by path, language, node and name; maps overlaid; empty values and banned keys out; numeric strings and aliases of keys."""
    k = F.col("p_partkey")
    row = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("p_size").alias("b"))).alias("a")).alias("x")))
    words = F.to_json(F.struct(F.lit("").alias("ko"), F.col("p_name").alias("en")))
    node = F.to_json(F.create_map(F.lit("@value"), F.col("p_brand")))
    extras = F.to_json(F.array(F.struct(F.lit("k").alias("key"), F.lit("old").alias("value")), F.struct(F.lit("k").alias("key"), F.col("p_type").alias("value"))))
    names = nested.local_names(F.create_map(F.lit("http://purl.org/dc/terms/title"), F.lit(1)))
    over = nested.overlay(F.create_map(F.lit("a"), F.lit("b"), F.lit("z"), F.lit("c")), F.create_map(F.lit("a"), F.lit("b"), F.lit("q"), F.lit("w")))
    messy = F.lit('{"a": " x ", "b": "", "c": [null, "y", {}], "programCode": {"d": 1}}')
    schema = F.when(k % 2 == 0, F.lit('{"columns": [{"name": "a"}]}')).otherwise('{"columns": []}')
    label = F.to_json(F.struct(F.col("p_size").cast("string").alias("datasetId")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.concat_ws(",", over["a"], over["z"]).alias("overlaid"), F.size(over).alias("n_over"), nested.localized(words, "ko", "en").alias("localized"), nested.node_value(node).alias("node"), nested.entries_to_map(extras)["k"].alias("extra"), F.element_at(F.map_keys(names), 1).alias("local_name"),
        nested.get(row, "x", "a", 0, "b").alias("at_path"), nested.integer_or_zero(F.when(k % 2 == 0, F.col("p_size").cast("string")).otherwise("12x")).cast("int").alias("checkpoint"), nested.has_items(schema, "columns").alias("has_columns"), nested.pruned(("programcode",))(messy).alias("pruned"), nested.first_number(label, "id", "datasetId").cast("int").alias("n_label"),
    )


@query("""
WITH w AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders)
SELECT o_orderkey, lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_price, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS last_price, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS quarter,
  dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS day, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS place, round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice), 9) AS share FROM w""")
def window_ranks(spark, sf_dir):
    """Lead, lag, quarters, ranks and shares within each customer."""
    by_day, by_price = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    day, price = Window.partitionBy("o_custkey").orderBy("o_orderdate"), Window.partitionBy("o_custkey").orderBy("o_totalprice")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return rows.select("o_orderkey", F.lead("o_totalprice").over(by_day).alias("next_price"), F.lag("o_totalprice").over(by_day).alias("last_price"), F.ntile(4).over(by_price).cast("bigint").alias("quarter"), F.dense_rank().over(day).cast("bigint").alias("day"), F.rank().over(day).cast("bigint").alias("place"), F.round(F.percent_rank().over(price), 9).alias("share"))


@query("""
SELECT doc_id, array_to_string(list_slice(list_distinct(list_filter([doc_id % 5 + 1, doc_id % 3 + 1, 0 * doc_id + 1], lambda x: x > 0)), 1, 0), '') AS none, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 5 = doc_id % 3 THEN 1 ELSE 2 END AS n_ids, CAST(ceil((doc_id % 7) / 3.0) AS INTEGER) AS n_chunks, contains(lang, 'e') AS tagged FROM documents""")
def id_lists(spark, sf_dir):
    """Lists of ids checked and made distinct, cut to batches; containment."""
    k = F.col("doc_id")
    ids = arrays.positive_ids(F.array(k % 5 + 1, k % 3 + 1, F.when(k % 4 == 0, 0).otherwise(k % 5 + 1)))
    batches = arrays.chunked(F.slice(F.array(*map(F.lit, range(7))), 1, (k % 7).cast("int")), 3)
    return table(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("none"), F.size(ids).alias("n_ids"), F.size(batches).alias("n_chunks"), F.arrays_overlap(F.array("lang"), F.array(F.lit("en"), F.lit("de"), F.lit("es"))).alias("tagged"))
