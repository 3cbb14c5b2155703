"""Relational coverage beyond the catalogue's own queries: grouping sets, as-of joins, set operations, approximations, pivots, windows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.plans.registry import query
from millrace.session import table


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def rollup_cube_grouping_sets(spark, sf_dir):
    """Sums over all groupings of two columns."""
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""
WITH o AS (SELECT o_custkey, o_orderdate, max(o_totalprice) AS price FROM orders GROUP BY 1, 2)
SELECT e.event_id, e.user_id, o.price FROM events e ASOF LEFT JOIN o ON o.o_custkey = e.user_id AND o.o_orderdate <= e.ts""")
def asof_join_latest_price(spark, sf_dir):
    """The price that held at each event: both sides in one stream by key and time, and the last value seen. One shuffle, no range join."""
    prices = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("at")).agg(F.max("o_totalprice").alias("price"))
    both = prices.select("user_id", "at", "price", F.lit(None).cast("bigint").alias("event_id"), F.lit(0).alias("side"))
    both = both.unionByName(table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("at"), F.lit(None).cast("double").alias("price"), "event_id", F.lit(1).alias("side")))
    w = Window.partitionBy("user_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("price", F.last("price", ignorenulls=True).over(w)).where("side = 1").select("event_id", "user_id", "price")


@query("SELECT c_custkey AS k, 'both' AS side FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'none' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def setops_intersect_except(spark, sf_dir):
    """Intersection and difference of key sets."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return c.intersect(o).withColumn("side", F.lit("both")).unionByName(c.subtract(o).withColumn("side", F.lit("none")))


def sketches_near(rows, group, key, value):
    """For each group whether the sketches of its keys and of its values' median are near the exact ones (of no keys or values: they are).

    Each aggregation on its own: beside an exact distinct count, Spark would keep the sketches of every (group, key). The median is judged
    by its rank, the rows below it and up to it, so nothing holds all values of a group.
    """
    rows = rows.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(value).alias("v"))
    sketches = rows.groupBy("g").agg(F.approx_count_distinct("k", 0.03).alias("parts"), F.percentile_approx("v", 0.5, 1000).alias("median"), F.count("*").alias("n"))
    exact = rows.select("g", "k").distinct().groupBy(F.col("g").alias("of_keys")).agg(F.count("k").alias("exact"))
    below = F.sum(F.when(F.col("v") < F.col("median"), F.col("rows")).otherwise(0))
    upto = F.sum(F.when(F.col("v") <= F.col("median"), F.col("rows")).otherwise(0))
    values = rows.where("v IS NOT NULL").groupBy("g", "v").agg(F.count("*").alias("rows"))
    medians = F.broadcast(sketches.select(F.col("g").alias("of"), "median"))
    ranks = values.join(medians, F.col("g").eqNullSafe(F.col("of"))).groupBy(F.col("g").alias("of_values")).agg(F.sum("rows").alias("all"), below.alias("below"), upto.alias("upto"))
    near = (100 * F.col("below") <= 51 * F.col("all")) & (100 * F.col("upto") >= 49 * F.col("all"))
    out = sketches.join(exact, F.col("g").eqNullSafe(F.col("of_keys"))).join(ranks, F.col("g").eqNullSafe(F.col("of_values")), "left")
    return out.select(F.col("g").alias(group), (F.abs(F.col("parts") - F.col("exact")) <= 0.1 * F.col("exact")).alias("parts_near"), F.coalesce(near, F.lit(True)).alias("median_near"), "n")


@query("SELECT l_returnflag, true AS parts_near, true AS median_near, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def approx_distinct_and_quantiles(spark, sf_dir):
    """Sketches: distinct counts within a tenth, and quantiles within a hundredth of the ranks, of the exact ones."""
    return sketches_near(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_partkey", "l_quantity")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority")
def status_pivot(spark, sf_dir):
    """Pivot over a closed vocabulary."""
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return counts.select("o_orderpriority", *(F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")))


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf_dir):
    """Sums over a large scan: filter and columns are pushed down, one partial aggregation."""
    return table(spark, sf_dir, "lineitem").where("l_shipdate <= date '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


@query("""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
WHERE r_name = 'ASIA' GROUP BY n_name""")
def revenue_by_nation(spark, sf_dir):
    """A chain of joins over the star schema; Catalyst orders it and picks broadcasts by size."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    rows = rows.join(t("region").where("r_name = 'ASIA'"), F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""
SELECT user_id, event_id, round(value - lag(value) OVER w, 6) AS change, CAST(rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS INTEGER) AS value_rank, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def window_frames(spark, sf_dir):
    """Lag, rank and a moving mean over one partitioning."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    change = F.round(F.col("value") - F.lag("value").over(w), 6)
    return table(spark, sf_dir, "events").select("user_id", "event_id", change.alias("change"), F.rank().over(Window.partitionBy("user_id").orderBy(F.desc("value"))).alias("value_rank"), F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 6).alias("mean3"))
