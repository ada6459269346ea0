"""Queries on the star schema and the event stream: joins, grouping sets, windows, set operations, sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators import relational
from sparkloom.plans.base import Plans, read

plans = Plans()


@plans.add("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY 1, 2")
def x1_pricing(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@plans.add("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def x2_join_chain(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@plans.add("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def x3_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").join(read(spark, d, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@plans.add("SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping_id(o_orderstatus, o_orderpriority) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def x4_cube(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


@plans.add("SELECT o_custkey, o_orderkey, r AS place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def x5_top_by_group(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return read(spark, d, "orders").select("o_custkey", "o_orderkey", place.alias("place")).where("place <= 3")


@plans.add("SELECT p_partkey AS key FROM part INTERSECT SELECT l_partkey FROM lineitem")
def x6_intersect(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("key")).intersect(read(spark, d, "lineitem").select("l_partkey"))


@plans.add("SELECT p_partkey AS key FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48")
def x7_except(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("key")).subtract(read(spark, d, "lineitem").where("l_quantity > 48").select("l_partkey"))


@plans.add("SELECT a.event_id, max_by(b.value, (b.us, b.value)) AS spent FROM (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'click') a LEFT JOIN (SELECT user_id, epoch_us(ts) AS us, value FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND b.us <= a.us GROUP BY a.event_id")
def x8_as_of_join(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events")
    clicks = rows.where("event_type = 'click'").select("event_id", "user_id", "ts")
    bought = rows.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("spent"))
    return relational.as_of(clicks, bought, "user_id", "ts", "spent").select("event_id", "spent")


@plans.add("SELECT l.band, count(*) AS n FROM orders JOIN (SELECT unnest(range(0, 60)) * 10000 AS low, unnest(range(0, 60)) AS band) l ON o_totalprice >= l.low AND o_totalprice < l.low + 10000 GROUP BY l.band")
def x9_range_join(spark: SparkSession, d: str) -> DataFrame:
    bands = spark.range(60).select((F.col("id") * 10000).alias("low"), (F.col("id") * 10000 + 10000).alias("high"), F.col("id").alias("band"))
    return relational.within_range(read(spark, d, "orders").select("o_totalprice"), bands, "o_totalprice", "low", "high", 10000).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@plans.add("SELECT user_id, count(DISTINCT value) AS distinct_values, round(sum(value), 2) AS total FROM events GROUP BY user_id")
def x10_salted_distinct(spark: SparkSession, d: str) -> DataFrame:
    return relational.salted_sum(read(spark, d, "events"), "user_id", "value").withColumn("total", F.round("total", 2))


@plans.add("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_partkey) > 0 AS parts_close, count(*) > 0 AS median_close FROM lineitem GROUP BY l_returnflag")
def x11_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Sketches beside exact values: distinct parts within a tenth (two standard deviations of the sketch), the median's rank within a hundredth."""
    rows = read(spark, d, "lineitem")
    made = rows.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.05).alias("about"), F.countDistinct("l_partkey").alias("parts"), F.percentile_approx("l_extendedprice", 0.5, 1000).alias("median"))
    rank = rows.join(F.broadcast(made.select("l_returnflag", "median")), "l_returnflag").groupBy("l_returnflag").agg(F.avg((F.col("l_extendedprice") <= F.col("median")).cast("int")).alias("rank"))  # three flags
    close = lambda x, n: F.abs(x) <= n
    return made.join(rank, "l_returnflag").select("l_returnflag", "parts", close(F.col("about") / F.col("parts") - 1, 0.1).alias("parts_close"), close(F.col("rank") - 0.5, 0.01).alias("median_close"))


@plans.add("SELECT event_type, user_id, count(*) AS n, round(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)), 0) AS k FROM events GROUP BY 1, 2")
def x12_json_roll_up(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, d, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(k).cast("double").alias("k"))
