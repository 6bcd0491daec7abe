"""Relational queries over the star schema, each beside SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import ratio, revenue
from tidemill.operators.joins import asof_join, epoch, interval_join
from tidemill.operators.preceding import preceding
from tidemill.operators.windows import sessions, top_k
from tidemill.sources import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Register a query by its name, with SQL of the same result."""

    def add(run: Query) -> Query:
        QUERIES[run.__name__], ORACLE_SQL[run.__name__] = run, sql
        return run

    return add


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 4) AS avg_qty
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(revenue()), 2).alias("revenue"), F.round(F.avg("l_quantity"), 4).alias("avg_qty")
    )


@query("""
SELECT o_orderkey, upper(substr(o_orderpriority, 1, 3)) AS priority, year(o_orderdate)::INTEGER AS order_year, month(o_orderdate)::INTEGER AS order_month,
    CASE WHEN o_totalprice >= 200000 THEN 'large' WHEN o_totalprice >= 50000 THEN 'medium' ELSE 'small' END AS size, round(ln(o_totalprice + 1), 4) AS log_price
FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority NOT LIKE '5%'
""")
def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "F") & ~F.col("o_orderpriority").like("5%"))
    return orders.select(
        "o_orderkey", F.upper(F.substring("o_orderpriority", 1, 3)).alias("priority"), F.year("o_orderdate").alias("order_year"), F.month("o_orderdate").alias("order_month"),
        F.when(price >= 200000, "large").when(price >= 50000, "medium").otherwise("small").alias("size"), F.round(F.ln(price + 1), 4).alias("log_price"),
    )


@query("""
SELECT r_name, n_name, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderstatus = 'F' GROUP BY ALL
""")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    joined = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    joined = joined.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.countDistinct("o_orderkey").alias("orders"), F.round(F.sum(revenue()), 2).alias("revenue"))


@query("""
SELECT c_custkey, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS spent
FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey
""")
def pending_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    joined = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0)), 2).alias("spent"))


@query("""
SELECT c_mktsegment, count(*) AS customers, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)) AS buyers
FROM customer GROUP BY c_mktsegment
""")
def large_buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 100000")
    buyers = orders.select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("buys", F.lit(1))
    customers = table(spark, sf_dir, "customer").join(buyers, "c_custkey", "left")
    return customers.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"), F.count("buys").alias("buyers"))


@query("""
SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::INTEGER AS level, round(sum(l_quantity), 2) AS qty
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
""")
def quantity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("int").alias("level"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("""
SELECT coalesce(p_brand, 'all') AS p_brand, coalesce(p_size, -1) AS p_size, count(*) AS n, round(avg(p_retailprice), 4) AS avg_price FROM part WHERE p_size <= 5 GROUP BY CUBE (part.p_brand, part.p_size)
""")
def part_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = table(spark, sf_dir, "part").where("p_size <= 5").cube("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 4).alias("avg_price"))
    return cube.select(F.coalesce("p_brand", F.lit("all")).alias("p_brand"), F.coalesce("p_size", F.lit(-1)).alias("p_size"), "n", "avg_price")


@query("""
SELECT c_nationkey, c_custkey, c_acctbal, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer
) WHERE rank <= 3
""")
def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = top_k(table(spark, sf_dir, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3)
    return best.select("c_nationkey", "c_custkey", "c_acctbal", F.col("rank").cast("long").alias("rank"))


@query("""
SELECT event_id, count(*) OVER w AS seen, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS change,
    round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS recent
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def event_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event beside the two before it of its user; a user's events are dealt to days, so a hot user isn't one task."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    day = F.floor(epoch("ts") / 86400)
    near = preceding(events, ["user_id"], F.col("ts"), F.col("event_id"), ["value"], 2, day, "seen")
    values = F.filter(F.concat(F.transform("before", lambda r: r["value"]), F.array("value")), lambda v: v.isNotNull())
    mean = F.try_divide(F.aggregate("values", F.lit(0.0), lambda total, v: total + v), F.size("values"))
    last = F.try_element_at("before", F.lit(-1))["value"]
    return near.withColumn("values", values).select("event_id", "seen", F.round(F.col("value") - last, 4).alias("change"), F.round(mean, 4).alias("recent"))


@query("""
SELECT c_nationkey AS nation, 'both' AS kind FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT c_nationkey, 'customers' FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)
""")
def nations_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    return customers.intersect(suppliers).withColumn("kind", F.lit("both")).union(customers.subtract(suppliers).withColumn("kind", F.lit("customers")))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def largest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("""
SELECT event_type, count(*) AS n, sum(try_cast(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k_sum, count(DISTINCT user_id) AS users,
    round(sum(value) / nullif(count(DISTINCT user_id), 0), 4) AS value_by_user FROM events GROUP BY event_type
""")
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(k).alias("k_sum"), F.countDistinct("user_id").alias("users"), ratio(F.sum("value"), F.countDistinct("user_id")).alias("value_by_user")
    )


@query("""
SELECT p.event_id, coalesce(c.event_id, -1) AS asof_event_id, c.value AS asof_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
LEFT JOIN LATERAL (
    SELECT event_id, value FROM events e WHERE e.event_type = 'click' AND e.user_id = p.user_id AND e.ts <= p.ts ORDER BY ts DESC, event_id DESC LIMIT 1
) c ON true
""")
def purchases_after_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = events.where("event_type = 'click'").select("user_id", "ts", "event_id", "value")
    joined = asof_join(bought, clicks, ["user_id"], "ts", ["event_id", "value"], "event_id", F.to_date("ts"))
    return joined.select("event_id", F.coalesce("asof_event_id", F.lit(-1)).cast("long").alias("asof_event_id"), "asof_value")


@query("""
WITH e AS (SELECT *, floor(epoch(ts))::BIGINT AS at FROM events)
SELECT a.event_id AS signup_id, count(b.event_id) AS views FROM e a JOIN e b ON a.user_id = b.user_id AND b.at >= a.at AND b.at < a.at + 86400
WHERE a.event_type = 'signup' AND b.event_type = 'view' GROUP BY a.event_id
""")
def views_in_first_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("at", epoch("ts"))
    spans = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("signup_id"), F.col("at").alias("start"), (F.col("at") + 86400).alias("stop"))
    views = events.where("event_type = 'view'").select("user_id", "event_id", "at")
    return interval_join(views, spans, ["user_id"], "at", "start", "stop", 86400).groupBy("signup_id").agg(F.count("event_id").alias("views"))


@query("""
WITH e AS (SELECT user_id, event_id, value, floor(epoch(ts))::BIGINT AS sec FROM events),
s AS (SELECT *, CASE WHEN sec - lag(sec) OVER w > 86400 THEN 1 WHEN lag(sec) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM s)
SELECT user_id, session, count(*) AS n, max(sec) - min(sec) AS seconds, round(sum(value), 2) AS total FROM n GROUP BY ALL
""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = sessions(table(spark, sf_dir, "events").withColumn("at", epoch("ts")), "user_id", F.col("at"), "event_id", 86400)
    return events.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), (F.max("at") - F.min("at")).alias("seconds"), F.round(F.sum("value"), 2).alias("total"))


@query("""
SELECT (floor(epoch(ts) / 3600) * 3600)::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL
""")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return counts.select(F.unix_timestamp("window.start").alias("start"), "event_type", "n", "total")


@query("""
SELECT label, count(*) AS n, round(avg(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)))), 4) AS avg_norm FROM embeddings GROUP BY label
""")
def embedding_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    square = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.sqrt(square)), 4).alias("avg_norm"))
