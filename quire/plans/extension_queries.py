"""Extensions: relational and event queries that the reference has no counterpart of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.tables import table
from quire.streaming import events


def ext_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    line = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return line.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum(price), 2).alias("price"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("n"))


PRICING_SQL = """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS price, round(avg(l_discount), 6) AS discount, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"""


def ext_segment_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.cube("n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


CUBE_SQL = "SELECT n_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_name, c_mktsegment)"


def ext_top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest orders of each customer: the limit is the report."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(w).alias("rank")).where("rank <= 3")


TOP_SQL = "SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3"


def ext_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.windowed_counts(table(spark, sf_dir, "events"))


WINDOWS_SQL = "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def ext_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.sessions(table(spark, sf_dir, "events"))


SESSIONS_SQL = """WITH l AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS stop, count(*) AS n FROM s GROUP BY user_id, s"""

QUERIES = {"ext_pricing_summary": ext_pricing_summary, "ext_segment_cube": ext_segment_cube, "ext_top_orders": ext_top_orders, "ext_windowed_counts": ext_windowed_counts, "ext_sessions": ext_sessions}
ORACLE_SQL = {"ext_pricing_summary": PRICING_SQL, "ext_segment_cube": CUBE_SQL, "ext_top_orders": TOP_SQL, "ext_windowed_counts": WINDOWS_SQL, "ext_sessions": SESSIONS_SQL}
