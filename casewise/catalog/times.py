"""First and latest rows, ranks, bins and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.catalog.registry import Tables, query, r6
from casewise.functions import (
    days_between,
    mean_months,
    mean_years,
    month_diff,
    month_key,
    year_boundaries,
)
from casewise.operators.frames import top_n
from casewise.operators.ordered import quantile_bins, rank_column
from casewise.operators.temporal import dedupe, first_per_key, latest_per_key


@query("""
SELECT o_custkey, o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM
  (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS FIRST) AS rnk FROM orders) WHERE rnk = 1""")
def latest_orders_with_ties(t: Tables) -> DataFrame:
    return latest_per_key(t.orders, "o_custkey", "o_orderdate").select(
        "o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("day")
    )


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderdate END AS moment FROM orders)
SELECT o_custkey, o_orderkey, moment::DATE::VARCHAR AS day, which FROM
  (SELECT *, 'latest' AS which, rank() OVER (PARTITION BY o_custkey ORDER BY moment DESC NULLS FIRST) AS rnk FROM o
   UNION ALL SELECT *, 'first', rank() OVER (PARTITION BY o_custkey ORDER BY moment ASC NULLS LAST) FROM o) WHERE rnk = 1""")
def first_and_latest_with_missing_dates(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate")).alias("at"))
    both = latest_per_key(rows, "o_custkey", "at").withColumn("which", F.lit("latest")).unionByName(
        first_per_key(rows, "o_custkey", "at").withColumn("which", F.lit("first"))
    )
    return both.select("o_custkey", "o_orderkey", F.col("at").cast("date").cast("string").alias("day"), "which")


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) = 1""")
def first_shipment_per_order(t: Tables) -> DataFrame:
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]
    return dedupe(t.lineitem, "l_orderkey", order).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("""
WITH e AS (SELECT quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8]) AS q FROM lineitem)
SELECT bin::INT AS bin, count(*)::BIGINT AS n, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM
  (SELECT l_extendedprice, (l_extendedprice > q[1])::INT + (l_extendedprice > q[2])::INT + (l_extendedprice > q[3])::INT
    + (l_extendedprice > q[4])::INT AS bin FROM lineitem, e) GROUP BY 1""")
def equal_frequency_price_bins(t: Tables) -> DataFrame:
    return (
        quantile_bins(t.lineitem, "l_extendedprice", 5)
        .groupBy("bin")
        .agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"))
    )


@query("""
WITH e AS (SELECT list_distinct(quantile_cont(x, [0.2, 0.4, 0.6, 0.8])) AS q, min(x) AS lo FROM
  (SELECT CASE WHEN l_discount < 0.05 THEN 0.0 ELSE l_discount END AS x FROM lineitem))
SELECT bin::INT AS bin, count(*)::BIGINT AS n FROM
  (SELECT len(list_filter(q, lambda v: v > lo AND x > v)) AS bin
   FROM (SELECT CASE WHEN l_discount < 0.05 THEN 0.0 ELSE l_discount END AS x FROM lineitem), e) GROUP BY 1""")
def tied_values_share_a_bin(t: Tables) -> DataFrame:
    x = F.when(F.col("l_discount") < 0.05, 0.0).otherwise(F.col("l_discount"))
    return quantile_bins(t.lineitem.select(x.alias("x")), "x", 5).groupBy("bin").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, (rank() OVER (ORDER BY day) + (count(*) OVER (PARTITION BY day) - 1) / 2.0)::DOUBLE AS rank
FROM (SELECT o_orderkey, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS day FROM orders)""")
def mean_rank_of_order_dates(t: Tables) -> DataFrame:
    day = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).alias("day")
    return rank_column(t.orders.select("o_orderkey", day), "day").select("o_orderkey", "rank")


@query("""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25""")
def largest_orders(t: Tables) -> DataFrame:
    return top_n(t.orders, "o_totalprice", 25, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("""
SELECT o_custkey, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) <= 3""")
def three_largest_orders_per_customer(t: Tables) -> DataFrame:
    best = top_n(t.orders, "o_totalprice", 3, ["o_orderkey"], ["o_custkey"])
    return best.select("o_custkey", "o_orderkey", "o_totalprice")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::INT AS days,
  (year(l_shipdate) - year(o_orderdate))::INT AS years_crossed,
  ((year(l_shipdate) - year(o_orderdate)) * 12 + month(l_shipdate) - month(o_orderdate))::INT AS months,
  round(date_diff('day', o_orderdate::DATE, l_shipdate::DATE) / 30.436875, 6) AS mean_months,
  trunc(date_diff('day', o_orderdate::DATE, l_shipdate::DATE) / 365.2425)::INT AS whole_years,
  strftime(o_orderdate, '%Y-%m') AS month, date_trunc('month', l_shipdate)::DATE::VARCHAR AS month_start
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= DATE '1996-01-01'""")
def date_arithmetic(t: Tables) -> DataFrame:
    lines = t.lineitem.filter(F.col("l_shipdate") >= F.lit("1996-01-01").cast("date"))
    joined = lines.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        days_between("o_orderdate", "l_shipdate").alias("days"),
        year_boundaries("o_orderdate", "l_shipdate").alias("years_crossed"),
        month_diff("l_shipdate", "o_orderdate").alias("months"),
        r6(mean_months("o_orderdate", "l_shipdate")).alias("mean_months"),
        mean_years("o_orderdate", "l_shipdate").cast("int").alias("whole_years"),
        month_key("o_orderdate").alias("month"),
        F.date_trunc("month", "l_shipdate").cast("date").cast("string").alias("month_start"),
    )
