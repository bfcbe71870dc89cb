"""Counts, shares, trends and descriptive summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.catalog.registry import Tables, query, r6
from casewise.functions import log_loss_pos, row_max, row_min, row_sum, sigmoid
from casewise.operators.clusters import group_extremes, top_drivers
from casewise.operators.frames import (
    describe,
    duplicate_count,
    group_stats,
    monthly_trend,
    null_rates,
    share_of_total,
    value_share,
)
from casewise.operators.ordered import exact_quantiles

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("""
SELECT o_custkey, min(o_orderdate)::DATE::VARCHAR AS first_day, max(o_orderdate)::DATE::VARCHAR AS last_day,
  round(sum(o_totalprice), 2) AS total,
  max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::INT AS any_pending,
  round(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice ELSE 0 END), 2) AS urgent
FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 2000000""")
def conditional_totals_of_large_customers(t: Tables) -> DataFrame:
    return (
        t.orders.groupBy("o_custkey")
        .agg(
            F.min("o_orderdate").cast("date").cast("string").alias("first_day"),
            F.max("o_orderdate").cast("date").cast("string").alias("last_day"),
            F.round(F.sum("o_totalprice"), 2).alias("total"),
            F.max(F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).alias("any_pending"),
            F.round(F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice")).otherwise(0)), 2).alias("urgent"),
            F.sum("o_totalprice").alias("_sum"),
        )
        .filter(F.col("_sum") > 2_000_000)
        .drop("_sum")
    )


@query("""
SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(avg(l_quantity), 6) AS quantity, round(avg(l_discount), 6) AS discount
FROM lineitem GROUP BY 1, 2""")
def group_counts_and_means(t: Tables) -> DataFrame:
    stats = group_stats(t.lineitem, ["l_returnflag", "l_linestatus"], ["l_quantity", "l_discount"], ["avg"])
    return stats.select(
        "l_returnflag", "l_linestatus", "n", r6("l_quantity_avg").alias("quantity"), r6("l_discount_avg").alias("discount")
    )


@query("""
SELECT o_orderpriority AS value, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def priority_share_of_final_orders(t: Tables) -> DataFrame:
    shares = value_share(t.orders, "o_orderpriority", F.col("o_orderstatus") == "F")
    return shares.select("value", "n", r6("share").alias("share"))


@query("""
SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total, round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (), 6) AS share
FROM orders GROUP BY 1""")
def revenue_share_by_priority(t: Tables) -> DataFrame:
    shares = share_of_total(t.orders, "o_orderpriority", "o_totalprice")
    return shares.select("o_orderpriority", F.round("sum_o_totalprice", 2).alias("total"), r6("share").alias("share"))


@query("""
SELECT strftime(o_orderdate, '%Y-%m') AS month,
  round(avg(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN (o_orderstatus = 'P')::INT END), 6) AS pending_rate,
  round(sum((o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')::INT) / nullif(sum((o_orderstatus = 'P')::INT), 0)::DOUBLE, 6) AS urgent_part
FROM orders GROUP BY 1""")
def monthly_pending_trend(t: Tables) -> DataFrame:
    pending = (F.col("o_orderstatus") == "P").cast("int")
    hasty = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", pending).otherwise(0)
    trend = monthly_trend(
        t.orders,
        "o_orderdate",
        {"pending_rate": F.avg(F.when(hasty, pending)), "urgent_part": F.try_divide(F.sum(urgent), F.sum(pending))},
    )
    return trend.select("month", r6("pending_rate").alias("pending_rate"), r6("urgent_part").alias("urgent_part"))


def _describe_sql(col: str) -> str:
    return f"""SELECT '{col}' AS feature, count({col})::BIGINT AS n, round(avg({col}), 6) AS mean, round(stddev_samp({col}), 6) AS std,
  min({col})::DOUBLE AS least, round(quantile_cont({col}, 0.25), 6) AS q25, round(quantile_cont({col}, 0.5), 6) AS q50,
  round(quantile_cont({col}, 0.75), 6) AS q75, max({col})::DOUBLE AS most FROM lineitem"""


@query("\nUNION ALL ".join(_describe_sql(c) for c in NUMBERS))
def described_columns(t: Tables) -> DataFrame:
    table = describe(t.lineitem, NUMBERS)

    def point(p: float):
        return r6(F.element_at("percentiles", F.lit(p)))

    return table.select(
        "feature",
        "n",
        r6("mean").alias("mean"),
        r6("std").alias("std"),
        F.col("min").alias("least"),
        point(0.25).alias("q25"),
        point(0.5).alias("q50"),
        point(0.75).alias("q75"),
        F.col("max").alias("most"),
    )


_HUNDREDTHS = ", ".join(str(i / 100) for i in range(101))


@query(f"""
SELECT p::INT AS percent, round(q[p + 1], 4) AS price
FROM (SELECT quantile_cont(o_totalprice, [{_HUNDREDTHS}]) AS q FROM orders), range(0, 101) r(p)""")
def price_percentiles(t: Tables) -> DataFrame:
    points = exact_quantiles(t.orders, ["o_totalprice"], [i / 100 for i in range(101)])
    return points.select(F.round(F.col("prob") * 100).cast("int").alias("percent"), F.round("quantile", 4).alias("price"))


@query("""
SELECT unnest(['doc_id', 'quality', 'toxic']) AS feature,
       unnest([round(avg((d.doc_id IS NULL)::INT), 6), round(avg((quality IS NULL)::INT), 6), round(avg((toxic IS NULL)::INT), 6)]) AS null_rate
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def missing_rates(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return null_rates(joined, ["doc_id", "quality", "toxic"]).select("feature", r6("null_rate").alias("null_rate"))


@query("""
SELECT count(*)::BIGINT AS rows, (count(DISTINCT k) + max((k IS NULL)::INT))::BIGINT AS keys,
       (count(*) - count(DISTINCT k) - max((k IS NULL)::INT))::BIGINT AS duplicates
FROM (SELECT CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END AS k FROM orders)""")
def duplicate_customer_keys(t: Tables) -> DataFrame:
    return duplicate_count(t.orders.select(F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("k")), "k")


@query("""
WITH g AS (SELECT l_returnflag AS grp, avg(l_quantity) AS a, avg(l_extendedprice) AS b, avg(l_tax) AS c, avg(l_discount) AS d
           FROM lineitem GROUP BY 1),
 o AS (SELECT avg(l_quantity) AS a, avg(l_extendedprice) AS b, avg(l_tax) AS c, avg(l_discount) AS d FROM lineitem),
 r AS (SELECT grp, 0 AS place, 'l_quantity' AS feature, round_even(g.a / o.a, 2) AS ratio FROM g, o
       UNION ALL SELECT grp, 1, 'l_extendedprice', round_even(g.b / o.b, 2) FROM g, o
       UNION ALL SELECT grp, 2, 'l_tax', round_even(g.c / o.c, 2) FROM g, o
       UNION ALL SELECT grp, 3, 'l_discount', round_even(g.d / o.d, 2) FROM g, o)
SELECT grp AS l_returnflag, row_number() OVER (PARTITION BY grp ORDER BY ratio DESC, place)::INT AS rank, feature, ratio::DOUBLE AS ratio
FROM r QUALIFY rank <= 3""")
def top_drivers_by_return_flag(t: Tables) -> DataFrame:
    drivers = top_drivers(t.lineitem, "l_returnflag", ["l_quantity", "l_extendedprice", "l_tax", "l_discount"])
    return drivers.select("l_returnflag", "rank", "feature", (F.col("ratio") + F.lit(0.0)).alias("ratio"))


@query("""
SELECT min(n)::BIGINT AS least, max(n)::BIGINT AS most FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)""")
def smallest_and_largest_nation(t: Tables) -> DataFrame:
    return group_extremes(t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n")), "n")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, greatest(l_discount, l_tax) AS most, least(l_discount, l_tax) AS least,
  round(coalesce(CASE WHEN l_returnflag = 'R' THEN l_discount END, 0) + l_tax, 6) AS total,
  round_even(l_quantity / 2, 0)::DOUBLE AS half, round(1 / (1 + exp(-(l_quantity - 25) / 5)), 6) AS p FROM lineitem""")
def row_arithmetic(t: Tables) -> DataFrame:
    some = F.when(F.col("l_returnflag") == "R", F.col("l_discount"))
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        row_max("l_discount", "l_tax").alias("most"),
        row_min("l_discount", "l_tax").alias("least"),
        r6(row_sum(some, "l_tax")).alias("total"),
        F.bround(F.col("l_quantity") / 2, 0).alias("half"),
        r6(sigmoid((F.col("l_quantity") - 25) / 5)).alias("p"),
    )


@query("""
SELECT l_linestatus, round(-sum((l_returnflag = 'R')::INT * ln(least(greatest(p, 1e-10), 1 - 1e-10))), 4) AS loss
FROM (SELECT *, 1 / (1 + exp(-(l_quantity - 25) / 5)) AS p FROM lineitem) GROUP BY 1""")
def positive_class_log_loss(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("y"), sigmoid((F.col("l_quantity") - 25) / 5).alias("p")
    )
    return rows.groupBy("l_linestatus").agg(F.round(log_loss_pos("y", "p"), 4).alias("loss"))
