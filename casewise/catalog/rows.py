"""Reading, projecting, filtering and filling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.catalog.registry import Tables, query, r6
from casewise.functions import case_label, clip, cohort_filter, in_codes, is_not_value, within_days
from casewise.operators.frames import coerce, drop_missing, fill_median, unpivot_refs
from casewise.operators.temporal import time_split
from casewise.sources import normalize_columns, read_query, read_range


@query("""
SELECT o_orderstatus AS status, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total
FROM orders WHERE o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1997-03-31' GROUP BY 1""")
def parametrised_status_totals(t: Tables) -> DataFrame:
    return read_query(
        t.spark,
        """SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total
           FROM {orders} WHERE o_orderdate BETWEEN CAST(:from_date AS DATE) AND CAST(:to_date AS DATE)
           GROUP BY 1""",
        {"from_date": "1996-01-01", "to_date": "1997-03-31"},
        {"orders": t.orders},
    )


@query("SELECT n_nationkey AS nationkey, n_name AS name, n_regionkey AS regionkey FROM nation")
def normalized_column_names(t: Tables) -> DataFrame:
    wide = t.nation.toDF("DB__N__NationKey", "DB__N__NAME", "DB__N__RegionKey")
    return normalize_columns(wide, "__")


@query("""
SELECT event_type, count(*)::BIGINT AS n FROM events
WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' GROUP BY 1""")
def events_in_time_range(t: Tables) -> DataFrame:
    from datetime import datetime

    week = read_range(t.events, "ts", datetime(2024, 1, 8), datetime(2024, 1, 15))
    return week.groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def distinct_status_priority(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).distinct()


_SHIPPED = """
SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_shipdate::DATE AS shipped, o_orderdate::DATE AS ordered, o_orderstatus
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def _shipped(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))


@query(f"""
WITH s AS ({_SHIPPED})
SELECT l_orderkey, l_linenumber, l_returnflag,
  CASE WHEN l_returnflag = 'R' AND o_orderstatus = 'F' THEN 'returned_final'
       WHEN l_returnflag = 'R' THEN 'returned_open'
       WHEN o_orderstatus = 'O' AND l_linestatus = 'F' THEN 'kept_filled'
       ELSE o_orderstatus END AS outcome,
  (CASE WHEN date_diff('day', ordered, shipped) <= 90 THEN 1 ELSE 0 END)::INT AS is_early,
  (CASE WHEN date_diff('day', ordered, shipped) <= 90 THEN 1 ELSE 0 END
     * CASE WHEN shipped BETWEEN ordered AND ordered + INTERVAL 90 DAY THEN 1 ELSE 0 END)::INT AS is_in_window
FROM s""")
def labelled_shipments(t: Tables) -> DataFrame:
    early = within_days("o_orderdate", "l_shipdate", 90)
    shipped, ordered = F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")
    returned = F.col("l_returnflag") == "R"
    return _shipped(t).select(
        "l_orderkey",
        "l_linenumber",
        "l_returnflag",
        case_label(
            [
                (returned & (F.col("o_orderstatus") == "F"), "returned_final"),
                (returned, "returned_open"),
                ((F.col("o_orderstatus") == "O") & (F.col("l_linestatus") == "F"), "kept_filled"),
            ],
            F.col("o_orderstatus"),
        ).alias("outcome"),
        early.alias("is_early"),
        (early * F.when(shipped.between(ordered, F.date_add(ordered, 90)), 1).otherwise(0)).alias("is_in_window"),
    )


@query("""
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM
  (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS maybe FROM orders)
WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus NOT IN ('P')
  AND (maybe IS NULL OR maybe <> 'F') AND NOT (o_orderpriority = '5-LOW' AND maybe = 'O')
  AND o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""")
def three_valued_filters(t: Tables) -> DataFrame:
    maybe = t.orders.withColumn("maybe", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")))
    day = F.col("o_orderdate").cast("date")
    return maybe.filter(
        in_codes("o_orderpriority", ["1-URGENT", "5-LOW"])
        & ~in_codes("o_orderstatus", ["P"])
        & is_not_value("maybe", "F")
        & ~((F.col("o_orderpriority") == "5-LOW") & (F.col("maybe") == "O"))
        & day.between(F.lit("1996-01-01").cast("date"), F.lit("1999-12-31").cast("date"))
    ).select("o_orderkey", "o_orderstatus", "o_orderpriority")


_FIRST_ORDER = """
SELECT o_custkey, min(o_orderdate)::DATE AS created,
       min(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END)::DATE AS approved
FROM orders GROUP BY 1"""


def _first_order(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(
        F.min("o_orderdate").cast("date").alias("created"),
        F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).cast("date").alias("approved"),
    )


@query(f"""
WITH f AS ({_FIRST_ORDER})
SELECT o_custkey, created::VARCHAR AS created, approved::VARCHAR AS approved FROM f
WHERE coalesce(approved, created) <= DATE '1996-03-31'
  AND (created BETWEEN DATE '1995-04-01' AND DATE '1996-03-31'
       OR (approved BETWEEN DATE '1995-04-01' AND DATE '1996-03-31'
           AND approved BETWEEN created AND created + INTERVAL 3 MONTH))""")
def cohort_of_first_orders(t: Tables) -> DataFrame:
    return _first_order(t).filter(cohort_filter("created", "approved", "1995-04-01", "1996-03-31", 3)).select(
        "o_custkey", F.col("created").cast("string").alias("created"), F.col("approved").cast("string").alias("approved")
    )


@query("""
SELECT p_partkey, TRY_CAST(regexp_replace(p_brand, '^Brand#', '') AS INT) AS brand_number,
       TRY_CAST(p_type AS DOUBLE) AS not_a_number, p_retailprice::DECIMAL(12, 2)::DOUBLE AS price
FROM part""")
def coerced_types(t: Tables) -> DataFrame:
    text = t.part.select(
        "p_partkey",
        F.regexp_replace("p_brand", "^Brand#", "").alias("brand_number"),
        F.col("p_type").alias("not_a_number"),
        F.col("p_retailprice").cast("decimal(12,2)").cast("string").alias("price"),
    )
    return coerce(text, {"brand_number": "int", "not_a_number": "double", "price": "double"})


_LABELLED = """
SELECT d.doc_id, d.n_chars, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


@query(f"""
SELECT 'complete' AS part, count(*)::BIGINT AS n, sum(quality)::BIGINT AS quality FROM ({_LABELLED})
WHERE quality IS NOT NULL AND toxic IS NOT NULL AND n_chars IS NOT NULL AND lang IS NOT NULL
UNION ALL SELECT 'filled', count(*)::BIGINT, sum(coalesce(quality, 0))::BIGINT FROM ({_LABELLED})""")
def dropped_and_filled_rows(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "n_chars", "lang").join(t.labels, "doc_id", "left")

    def totals(df: DataFrame, part: str) -> DataFrame:
        return df.agg(F.lit(part).alias("part"), F.count("*").alias("n"), F.sum("quality").alias("quality"))

    return totals(drop_missing(joined), "complete").unionByName(totals(joined.na.fill({"quality": 0}), "filled"))


@query(f"""
WITH j AS (SELECT doc_id, CASE WHEN quality IS NULL THEN NULL ELSE least(greatest(n_chars / 100.0, 2), 30) END AS x
           FROM ({_LABELLED})),
     m AS (SELECT median(x) AS med FROM j)
SELECT doc_id, round(coalesce(x, med), 6) AS x FROM j, m""")
def clipped_then_median_filled(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left")
    clipped = joined.select(
        "doc_id", clip(F.when(F.col("quality").isNotNull(), F.col("n_chars") / 100.0), 2.0, 30.0).alias("x")
    )
    return fill_median(clipped, ["x"]).select("doc_id", r6("x").alias("x"))


@query("""
SELECT CASE WHEN o_orderdate::DATE <= DATE '2000-12-31' - INTERVAL 90 DAY THEN 'train' ELSE 'test' END AS part,
       count(*)::BIGINT AS n, min(o_orderdate)::DATE::VARCHAR AS first_day, max(o_orderdate)::DATE::VARCHAR AS last_day
FROM orders GROUP BY 1""")
def train_and_test_bounds(t: Tables) -> DataFrame:
    train, test = time_split(t.orders, "o_orderdate", "2000-12-31", 90)

    def bounds(df: DataFrame, part: str) -> DataFrame:
        return df.agg(
            F.lit(part).alias("part"),
            F.count("*").alias("n"),
            F.min("o_orderdate").cast("date").cast("string").alias("first_day"),
            F.max("o_orderdate").cast("date").cast("string").alias("last_day"),
        )

    return bounds(train, "train").unionByName(bounds(test, "test"))


@query("""
SELECT DISTINCT l_orderkey, regexp_replace(ref, '[\\s,"\\]]', '', 'g') AS ref FROM (
  SELECT l_orderkey, ' "' || l_partkey || '",' AS ref FROM lineitem
  UNION SELECT l_orderkey, l_suppkey::VARCHAR FROM lineitem
  UNION SELECT l_orderkey, l_linenumber || ' ]' FROM lineitem WHERE l_returnflag <> 'N') x""")
def unpivoted_references(t: Tables) -> DataFrame:
    wide = t.lineitem.select(
        "l_orderkey",
        F.concat(F.lit(' "'), F.col("l_partkey").cast("string"), F.lit('",')).alias("ref_1"),
        F.col("l_suppkey").cast("string").alias("ref_2"),
        F.when(F.col("l_returnflag") != "N", F.concat(F.col("l_linenumber").cast("string"), F.lit(" ]"))).alias("ref_3"),
    )
    return unpivot_refs(wide, "l_orderkey", ["ref_1", "ref_2", "ref_3"]).distinct()
