"""Joins, lookups and matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.catalog.registry import Tables, query
from casewise.functions import extract_first, parse_people
from casewise.operators.frames import concat_metrics, left_join_filtered, rollup_parent
from casewise.operators.lookup import map_codes_join, prefix_lookup
from casewise.operators.people import match_person, nationality_levels_join
from casewise.operators.temporal import asof_join, interval_match


@query("""
SELECT n_name, c_mktsegment, count(*)::BIGINT AS customers, count(o_orderkey)::BIGINT AS big_orders
FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON o_custkey = c_custkey
GROUP BY 1, 2""")
def inner_and_left_join_counts(t: Tables) -> DataFrame:
    big = t.orders.filter(F.col("o_totalprice") > 400000).select("o_custkey", "o_orderkey")
    return (
        t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(big, F.col("o_custkey") == F.col("c_custkey"), "left")
        .groupBy("n_name", "c_mktsegment")
        .agg(F.count("*").alias("customers"), F.count("o_orderkey").alias("big_orders"))
    )


@query("""
SELECT c_custkey, c_mktsegment, o_orderkey FROM customer
LEFT JOIN (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') o
  ON c_custkey = o_custkey AND c_mktsegment = 'MACHINERY'""")
def left_join_with_predicates_in_on(t: Tables) -> DataFrame:
    urgent = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority")
    return left_join_filtered(
        t.customer.select("c_custkey", "c_mktsegment"),
        urgent,
        "c_custkey",
        right_pred=F.col("o_orderpriority") == "1-URGENT",
        left_pred=F.col("c_mktsegment") == "MACHINERY",
    ).select("c_custkey", "c_mktsegment", "o_orderkey")


@query("""
WITH t AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey - o_orderkey % 10 END AS p,
                  o_orderpriority AS kind FROM orders)
SELECT coalesce(a.p, a.k) AS k, CASE WHEN a.p IS NULL THEN a.kind ELSE b.kind END AS kind, count(*)::BIGINT AS n
FROM t a LEFT JOIN t b ON a.p = b.k GROUP BY 1, 2""")
def children_rolled_up_to_parents(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    cases = t.orders.select(
        key.alias("k"), F.when(key % 10 != 0, key - key % 10).alias("p"), F.col("o_orderpriority").alias("kind")
    )
    return rollup_parent(cases, "k", "p", ["kind"]).groupBy("k", "kind").agg(F.count("*").alias("n"))


@query("""
SELECT c_custkey, count(o_orderkey)::BIGINT AS n, round(sum(o_totalprice), 2) AS total
FROM (SELECT *, nullif(regexp_extract(trim(c_name), '[0-9]{4,}'), '')::BIGINT AS found FROM customer)
JOIN orders ON found = o_custkey GROUP BY 1""")
def join_on_key_found_in_text(t: Tables) -> DataFrame:
    named = t.customer.select("c_custkey", extract_first("c_name").cast("bigint").alias("found"))
    return (
        named.join(t.orders, F.col("found") == F.col("o_custkey"))
        .groupBy("c_custkey")
        .agg(F.count("o_orderkey").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    )


@query("""
SELECT o_orderkey, count(l_orderkey)::BIGINT AS n, coalesce(round(sum(l_quantity), 2), 0.0) AS quantity,
       max(l_shipdate)::DATE::VARCHAR AS last_day
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
  AND l_shipdate::DATE BETWEEN o_orderdate::DATE AND o_orderdate::DATE + INTERVAL 90 DAY
GROUP BY 1""")
def shipments_within_90_days(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate", "l_quantity")
    found = interval_match(
        t.orders.select("o_orderkey", "o_orderdate"),
        lines,
        "o_orderkey",
        "o_orderdate",
        "l_shipdate",
        days=90,
        aggs={"n": F.count("*"), "quantity": F.round(F.sum("l_quantity"), 2), "last_day": F.max("l_shipdate")},
    )
    return found.select(
        "o_orderkey",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("quantity", F.lit(0.0)).alias("quantity"),
        F.col("last_day").cast("date").cast("string").alias("last_day"),
    )


@query("""
SELECT o_custkey, first_day::VARCHAR AS first_day, count(l_orderkey)::BIGINT AS n FROM
  (SELECT o_custkey, min(o_orderdate)::DATE AS first_day FROM orders GROUP BY 1) a
LEFT JOIN (SELECT o_custkey AS k, l_orderkey, l_shipdate::DATE AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey) b
  ON k = o_custkey AND d BETWEEN first_day AND first_day + INTERVAL 6 MONTH
GROUP BY 1, 2""")
def shipments_within_six_months(t: Tables) -> DataFrame:
    first = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("first_day"))
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_shipdate")
    found = interval_match(first, lines, "o_custkey", "first_day", "l_shipdate", months=6, aggs={"n": F.count("*")})
    return found.select("o_custkey", F.col("first_day").cast("string").alias("first_day"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""
SELECT a.o_orderkey AS account, d::VARCHAR AS day, count(l_orderkey)::BIGINT AS n, coalesce(round(sum(l_quantity), 2), 0.0) AS quantity
FROM (SELECT row_number() OVER () AS i, o_custkey % 100 AS o_orderkey, date_trunc('month', o_orderdate)::DATE AS d FROM orders) a
LEFT JOIN (SELECT o_custkey % 100 AS k, l_orderkey, l_quantity, l_shipdate::DATE AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_linenumber = 1) b
  ON k = a.o_orderkey AND day BETWEEN d AND d + INTERVAL 30 DAY
GROUP BY i, 1, 2""")
def shipments_after_repeated_months(t: Tables) -> DataFrame:
    account = (F.col("o_custkey") % 100).alias("account")
    months = t.orders.select(account, F.trunc("o_orderdate", "month").alias("day"))
    lines = t.lineitem.where("l_linenumber = 1").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    found = interval_match(
        months, lines.select(account, "l_shipdate", "l_quantity"), "account", "day", "l_shipdate", days=30,
        aggs={"n": F.count("*"), "quantity": F.round(F.sum("l_quantity"), 2)},
    )
    return found.select(
        "account", F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("quantity", F.lit(0.0)).alias("quantity"),
    )


_SPINE = "SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'"
_PAST = "SELECT user_id, ts AS past_ts, event_id AS past_id, event_type AS past_type, value AS past_value FROM events WHERE event_type <> 'purchase'"


def _spine_and_past(t: Tables) -> tuple[DataFrame, DataFrame]:
    bought = F.col("event_type") == "purchase"
    past = t.events.filter(~bought).select(
        "user_id",
        F.col("ts").alias("past_ts"),
        F.col("event_id").alias("past_id"),
        F.col("event_type").alias("past_type"),
        F.col("value").alias("past_value"),
    )
    return t.events.filter(bought).select("user_id", "ts", "event_id"), past


@query(f"""
SELECT s.user_id, s.event_id, p.past_id, p.past_type, p.past_value
FROM ({_SPINE}) s ASOF LEFT JOIN ({_PAST}) p ON s.user_id = p.user_id AND s.ts >= p.past_ts""")
def latest_event_before_purchase(t: Tables) -> DataFrame:
    spine, past = _spine_and_past(t)
    joined = asof_join(spine, past, "user_id", "ts", "past_ts", tie_break=["past_id"])
    return joined.select("user_id", "event_id", "past_id", "past_type", "past_value")


@query(f"""
SELECT s.user_id, s.event_id, CASE WHEN date_diff('day', p.past_ts::DATE, s.ts::DATE) <= 0 THEN p.past_id END AS past_id
FROM ({_SPINE}) s ASOF LEFT JOIN ({_PAST}) p ON s.user_id = p.user_id AND s.ts > p.past_ts""")
def earlier_event_of_the_same_day(t: Tables) -> DataFrame:
    spine, past = _spine_and_past(t)
    joined = asof_join(spine, past, "user_id", "ts", "past_ts", tie_break=["past_id"], max_age_days=0, strict=True)
    return joined.select("user_id", "event_id", "past_id")


@query("""
WITH lookup AS (SELECT s_suppkey::VARCHAR AS code, CASE s_suppkey % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS level
                FROM supplier WHERE s_suppkey >= 3),
     c AS (SELECT c_custkey, c_custkey::VARCHAR AS code FROM customer),
     hits AS (SELECT c_custkey, arg_max(level, length(lookup.code)) AS level FROM c JOIN lookup ON starts_with(c.code, lookup.code) GROUP BY 1)
SELECT c.c_custkey, coalesce(level, 'Low') AS level FROM c LEFT JOIN hits USING (c_custkey)""")
def level_by_longest_prefix(t: Tables) -> DataFrame:
    rest = F.col("s_suppkey") % 3
    lookup = t.supplier.filter(F.col("s_suppkey") >= 3).select(
        F.col("s_suppkey").cast("string").alias("code"),
        F.when(rest == 0, "High").when(rest == 1, "Medium").otherwise("Low").alias("level"),
    )
    codes = t.customer.select("c_custkey", F.col("c_custkey").cast("string").alias("code"))
    return prefix_lookup(codes, "code", lookup, "level").select("c_custkey", "level")


@query("""
WITH lookup AS (SELECT 'NATION_' || r_regionkey AS code, r_name AS category FROM region)
SELECT n_nationkey, coalesce(category, n_name) AS kept, coalesce(category, 'none') AS category
FROM nation LEFT JOIN lookup ON n_name = code""")
def codes_mapped_by_lookup_table(t: Tables) -> DataFrame:
    lookup = t.region.select(
        F.concat(F.lit("NATION_"), F.col("r_regionkey").cast("string")).alias("code"), F.col("r_name").alias("category")
    )
    kept = map_codes_join(t.nation, "n_name", lookup, "kept", keep_input=True)
    return map_codes_join(kept, "n_name", lookup, "category", default="none").select("n_nationkey", "kept", "category")


@query("""
SELECT coalesce(a.k, b.k) AS k, n_orders, n_late FROM
  (SELECT o_custkey % 40 AS k, count(*)::BIGINT AS n_orders FROM orders WHERE o_custkey % 40 < 30 GROUP BY 1) a
FULL JOIN (SELECT o_custkey % 40 AS k, count(*)::BIGINT AS n_late FROM orders WHERE o_custkey % 40 > 10 AND o_orderstatus = 'P' GROUP BY 1) b
  ON a.k = b.k""")
def metrics_aligned_by_group(t: Tables) -> DataFrame:
    k = (F.col("o_custkey") % 40).alias("k")
    first = t.orders.filter(F.col("o_custkey") % 40 < 30).groupBy(k).agg(F.count("*").alias("n_orders"))
    late = t.orders.filter((F.col("o_custkey") % 40 > 10) & (F.col("o_orderstatus") == "P"))
    return concat_metrics([first, late.groupBy(k).agg(F.count("*").alias("n_late"))], "k")


def _people(t: Tables) -> DataFrame:
    """Parts as applicants: names from the part name, officers as a JSON list."""
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    born = F.date_add(F.lit("1960-01-01").cast("date"), (F.col("p_partkey") % 9000).cast("int"))
    other = F.date_add(born, F.when(F.col("p_partkey") % 3 == 0, 400).otherwise(0))

    def officer(ident, given, family, day, nation):
        person = F.struct(
            given.alias("firstName"), family.alias("lastName"), day.cast("string").alias("dateOfBirth"), F.array(nation).alias("nationalities")
        )
        return F.struct(F.lit(ident).alias("officerId"), person.alias("person"))

    tree = F.array(
        officer("a", F.lower("p_type"), F.col("p_brand"), born, F.lit("N0")),
        officer("b", F.replace(first, F.lit("e"), F.lit("a")), F.concat(second, F.lit(" "), F.lower("p_type")), other,
                F.concat(F.lit("N"), (F.col("p_size") % 5).cast("string"))),
        officer("c", F.concat(F.lit("x"), first), F.upper(second), born, F.lit("N4")),
    )
    return t.part.select(
        "p_partkey", first.alias("first"), second.alias("last"), born.alias("born"), F.to_json(tree).alias("directors_tree")
    )


_SCORE = """CASE WHEN {a} = {b} THEN 100 ELSE floor(100 * list_max(list_transform(
  range(1, abs(length({a}) - length({b})) + 2),
  lambda i: 1 - levenshtein(CASE WHEN length({a}) > length({b}) THEN {b} ELSE {a} END,
    substring(CASE WHEN length({a}) > length({b}) THEN {a} ELSE {b} END, i, least(length({a}), length({b}))))
    / least(length({a}), length({b}))::DOUBLE)) + 0.5) END"""


@query(f"""
WITH p AS (SELECT p_partkey, p_size, lower(p_type) AS kind, lower(p_brand) AS brand, split_part(p_name, ' ', 1) AS f,
                  split_part(p_name, ' ', 2) AS l FROM part),
     s AS (SELECT *, {_SCORE.format(a='f', b='kind')} AS fa,
                  {_SCORE.format(a='l', b="(split_part(brand, '#', 2) || ' brand')")} AS la,
                  {_SCORE.format(a='f', b="replace(f, 'e', 'a')")} AS fb,
                  {_SCORE.format(a='f', b="('x' || f)")} AS fc FROM p)
SELECT p_partkey, CASE WHEN fa >= 75 AND la >= 75 THEN 'N0'
                       WHEN p_partkey % 3 <> 0 AND fb >= 75 THEN 'N' || (p_size % 5)
                       WHEN fc >= 75 THEN 'N4' END AS nation
FROM s""")
def applicant_matched_to_officer(t: Tables) -> DataFrame:
    people = _people(t).withColumn("people", parse_people("directors_tree"))
    return people.select("p_partkey", F.get(match_person("people", "first", "last", "born", 75), F.lit(0)).alias("nation"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 5 = 3 THEN 'High' WHEN p_size % 5 = 1 THEN 'Medium' ELSE 'Low' END AS level FROM part""")
def worst_officer_nationality(t: Tables) -> DataFrame:
    people = _people(t).withColumn("people", parse_people("directors_tree"))
    nations = people.withColumn("nations", F.flatten(F.transform("people", lambda p: p["nationalities"])))
    key = F.col("r_regionkey")
    levels = t.region.filter(key != 2).select(
        F.concat(F.lit("N"), key.cast("string")).alias("code"),
        F.when(key == 3, "High").when(key == 1, "Medium").otherwise("Low").alias("level"),
    )
    return nationality_levels_join(nations, "nations", levels, "level").select("p_partkey", "level")
