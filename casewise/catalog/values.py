"""Text, JSON, levels and bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.catalog.registry import Tables, query
from casewise.functions import (
    band,
    count_band,
    email_domain,
    extract_first,
    json_get,
    map_array,
    map_codes,
    mean_age,
    outward_code,
    parse_people,
    strip_chars,
    unwrap_cells,
    worst_in_array,
    worst_level,
)


@query("""
SELECT p_partkey, nullif(regexp_extract(trim(' ' || p_brand || ' ' || p_partkey || ' '), '[0-9]{3,}'), '') AS digits,
  regexp_replace('["' || p_name || '", ' || p_size || ']', '[\\s,"\\]]', '', 'g') AS packed,
  upper(p_name) AS loud, split_part(p_name, ' ', -1) AS last_word, (starts_with(p_name, 'small') OR contains(p_name, 'bolt'))::INT AS hit
FROM part""")
def cleaned_part_texts(t: Tables) -> DataFrame:
    name = F.col("p_name")
    return t.part.select(
        "p_partkey",
        extract_first(F.concat_ws(" ", F.lit(""), "p_brand", F.col("p_partkey").cast("string")), "[0-9]{3,}").alias("digits"),
        strip_chars(F.concat(F.lit('["'), name, F.lit('", '), F.col("p_size").cast("string"), F.lit("]"))).alias("packed"),
        F.upper(name).alias("loud"),
        F.element_at(F.split(name, " "), -1).alias("last_word"),
        (name.startswith("small") | name.contains("bolt")).cast("int").alias("hit"),
    )


@query("""
WITH e AS (SELECT c_custkey, c_name || '@x#' || lower(c_mktsegment) || '.com' AS email FROM customer)
SELECT CASE WHEN d IN ('building.com', 'machinery.com') THEN d ELSE 'other' END AS domain, count(*)::BIGINT AS n
FROM (SELECT split_part(split_part(email, '@', -1), '#', -1) AS d FROM e) GROUP BY 1""")
def email_domains(t: Tables) -> DataFrame:
    email = F.concat("c_name", F.lit("@x#"), F.lower("c_mktsegment"), F.lit(".com"))
    domain = email_domain(email, ["building.com", "machinery.com"])
    return t.customer.groupBy(domain.alias("domain")).agg(F.count("*").alias("n"))


@query("""
SELECT event_id, TRY_CAST(props ->> '$.k' AS INT) AS k, CASE WHEN event_id % 5 <> 0 THEN TRY_CAST(props ->> '$.k' AS DOUBLE) END AS maybe,
  NULL::VARCHAR AS absent FROM events""")
def json_paths(t: Tables) -> DataFrame:
    broken = F.when(F.col("event_id") % 5 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    return t.events.select(
        "event_id",
        json_get("props", "$.k", "int").alias("k"),
        json_get(broken, "$.k", "double").alias("maybe"),
        json_get("props", "$.a.b").alias("absent"),
    )


@query("""
SELECT event_id, event_type AS kind_value, CASE WHEN event_type = 'error' THEN 'failed' END AS kind_error,
  (value * 2)::VARCHAR AS amount_value, NULL::VARCHAR AS amount_error FROM events""")
def unwrapped_feature_cells(t: Tables) -> DataFrame:
    def cell(value, error):
        output = F.struct(value.alias("value"), error.alias("error"))
        return F.to_json(F.struct(F.struct(F.lit(1).alias("raw")).alias("input"), output.alias("output")))

    cells = t.events.select(
        "event_id",
        cell(F.col("event_type"), F.when(F.col("event_type") == "error", "failed")).alias("kind"),
        cell((F.col("value") * 2).cast("string"), F.lit(None).cast("string")).alias("amount"),
    )
    return unwrap_cells(cells, ["kind", "amount"], ["value", "error"])


@query("""
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE 2 END AS officers,
  trunc(date_diff('day', date_trunc('month', DATE '1950-01-01' + (p_partkey % 9000)::INT)::DATE, DATE '2020-06-15') / 365.2425)::INT AS first_age,
  CASE WHEN p_size % 4 = 0 THEN NULL ELSE 'Last' END AS first_family
FROM part""")
def parsed_officer_lists(t: Tables) -> DataFrame:
    born = F.date_add(F.lit("1950-01-01").cast("date"), (F.col("p_partkey") % 9000).cast("int"))

    def officer(ident, family, day):
        person = F.struct(F.lit("A").alias("firstName"), F.lit(family).alias("lastName"), day.cast("string").alias("dateOfBirth"))
        return F.struct(F.lit(ident).alias("officerId"), person.alias("person"))

    spare = F.when(F.col("p_size") % 4 != 0, F.lit("1970-05-05").cast("date"))
    # The first id repeats: its last entry wins and keeps the first place.
    tree = F.array(officer("a", "early", spare), officer("b", "other", F.lit("1980-01-31").cast("date")), officer("a", "last", born))
    people = t.part.select("p_partkey", born.alias("born"), parse_people(F.to_json(tree)).alias("people"))
    return people.select(
        "p_partkey",
        F.size("people").alias("officers"),
        mean_age("people", F.lit("2020-06-15"), F.trunc("born", "month"), first_only=True).alias("first_age"),
        F.initcap(F.get("people", F.lit(0)).getField("last")).alias("first_family"),
    )


@query("""
SELECT c_custkey,
  CASE WHEN x IS NULL THEN 'Undefined' WHEN x <= 1 THEN '< 1M' WHEN x < 6 THEN '< 6M' WHEN x < 12 THEN '< 12M' ELSE '>= 12M' END AS age_band,
  CASE WHEN n >= 3 THEN '3+' WHEN n IN (1, 2) THEN n::VARCHAR ELSE 'Undefined' END AS n_band
FROM (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE floor(c_acctbal / 500) END AS x,
             CASE WHEN c_custkey % 6 = 5 THEN NULL ELSE c_custkey % 6 END AS n FROM customer)""")
def value_bands(t: Tables) -> DataFrame:
    x = F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") / 500))
    n = F.when(F.col("c_custkey") % 6 != 5, F.col("c_custkey") % 6)
    return t.customer.select(
        "c_custkey",
        band(x, [(1, True, "< 1M"), (6, False, "< 6M"), (12, False, "< 12M")], ">= 12M").alias("age_band"),
        count_band(n).alias("n_band"),
    )


@query("""
SELECT c_custkey, CASE WHEN length(outward) BETWEEN 2 AND 4 THEN outward END AS code, (length(outward) BETWEEN 2 AND 4)::INT AS valid
FROM (SELECT c_custkey, CASE WHEN length(s) <= 4 THEN s WHEN length(replace(s, ' ', '')) > 3
        THEN left(replace(s, ' ', ''), length(replace(s, ' ', '')) - 3) ELSE '' END AS outward
  FROM (SELECT c_custkey, trim(left(c_mktsegment, (c_custkey % 4)::INT) || repeat(' ', (c_custkey % 3)::INT) || (c_custkey % 5000)) AS s FROM customer))""")
def outward_codes(t: Tables) -> DataFrame:
    raw = F.concat(
        F.substring("c_mktsegment", F.lit(1), (F.col("c_custkey") % 4).cast("int")),
        F.repeat(F.lit(" "), (F.col("c_custkey") % 3).cast("int")),
        (F.col("c_custkey") % 5000).cast("string"),
    )
    code = outward_code(raw)
    return t.customer.select(
        "c_custkey", code.getField("value").alias("code"), code.getField("error").isNull().cast("int").alias("valid")
    )


@query("""
SELECT o_orderkey,
  CASE WHEN o_orderpriority = '1-URGENT' OR o_orderstatus = 'P' THEN 'High' WHEN o_orderpriority = '2-HIGH' OR o_orderstatus = 'O' THEN 'Medium'
       WHEN o_orderpriority = '3-MEDIUM' THEN 'Low' ELSE 'Undefined' END AS worst,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'High' WHEN o_orderpriority = '2-HIGH' THEN 'Medium' WHEN o_orderpriority = '3-MEDIUM' THEN 'Low'
       ELSE 'Undefined' END AS worst_listed,
  CASE o_orderstatus WHEN 'P' THEN 'High' WHEN 'O' THEN 'Medium' ELSE 'none' END AS by_status FROM orders""")
def worst_levels(t: Tables) -> DataFrame:
    by_priority = {"1-URGENT": "High", "2-HIGH": "Medium", "3-MEDIUM": "Low"}
    by_status = {"P": "High", "O": "Medium"}
    listed = map_array(F.array(F.col("o_orderpriority"), F.lit("?")), by_priority)
    return t.orders.select(
        "o_orderkey",
        worst_level(map_codes("o_orderpriority", by_priority), map_codes("o_orderstatus", by_status)).alias("worst"),
        worst_in_array(listed).alias("worst_listed"),
        map_codes("o_orderstatus", by_status, "none").alias("by_status"),
    )
