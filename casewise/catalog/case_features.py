"""Features of the stand-in cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.catalog import standins as s
from casewise.catalog.registry import Tables, query
from casewise.functions import outward_code
from casewise.plans.features import (
    applicants,
    application_rules,
    clean_expiry,
    combine_levels,
    document_features,
    feature_set,
    graded_people,
    people_enrich,
    postcode_level,
    registry_enrich,
)

LO, HI = s.LO, s.HI

_DOCUMENTS = f"""{s.ctes('entities', 'members', 'id_scans', 'users')},
cohort AS (SELECT entity_id, member_id, e.created_at, rank() OVER (PARTITION BY entity_id ORDER BY e.created_at DESC) AS rnk
  FROM entities e JOIN members m USING (member_id) WHERE is_completed = 1 AND coalesce(approved_at, e.created_at) <= DATE '{HI}'
   AND (e.created_at BETWEEN DATE '{LO}' AND DATE '{HI}' OR (approved_at BETWEEN DATE '{LO}' AND DATE '{HI}'
        AND approved_at BETWEEN e.created_at AND e.created_at + INTERVAL 3 MONTH))),
scans AS (SELECT *, rank() OVER (PARTITION BY member_id ORDER BY created_at DESC) AS rnk FROM id_scans
  WHERE verification_type IN ('ID_SCAN', 'ID_SCAN_VALIDATIONS') AND verification_usage IN ('REGISTRATION', 'ACCOUNT_RECOVERY')),
births AS (SELECT *, rank() OVER (PARTITION BY member_id ORDER BY created_at) AS rnk FROM users),
documents_ AS (SELECT DISTINCT c.entity_id, c.created_at, id_expiry_at, id_first_name, id_last_name, date_of_birth,
  year(id_expiry_at) - year(c.created_at) AS years_to_id_expiry
  FROM cohort c LEFT JOIN scans a ON c.member_id = a.member_id AND c.rnk = 1 AND a.rnk = 1 LEFT JOIN births b ON c.member_id = b.member_id AND b.rnk = 1)"""


def documents(t: Tables) -> DataFrame:
    return document_features(s.entities(t), s.members(t), s.id_scans(t), s.users(t), LO, HI)


@query(f"""
WITH {_DOCUMENTS}
SELECT entity_id, id_first_name, id_last_name, date_of_birth::VARCHAR AS born, id_expiry_at::VARCHAR AS expires, years_to_id_expiry::INT AS years FROM documents_""")
def identity_documents(t: Tables) -> DataFrame:
    return documents(t).select(
        "entity_id",
        "id_first_name",
        "id_last_name",
        F.col("date_of_birth").cast("string").alias("born"),
        F.col("id_expiry_at").cast("string").alias("expires"),
        F.col("years_to_id_expiry").alias("years"),
    )


@query(f"""
WITH {_DOCUMENTS}, c AS (SELECT entity_id, CASE WHEN years_to_id_expiry IS NOT NULL THEN least(greatest(years_to_id_expiry, 0), 10) END AS y FROM documents_)
SELECT entity_id, coalesce(y, (SELECT median(y) FROM c))::DOUBLE AS years FROM c""")
def cleaned_years_to_expiry(t: Tables) -> DataFrame:
    return clean_expiry(documents(t)).select("entity_id", F.col("years_to_id_expiry").alias("years"))


_REGISTERED = f"""{s.ctes('entities', 'members', 'registry')},
first_doc AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY registry_no ORDER BY registry_created_at) AS rnk FROM registry) WHERE rnk = 1),
registered AS (SELECT DISTINCT entity_id, e.created_at, e.registry_no, (d.registry_no IS NOT NULL)::INT AS registry_hit, company_postcode, registry_status, structure_level, part
  FROM entities e JOIN members m USING (member_id) LEFT JOIN first_doc d ON e.registry_no = d.registry_no
  WHERE is_completed = 1 AND e.created_at BETWEEN DATE '{LO}' AND DATE '{HI}')"""


def registered(t: Tables, *keep: str, **before) -> DataFrame:
    return registry_enrich(s.entities(t), s.members(t), s.registry(t), LO, HI, keep, **before)


@query(f"""
WITH {_REGISTERED} SELECT DISTINCT entity_id, registry_no, registry_hit, company_postcode, registry_status AS status, structure_level FROM registered""")
def registry_documents(t: Tables) -> DataFrame:
    found = registered(t, "company_postcode", "registry_status", "structure_level")
    return found.select(
        "entity_id", "registry_no", "registry_hit", "company_postcode", F.col("registry_status").alias("status"), "structure_level"
    ).distinct()


@query(f"""
WITH {_REGISTERED}, code AS (SELECT DISTINCT entity_id, CASE WHEN length(company_postcode) > 4 THEN left(company_postcode, length(company_postcode) - 3) ELSE company_postcode END AS c FROM registered),
lookup AS (SELECT left(p_brand, 2 + (p_partkey % 4)::INT) AS code, max(p_type) AS level FROM part GROUP BY 1),
hit AS (SELECT entity_id, c, arg_max(level, length(code)) AS level FROM code JOIN lookup ON starts_with(c, code) GROUP BY 1, 2)
SELECT entity_id, CASE WHEN c IS NULL OR length(c) NOT BETWEEN 2 AND 4 THEN 'Undefined' ELSE coalesce(level, 'Low') END AS level
FROM code LEFT JOIN hit USING (entity_id, c)""")
def registry_postcode_levels(t: Tables) -> DataFrame:
    size = (2 + F.col("p_partkey") % 4).cast("int")
    lookup = t.part.groupBy(F.substring("p_brand", F.lit(1), size).alias("code")).agg(F.max("p_type").alias("level"))
    graded = postcode_level(registered(t, "company_postcode"), "company_postcode", lookup, "level")
    return graded.select("entity_id", outward_code("company_postcode").getField("value").alias("c"), "level").distinct().select("entity_id", "level")


@query(f"""
WITH {_REGISTERED}, {_DOCUMENTS.split(',', 0)[0].replace(s.ctes('entities', 'members', 'id_scans', 'users'), s.ctes('id_scans', 'users'))},
born AS (SELECT DISTINCT entity_id, p_size, p_type, structure_level, part, d.created_at, date_of_birth, id_first_name, id_last_name
         FROM registered r JOIN documents_ d USING (entity_id) LEFT JOIN part ON p_partkey = part)
SELECT DISTINCT entity_id, CASE WHEN p_size % 4 + 1 >= 3 THEN '3+' WHEN p_size IS NULL THEN 'Undefined' ELSE (p_size % 4 + 1)::VARCHAR END AS officers,
  trunc((created_at - CASE WHEN part IS NULL THEN date_of_birth ELSE date_trunc('month', DATE '1950-01-01' + (part % 9000)::INT)::DATE END) / 365.2425)::INT AS age,
  CASE WHEN structure_level IS NULL THEN 'Undefined' WHEN structure_level IN ('1', '2') THEN structure_level ELSE '3+' END AS structure, 'Undefined' AS level
FROM born""")
def officer_features(t: Tables) -> DataFrame:
    levels = t.region.select(F.concat(F.lit("N"), F.col("r_regionkey").cast("string")).alias("code"), F.lit("High").alias("level"))
    found = registered(
        t, "directors_tree", "structure_level", prepare=lambda docs: graded_people(docs, levels), beside=applicants(documents(t))
    )
    rows = people_enrich(found, None, levels)
    return rows.select(
        "entity_id",
        F.col("company_directors_count").alias("officers"),
        F.col("directors_avg_age_at_completion").alias("age"),
        F.col("company_structurelevelwise").alias("structure"),
        F.col("applicant_dd_nationality").alias("level"),
    ).distinct()


_APPLY = """
apps AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup'),
past AS (SELECT user_id, ts AS past_ts, event_id AS past_id, event_type, value FROM events WHERE event_type <> 'signup'),
found AS (SELECT a.event_id, a.user_id, p.past_id, p.event_type, p.value, c_mktsegment, c_acctbal, n_name
  FROM apps a ASOF JOIN past p ON a.user_id = p.user_id AND a.ts >= p.past_ts JOIN customer ON c_custkey = a.user_id JOIN nation ON n_nationkey = c_nationkey)"""

_RULES = """
(contains(upper(n_name), 'N_1'))::INT AS r_country, (contains(lower(c_mktsegment), 'build'))::INT AS r_industry, (c_acctbal < 500)::INT AS r_poor"""


def _applications(t: Tables) -> DataFrame:
    e = t.events.filter(F.col("event_type") == "signup").select("event_id", F.col("user_id").alias("entity_id"), F.col("ts").alias("timestamp"))
    c = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    joined = e.join(c, F.col("c_custkey") == F.col("entity_id"))
    return joined.select(
        "event_id",
        "entity_id",
        "timestamp",
        F.col("timestamp").alias("created_on"),
        F.date_sub(F.col("timestamp").cast("date"), (F.col("event_id") % 500).cast("int")).alias("incorporation_date"),
        F.when(F.col("event_id") % 3 == 0, "iOS").when(F.col("event_id") % 3 == 1, "Android").alias("device_type"),
        F.concat(F.lower("c_mktsegment"), F.lit("@"), F.when(F.col("event_id") % 2 == 0, "gmail.com").otherwise("a.org")).alias("email"),
        F.col("n_name").alias("id_country"),
        F.col("c_mktsegment").alias("industry"),
        "c_acctbal",
    )


def _history(t: Tables) -> DataFrame:
    def cell(value):
        return F.to_json(F.struct(F.lit("{}").alias("input"), F.struct(value.alias("value"), F.lit("").alias("error")).alias("output")))

    rows = t.events.filter(F.col("event_type") != "signup")
    kind = F.col("event_type")
    return rows.select(
        F.col("user_id").alias("entity_id"),
        "ts",
        cell(F.when(kind == "error", "BL001 and director_mismatch").when(kind == "view", "idscan_mismatch").otherwise("")).alias("manual_approval_triggers"),
        cell((F.col("value") < 50).cast("string")).alias("applicant_fraud_pass"),
        cell((kind != "click").cast("string")).alias("director_fraud_pass"),
        cell(F.lit("true")).alias("shareholder_fraud_pass"),
        cell(F.col("event_id").cast("string")).alias("past_id"),
    )


CELLS = ["manual_approval_triggers", "applicant_fraud_pass", "director_fraud_pass", "shareholder_fraud_pass", "past_id"]


@query(f"""
WITH {_APPLY}, f AS (SELECT *, {_RULES}, (value >= 50 OR event_type = 'click')::INT AS fail,
  (event_type = 'error')::INT AS blocked, (event_type = 'view')::INT AS scan FROM found)
SELECT event_id, past_id::VARCHAR AS past_id, greatest(r_country, r_industry, r_poor)::INT AS rc_rule_in_fbr, fail AS fraud_fail, blocked AS individual_blocklist,
  scan AS individual_id_scan, blocked AS business_internal_checks, least(r_country + r_industry + r_poor + fail + blocked + scan + blocked, 5)::INT AS count_failed_business_rules,
  CASE WHEN event_id % 500 / 30.436875 <= 1 THEN '< 1M' WHEN event_id % 500 / 30.436875 < 6 THEN '< 6M' WHEN event_id % 500 / 30.436875 < 12 THEN '< 12M' ELSE '>= 12M' END AS age_band,
  CASE event_id % 3 WHEN 0 THEN 'ios' WHEN 1 THEN 'android' ELSE 'none' END AS device, CASE WHEN event_id % 2 = 0 THEN 'gmail.com' ELSE 'other' END AS domain
FROM f""")
def point_in_time_features(t: Tables) -> DataFrame:
    rules = {
        "r_country": F.contains(F.upper("id_country"), F.lit("N_1")),
        "r_industry": F.contains(F.lower("industry"), F.lit("build")),
        "r_poor": F.col("c_acctbal") < 500,
    }
    rows = feature_set(_applications(t), _history(t), CELLS, rules)
    return rows.select(
        "event_id",
        "past_id",
        "rc_rule_in_fbr",
        "fraud_fail",
        "individual_blocklist",
        "individual_id_scan",
        "business_internal_checks",
        "count_failed_business_rules",
        F.col("age_of_company_bucket").alias("age_band"),
        F.col("applicant_device_type").alias("device"),
        F.col("applicant_email_domain").alias("domain"),
    )


@query("""
WITH a AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN '' ELSE p_name END AS first_name, p_type AS last_name,
  split_part(p_name, ' ', 2) AS word, p_brand AS code, p_type AS kind, p_size FROM part)
SELECT p_partkey,
  (NOT coalesce(first_name <> '', false))::INT AS rule_applicant_singlename,
  contains(lower(word || ' animal_breeder'), 'animal_breeder')::INT AS rule_industry_animal_breeder,
  (contains(upper(code || word), 'RU') OR contains(upper(code || word), 'RUS'))::INT AS rule_idcountry_russia,
  (contains(upper(code || word), 'UA') OR contains(upper(code || word), 'UKR'))::INT AS rule_idcountry_ukraine,
  (contains(upper(code || word), 'BY') OR contains(upper(code || word), 'BLR'))::INT AS rule_idcountry_belarus,
  (contains(upper(code || word), 'RO') AND (starts_with(kind, 'E') OR starts_with(kind, 'ST')) AND p_size > 10)::INT AS rule_idcountry_romania,
  0 AS rule_idcountry_portugal,
  (contains(lower(kind || 'bank'), 'bank'))::INT AS rule_company_bank
FROM a""")
def named_application_rules(t: Tables) -> DataFrame:
    from casewise.operators.rules import apply_rules

    size, word = F.col("p_size"), F.split_part("p_name", F.lit(" "), F.lit(2))
    rows = t.part.select(
        "p_partkey",
        F.when(size % 5 == 0, F.lit(None)).when(size % 5 == 1, "").otherwise(F.col("p_name")).alias("first_name"),
        F.col("p_type").alias("last_name"),
        F.concat(word, F.lit(" animal_breeder")).alias("industry"),
        F.concat("p_brand", word).alias("id_country"),
        F.when(size > 10, "PASSPORT").otherwise("CARD").alias("id_type"),
        F.lit("LTD").alias("entity_type"),
        F.col("p_type").alias("postcode"),
        F.lit("00000").alias("industry_code"),
        F.lit(False).alias("is_registered"),
        F.lit("a@gmail.com").alias("email"),
        F.lit("ios").alias("device_type"),
        F.concat("p_type", F.lit("bank")).alias("trading_name"),
    )
    rules = application_rules()
    return apply_rules(rows, rules).select("p_partkey", *rules)


@query("""
WITH o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'High' WHEN 'O' THEN 'Low' ELSE 'Undefined' END AS a,
  CASE WHEN o_orderpriority < '3' THEN 'Medium' ELSE 'Low' END AS b, CASE WHEN o_orderkey % 9 = 0 THEN 'High' ELSE 'Undefined' END AS c FROM orders)
SELECT o_orderkey, CASE WHEN a = 'High' THEN 'High' WHEN b = 'Medium' THEN 'Medium' ELSE 'Low' END AS applicant_nationality,
  CASE WHEN a = 'High' OR c = 'High' THEN 'High' WHEN b = 'Medium' THEN 'Medium' ELSE 'Low' END AS applicant_idcountry_idnationality FROM o""")
def combined_nationality_levels(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    rows = t.orders.select(
        "o_orderkey",
        F.when(status == "F", "High").when(status == "O", "Low").otherwise("Undefined").alias("applicant_nationality"),
        F.when(F.col("o_orderpriority") < "3", "Medium").otherwise("Low").alias("applicant_dd_nationality"),
        F.when(F.col("o_orderkey") % 9 == 0, "High").otherwise("Undefined").alias("applicant_idcountry_issue"),
    )
    return combine_levels(rows).drop("applicant_idcountry_issue")
