"""Case tables (entities, members, tickets, …) derived from the given tables.

Every builder has an SQL text of the same name, so both engines start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.catalog.registry import Tables

LO, HI = "1996-01-01", "1998-12-31"

SQL = {
    "entities": """
SELECT (c_custkey + 1000)::VARCHAR AS entity_id, 'm' || c_custkey AS member_id,
  DATE '1995-06-01' + (c_custkey * 7 % 1800)::INT AS created_at,
  CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 500)::VARCHAR END AS registry_no FROM customer""",
    "members": """
SELECT 'm' || c_custkey AS member_id, DATE '1995-06-01' + (c_custkey * 7 % 1800)::INT AS created_at,
  (c_custkey % 11 <> 0)::INT AS is_completed,
  CASE WHEN c_acctbal > 0 THEN DATE '1995-06-01' + (c_custkey * 7 % 1800 + c_custkey % 120)::INT END AS approved_at,
  CASE WHEN c_acctbal <= 2000 THEN DATE '1995-06-01' + (c_custkey * 7 % 1800 + c_custkey % 100)::INT END AS rejected_at FROM customer""",
    "actions": """
SELECT (o_custkey + 1000)::VARCHAR AS entity_id, o_orderdate AS ts, o_orderpriority AS action,
  CASE o_orderstatus WHEN 'F' THEN 'InVoluntary' ELSE 'Voluntary' END AS action_type FROM orders
WHERE o_orderkey % 4 <> 1""",
    "decisions": """
SELECT 'm' || o_custkey AS member_id, o_orderdate::TIMESTAMP AS decided_at,
  CASE o_orderstatus WHEN 'F' THEN 'mkyc' WHEN 'O' THEN 'approved' ELSE 'rejected' END AS decision FROM orders""",
    "tickets": """
SELECT o_orderkey AS ticket_id, 'T' || o_orderkey AS ticket_key,
  CASE WHEN o_orderkey % 10 <> 0 AND o_orderkey % 3 = 0 THEN 'T' || (o_orderkey - o_orderkey % 10) END AS parent_key,
  CASE WHEN o_orderkey % 4 <> 3 THEN 'CASE' ELSE 'OTH' END AS project_key,
  'case ' || (o_custkey + 1000) || ' check' AS summary,
  CASE WHEN o_orderpriority < '4' THEN ' TM alert' ELSE 'Other' END AS issue_type,
  CASE WHEN o_orderstatus = 'F' THEN 'Done' WHEN o_orderstatus = 'P' THEN 'Duplicates' END AS status,
  CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 3 = 1 THEN 0 END AS is_subtask,
  o_orderdate AS created_at, o_orderpriority AS fraud_type, nullif(o_orderkey % 5, 0) AS n_reports,
  ' "' || (o_orderkey % 40) || '-' || (o_custkey % 100) || '",' AS ref_1, (o_custkey % 40) || '-' || (o_orderkey % 100) AS ref_2,
  CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey + 1000)::VARCHAR END AS entity_id FROM orders""",
    "changes": """
SELECT l_orderkey AS ticket_id, l_shipdate AS change_at, CASE WHEN l_linenumber <= 3 THEN 'Number of fraud reports' ELSE 'status' END AS change_field,
  CASE l_returnflag WHEN 'R' THEN 'SAR' WHEN 'A' THEN 'Clear funds' ELSE 'Open' END AS new_value FROM lineitem""",
    "txns": """
SELECT (l_partkey % 1500 + 1000)::VARCHAR AS entity_id, (l_partkey % 40) || '-' || (l_suppkey % 100) AS txn_ref, l_shipdate AS transaction_at,
  l_extendedprice AS amount FROM lineitem""",
    "id_scans": """
SELECT 'm' || o_custkey AS member_id, o_orderdate AS created_at,
  CASE WHEN o_orderkey % 5 = 0 THEN 'SELFIE' WHEN o_orderkey % 2 = 0 THEN 'ID_SCAN' ELSE 'ID_SCAN_VALIDATIONS' END AS verification_type,
  CASE WHEN o_orderkey % 7 = 0 THEN 'OTHER' ELSE 'REGISTRATION' END AS verification_usage,
  o_orderpriority AS id_first_name, o_orderstatus AS id_last_name, o_orderdate::DATE + (o_orderkey % 3650)::INT AS id_expiry_at FROM orders""",
    "users": """
SELECT 'm' || o_custkey AS member_id, DATE '1950-01-01' + (o_orderkey % 9000)::INT AS date_of_birth, o_orderdate AS created_at
FROM orders WHERE o_orderkey % 3 = 0""",
    "registry": """
SELECT (s_suppkey * 3)::VARCHAR AS registry_no, s_suppkey AS doc, p_partkey AS part,
  TIMESTAMP '2000-01-01' + (p_partkey % 97) * INTERVAL 1 HOUR AS registry_created_at,
  p_brand AS company_postcode, CASE WHEN p_size % 2 = 0 THEN 'Active' END AS registry_status, (p_size % 4)::VARCHAR AS structure_level
FROM part JOIN supplier ON s_suppkey = p_partkey % 100 WHERE p_partkey % 13 <> 0""",
}


def _day(offset) -> F.Column:
    return F.date_add(F.lit("1995-06-01").cast("date"), offset.cast("int"))


def _text(col) -> F.Column:
    return col.cast("string")


def entities(t: Tables) -> DataFrame:
    c = F.col("c_custkey")
    return t.customer.select(
        _text(c + 1000).alias("entity_id"),
        F.concat(F.lit("m"), _text(c)).alias("member_id"),
        _day(c * 7 % 1800).alias("created_at"),
        F.when(c % 7 != 0, _text(c % 500)).alias("registry_no"),
    )


def members(t: Tables) -> DataFrame:
    c, balance = F.col("c_custkey"), F.col("c_acctbal")
    return t.customer.select(
        F.concat(F.lit("m"), _text(c)).alias("member_id"),
        _day(c * 7 % 1800).alias("created_at"),
        (c % 11 != 0).cast("int").alias("is_completed"),
        F.when(balance > 0, _day(c * 7 % 1800 + c % 120)).alias("approved_at"),
        F.when(balance <= 2000, _day(c * 7 % 1800 + c % 100)).alias("rejected_at"),
    )


def actions(t: Tables) -> DataFrame:
    return t.orders.filter(F.col("o_orderkey") % 4 != 1).select(
        _text(F.col("o_custkey") + 1000).alias("entity_id"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderpriority").alias("action"),
        F.when(F.col("o_orderstatus") == "F", "InVoluntary").otherwise("Voluntary").alias("action_type"),
    )


def decisions(t: Tables) -> DataFrame:
    """Decision documents; SQL starts from the parsed fields."""
    outcome = F.when(F.col("o_orderstatus") == "F", "mkyc").when(F.col("o_orderstatus") == "O", "approved").otherwise("rejected")
    doc = F.struct(
        F.struct(F.concat(F.lit("m"), _text(F.col("o_custkey"))).alias("membership_id")).alias("identity"),
        F.struct(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("created_at")).alias("metadata"),
        F.struct(F.lit("Low").alias("risk_category"), outcome.alias("final_decision")).alias("decision"),
    )
    return t.orders.select(F.to_json(doc).alias("data"))


def tickets(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.col("o_orderstatus")
    return t.orders.select(
        k.alias("ticket_id"),
        F.concat(F.lit("T"), _text(k)).alias("ticket_key"),
        F.when((k % 10 != 0) & (k % 3 == 0), F.concat(F.lit("T"), _text(k - k % 10))).alias("parent_key"),
        F.when(k % 4 != 3, "CASE").otherwise("OTH").alias("project_key"),
        F.concat(F.lit("case "), _text(c + 1000), F.lit(" check")).alias("summary"),
        F.when(F.col("o_orderpriority") < "4", " TM alert").otherwise("Other").alias("issue_type"),
        F.when(status == "F", "Done").when(status == "P", "Duplicates").alias("status"),
        F.when(k % 3 == 0, 1).when(k % 3 == 1, 0).alias("is_subtask"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderpriority").alias("fraud_type"),
        F.nullif(k % 5, F.lit(0)).alias("n_reports"),
        F.concat(F.lit(' "'), _text(k % 40), F.lit("-"), _text(c % 100), F.lit('",')).alias("ref_1"),
        F.concat(_text(c % 40), F.lit("-"), _text(k % 100)).alias("ref_2"),
        F.when(k % 2 == 0, _text(c + 1000)).alias("entity_id"),
    )


def changes(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    return t.lineitem.select(
        F.col("l_orderkey").alias("ticket_id"),
        F.col("l_shipdate").alias("change_at"),
        F.when(F.col("l_linenumber") <= 3, "Number of fraud reports").otherwise("status").alias("change_field"),
        F.when(flag == "R", "SAR").when(flag == "A", "Clear funds").otherwise("Open").alias("new_value"),
    )


def txns(t: Tables) -> DataFrame:
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    return t.lineitem.select(
        _text(part % 1500 + 1000).alias("entity_id"),
        F.concat(_text(part % 40), F.lit("-"), _text(supplier % 100)).alias("txn_ref"),
        F.col("l_shipdate").alias("transaction_at"),
        F.col("l_extendedprice").alias("amount"),
    )


def id_scans(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select(
        F.concat(F.lit("m"), _text(F.col("o_custkey"))).alias("member_id"),
        F.col("o_orderdate").alias("created_at"),
        F.when(k % 5 == 0, "SELFIE").when(k % 2 == 0, "ID_SCAN").otherwise("ID_SCAN_VALIDATIONS").alias("verification_type"),
        F.when(k % 7 == 0, "OTHER").otherwise("REGISTRATION").alias("verification_usage"),
        F.col("o_orderpriority").alias("id_first_name"),
        F.col("o_orderstatus").alias("id_last_name"),
        F.date_add(F.col("o_orderdate").cast("date"), (k % 3650).cast("int")).alias("id_expiry_at"),
    )


def users(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.filter(k % 3 == 0).select(
        F.concat(F.lit("m"), _text(F.col("o_custkey"))).alias("member_id"),
        F.date_add(F.lit("1950-01-01").cast("date"), (k % 9000).cast("int")).alias("date_of_birth"),
        F.col("o_orderdate").alias("created_at"),
    )


def registry(t: Tables) -> DataFrame:
    """Registry documents; every 13th part gives a broken one, which SQL leaves out."""
    p, size = F.col("p_partkey"), F.col("p_size")
    # Making and parsing a document costs far more than moving its row; files may be few.
    joined = t.part.join(t.supplier, F.col("s_suppkey") == p % 100).repartition(t.spark.sparkContext.defaultParallelism)
    hours = F.expr("timestamp_ntz'2000-01-01 00:00:00' + make_dt_interval(0, CAST(p_partkey % 97 AS INT))")
    born = F.date_add(F.lit("1950-01-01").cast("date"), (p % 9000).cast("int"))
    person = F.struct(
        F.lit("Ann").alias("firstName"),
        F.col("p_type").alias("lastName"),
        _text(born).alias("dateOfBirth"),
        F.array(F.concat(F.lit("N"), _text(size % 5))).alias("nationalities"),
    )
    officers = F.transform(
        F.sequence(F.lit(1), size % 4 + 1), lambda i: F.struct(_text(i).alias("officerId"), person.alias("person"))
    )
    data = F.struct(
        _text(F.col("s_suppkey") * 3).alias("companyNumber"),
        F.struct(F.col("p_brand").alias("postcode"), F.lit("XX").alias("countryCode")).alias("address"),
        F.when(size % 2 == 0, "Active").alias("status"),
        F.struct(_text(size % 4).alias("1")).alias("structureLevelWise"),
        officers.alias("directorsTree"),
    )
    meta = F.struct(F.date_format(hours, "yyyy-MM-dd HH:mm:ss").alias("created_at"))
    text = F.to_json(F.struct(data.alias("data"), meta.alias("metadata")))
    return joined.select(F.when(p % 13 == 0, F.substring(text, 1, 20)).otherwise(text).alias("json_col"))


def ctes(*names: str) -> str:
    return ",\n".join(f"{n} AS ({SQL[n]})" for n in names)
