"""Outcome labels of the stand-in cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.catalog import standins as s
from casewise.catalog.registry import Tables, query, r6
from casewise.plans.labels import decision_spine, first_escalation, fraud_labels, member_flags
from casewise.plans.outcomes import outcome_report

LO, HI = s.LO, s.HI
CATEGORIES = {"1-URGENT": "Involuntary", "2-HIGH": "Involuntary", "3-MEDIUM": "Voluntary", "5-LOW": "Multiple Accounts"}
ISSUES, VALUES = ["TM alert", "Risk case"], ["SAR", "Clear funds"]

_FLAGS = f"""flags AS (SELECT DISTINCT * FROM (SELECT member_id, created_at, approved_at,
    (coalesce(approved_at - created_at, 999) <= 90)::INT AS is_approved, (coalesce(rejected_at - created_at, 999) <= 90)::INT AS is_rejected,
    (approved_at IS NULL AND coalesce(rejected_at - created_at, 999) <= 90)::INT AS is_rejected_at_onb
  FROM members WHERE created_at BETWEEN DATE '{LO}' AND DATE '{HI}' AND is_completed = 1)
  WHERE is_approved = 1 OR is_rejected = 1)"""

_ESCALATED = """escalated AS (
  SELECT nullif(regexp_extract(trim(summary), '[0-9]{4,}'), '') AS entity_id, min(change_at)::DATE AS escalated_on
  FROM tickets JOIN changes USING (ticket_id)
  WHERE project_key = 'CASE' AND trim(issue_type) IN ('TM alert', 'Risk case') AND (status IS NULL OR status <> 'Duplicates')
    AND (is_subtask IS NULL OR is_subtask <> 1) AND new_value IN ('SAR', 'Clear funds') GROUP BY 1)"""


def _spine_sql(closure: str, onboarding: str) -> str:
    return f"""
WITH {s.ctes('entities', 'members', 'actions', 'decisions', 'tickets', 'changes')}, {_FLAGS}, {_ESCALATED},
sar AS (SELECT entity_id, min(escalated_on - approved_at) AS days FROM escalated JOIN entities USING (entity_id)
        JOIN members USING (member_id) WHERE is_completed = 1 GROUP BY 1),
act AS (SELECT entity_id, ts::DATE AS acted, action, {closure} AS closure FROM
         (SELECT *, rank() OVER (PARTITION BY entity_id ORDER BY ts DESC) AS rnk FROM actions) WHERE rnk = 1),
dec AS (SELECT member_id, decision FROM (SELECT *, rank() OVER (PARTITION BY member_id ORDER BY decided_at DESC) AS rnk FROM decisions
         WHERE decided_at::DATE BETWEEN DATE '{LO}' AND DATE '{HI}') WHERE rnk = 1)
SELECT DISTINCT e.entity_id, e.member_id, f.created_at::VARCHAR AS created, decision, is_approved, is_rejected, is_rejected_at_onb,
  CASE WHEN decision = 'mkyc' AND is_approved = 1 THEN 'mkyc_approved' WHEN decision = 'mkyc' AND is_rejected_at_onb = 1 THEN 'mkyc_rejected'
       WHEN decision = 'approved' AND is_approved = 1 THEN 'auto_approved' ELSE decision END AS decision_outcome,
  is_rejected_at_onb * coalesce(closure = 'Involuntary' AND {onboarding}, false)::INT AS is_rejected_inv_at_onb,
  is_approved * coalesce(closure = 'Involuntary' AND acted BETWEEN approved_at AND approved_at + 90, false)::INT AS is_rejected_inv_af_app,
  (is_approved = 1 AND coalesce(days, 999) <= 90)::INT AS is_sar90,
  CASE WHEN acted BETWEEN f.created_at AND f.created_at + 90 OR acted BETWEEN approved_at AND approved_at + 90 THEN action ELSE '' END AS staff_action
FROM entities e JOIN flags f USING (member_id) JOIN dec USING (member_id) LEFT JOIN act USING (entity_id) LEFT JOIN sar USING (entity_id)
WHERE NOT (decision = 'approved' AND is_rejected_at_onb = 1)"""


_BY_CODE = _spine_sql(
    "CASE WHEN action IN ('1-URGENT', '2-HIGH') THEN 'Involuntary' WHEN action = '3-MEDIUM' THEN 'Voluntary' WHEN action = '5-LOW' THEN 'Multiple Accounts' END",
    "true",
)


def spine(t: Tables, **options) -> DataFrame:
    options = options or {"categories": CATEGORIES}
    escalations = first_escalation(s.tickets(t), s.changes(t), "CASE", ISSUES, VALUES)
    return decision_spine(s.entities(t), s.members(t), s.decisions(t), s.actions(t), escalations, LO, HI, **options)


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("created", F.col("company_created_on").cast("string")).drop("company_created_on")


@query(_BY_CODE)
def decision_outcomes(t: Tables) -> DataFrame:
    return _shown(spine(t))


@query(_spine_sql("CASE action_type WHEN 'InVoluntary' THEN 'Involuntary' END", "acted BETWEEN f.created_at AND f.created_at + 90"))
def decision_outcomes_by_action_type(t: Tables) -> DataFrame:
    return _shown(spine(t, involuntary="InVoluntary", onboarding_days=90))


@query(f"WITH {s.ctes('members')}, {_FLAGS} SELECT member_id, created_at::VARCHAR AS created, is_approved, is_rejected, is_rejected_at_onb FROM flags")
def member_decisions(t: Tables) -> DataFrame:
    flags = member_flags(s.members(t), LO, HI)
    return flags.select("member_id", F.col("created_at").cast("string").alias("created"), "is_approved", "is_rejected", "is_rejected_at_onb")


@query(f"WITH {s.ctes('tickets', 'changes')}, {_ESCALATED} SELECT entity_id, escalated_on::VARCHAR AS day FROM escalated")
def first_escalations(t: Tables) -> DataFrame:
    found = first_escalation(s.tickets(t), s.changes(t), "CASE", ISSUES, VALUES)
    return found.select("entity_id", F.col("escalated_on").cast("string").alias("day"))


FRAUD_TYPES = {"1-URGENT": "Scam A", "2-HIGH": "Scam A", "3-MEDIUM": "Scam B", "4-NOT SPECIFIED": "Unknown"}

FRAUD_SQL = f"""
{s.ctes('entities', 'members', 'tickets', 'changes', 'txns')},
known AS (SELECT ticket_key FROM (
    SELECT t.ticket_key, t.entity_id, t.ticket_id, min(coalesce(change_at, created_at)) AS reported FROM tickets t
    LEFT JOIN changes c ON c.ticket_id = t.ticket_id AND change_field = 'Number of fraud reports'
    WHERE project_key = 'CASE' AND n_reports IS NOT NULL AND is_subtask <> 1 AND fraud_type IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')
      AND coalesce(change_at, created_at)::DATE BETWEEN DATE '{LO}' AND DATE '{HI}' + INTERVAL 6 MONTH AND status NOT IN ('Duplicate', 'Duplicates')
    GROUP BY 1, 2, 3) WHERE reported BETWEEN DATE '{LO}' AND DATE '{HI}' + INTERVAL 6 MONTH GROUP BY 1),
refs AS (SELECT ticket_key, regexp_replace(r, '[\\s,"\\]]', '', 'g') AS ref FROM
   (SELECT ticket_key, trim(ref_1) AS r FROM tickets UNION SELECT ticket_key, trim(ref_2) FROM tickets) WHERE r IS NOT NULL),
named AS (SELECT coalesce(a.parent_key, a.ticket_key) AS ticket_key, CASE WHEN a.parent_key IS NULL THEN a.fraud_type ELSE p.fraud_type END AS fraud_type,
            a.created_at AS opened_at, a.entity_id AS ticket_entity, ref
          FROM (SELECT * FROM tickets WHERE project_key = 'CASE') a JOIN refs USING (ticket_key) LEFT JOIN tickets p ON a.parent_key = p.ticket_key),
claimed AS (SELECT *, x.entity_id AS paid_entity FROM named JOIN txns x ON ref = txn_ref WHERE transaction_at >= DATE '1996-01-01'
  QUALIFY row_number() OVER (PARTITION BY txn_ref ORDER BY opened_at, ticket_key, transaction_at, amount, paid_entity, ticket_entity, fraud_type) = 1),
fraud AS (SELECT coalesce(ticket_entity, paid_entity) AS entity_id, transaction_at::DATE AS paid_on, amount FROM claimed
          WHERE ticket_key IN (SELECT ticket_key FROM known) AND fraud_type IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')),
fraud_labels AS (
SELECT member_id, e.entity_id, e.created_at, approved_at, (approved_at IS NOT NULL)::INT AS is_approved,
  max((coalesce(paid_on BETWEEN approved_at AND approved_at + INTERVAL 6 MONTH, false))::INT) AS is_app_fraud,
  sum(CASE WHEN paid_on BETWEEN approved_at AND approved_at + INTERVAL 6 MONTH THEN amount ELSE 0 END) AS app_fraud_amount
FROM (SELECT member_id, approved_at FROM members WHERE is_completed = 1) m JOIN entities e USING (member_id) LEFT JOIN fraud USING (entity_id)
WHERE coalesce(approved_at, e.created_at) <= DATE '{HI}' AND (e.created_at BETWEEN DATE '{LO}' AND DATE '{HI}'
   OR (approved_at BETWEEN DATE '{LO}' AND DATE '{HI}' AND approved_at BETWEEN e.created_at AND e.created_at + INTERVAL 3 MONTH))
GROUP BY 1, 2, 3, 4, 5)"""


def fraud(t: Tables) -> DataFrame:
    return fraud_labels(
        s.tickets(t), s.changes(t), s.txns(t), s.entities(t), s.members(t), LO, HI,
        project="CASE", fraud_types=FRAUD_TYPES, ref_cols=["ref_1", "ref_2"], change_field="Number of fraud reports", since="1996-01-01",
    )


@query(f"WITH {FRAUD_SQL} SELECT member_id, entity_id, is_approved, is_app_fraud::INT AS is_app_fraud, round(app_fraud_amount, 2) AS amount FROM fraud_labels")
def payment_fraud_labels(t: Tables) -> DataFrame:
    return fraud(t).select("member_id", "entity_id", "is_approved", "is_app_fraud", F.round("app_fraud_amount", 2).alias("amount"))


LABELS = ["is_rejected_inv_at_onb", "is_rejected_inv_af_app", "is_sar90"]
REVIEWED, APPROVED = ["mkyc_approved", "mkyc_rejected"], ["mkyc_approved", "auto_approved"]


def _report(t: Tables, table: str) -> DataFrame:
    trends = {LABELS[0]: REVIEWED, LABELS[1]: APPROVED, LABELS[2]: APPROVED}
    return outcome_report(spine(t), "company_created_on", LABELS, "staff_action", trends, only=[table])[table]


@query(f"""
SELECT decision_outcome, count(*)::BIGINT AS n, round(avg(is_rejected_inv_at_onb), 6) AS at_onb, round(avg(is_rejected_inv_af_app), 6) AS af_app,
  round(avg(is_sar90), 6) AS sar FROM ({_BY_CODE}) GROUP BY 1""")
def label_rates_by_outcome(t: Tables) -> DataFrame:
    rates = _report(t, "rates_by_decision_outcome")
    return rates.select(
        "decision_outcome", "n", r6(f"{LABELS[0]}_avg").alias("at_onb"), r6(f"{LABELS[1]}_avg").alias("af_app"), r6(f"{LABELS[2]}_avg").alias("sar")
    )


@query(f"""
SELECT left(created, 7) AS month,
  round(avg(CASE WHEN decision_outcome IN ('mkyc_approved', 'mkyc_rejected') THEN is_rejected_inv_at_onb END), 6) AS at_onb,
  round(avg(CASE WHEN decision_outcome IN ('mkyc_approved', 'auto_approved') THEN is_rejected_inv_af_app END), 6) AS af_app,
  round(avg(CASE WHEN decision_outcome IN ('mkyc_approved', 'auto_approved') THEN is_sar90 END), 6) AS sar FROM ({_BY_CODE}) GROUP BY 1""")
def label_trend_by_month(t: Tables) -> DataFrame:
    trend = _report(t, "trend")
    return trend.select(
        "month", r6(f"{LABELS[0]}_rate").alias("at_onb"), r6(f"{LABELS[1]}_rate").alias("af_app"), r6(f"{LABELS[2]}_rate").alias("sar")
    )


@query(f"""
SELECT staff_action AS value, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM ({_BY_CODE})
WHERE is_rejected_inv_af_app = 1 GROUP BY 1""")
def reasons_of_forced_closures(t: Tables) -> DataFrame:
    return _report(t, "reasons_is_rejected_inv_af_app").select("value", "n", r6("share").alias("share"))
