"""Outcome labels: decisions, escalations and payment fraud."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise.functions import (
    case_label,
    cohort_filter,
    extract_first,
    in_codes,
    is_not_value,
    map_codes,
    on_days,
    within_days,
)
from casewise.operators.frames import left_join_spread, unpivot_refs
from casewise.operators.temporal import dedupe, latest_per_key


# Fields read from a decision document; nested lists are kept as text.
DECISION = (
    "identity struct<membership_id:string>, metadata struct<created_at:string>, "
    "decision struct<risk_category:string,final_decision:string,failed_business_rules:string>"
)


def member_flags(members: DataFrame, lo, hi, days: int = 90) -> DataFrame:
    """Completed members created in [lo, hi] and decided within ``days``, with 0/1 flags."""
    approved = within_days("created_at", "approved_at", days)
    rejected = within_days("created_at", "rejected_at", days)
    return (
        members.filter(
            on_days("created_at", lo, hi)
            & (F.col("is_completed") == 1)
            & ((approved == 1) | (rejected == 1))
        )
        .select(
            "member_id",
            "created_at",
            "approved_at",
            approved.alias("is_approved"),
            rejected.alias("is_rejected"),
            F.when(F.col("approved_at").isNull(), rejected).otherwise(0).alias("is_rejected_at_onb"),
        )
        .distinct()
    )


def first_escalation(
    tickets: DataFrame,
    changes: DataFrame,
    project: str,
    issue_types: Sequence[str],
    values: Sequence[str],
    skip_status: str = "Duplicates",
) -> DataFrame:
    """``(entity_id, escalated_on)``: first day a ticket naming the entity reached one of ``values``."""
    cases = tickets.filter(
        (F.col("project_key") == project)
        & in_codes(F.trim("issue_type"), issue_types)
        & is_not_value("status", skip_status)
        & is_not_value("is_subtask", 1)
    ).select("ticket_id", extract_first("summary").alias("entity_id"))
    moves = changes.filter(in_codes("new_value", values)).select("ticket_id", "change_at")
    return cases.join(moves, "ticket_id").groupBy("entity_id").agg(F.min("change_at").cast("date").alias("escalated_on"))


def days_to_escalation(escalations: DataFrame, entities: DataFrame, members: DataFrame) -> DataFrame:
    """Days from approval to the first escalation, per entity of a completed member."""
    done = members.filter(F.col("is_completed") == 1).select("member_id", "approved_at")
    return (
        escalations.join(entities.select("entity_id", "member_id"), "entity_id")
        .join(done, "member_id")
        .groupBy("member_id", "entity_id")
        .agg(F.min(F.date_diff("escalated_on", F.col("approved_at").cast("date"))).alias("days_to_sar"))
    )


def parse_decisions(decisions: DataFrame, lo, hi) -> DataFrame:
    """Latest decision(s) per member among those recorded in [lo, hi], from JSON documents."""
    doc = F.from_json("data", DECISION).alias("doc")
    parsed = (
        decisions.select(doc)
        .select(
            F.col("doc.identity.membership_id").alias("member_id"),
            F.col("doc.metadata.created_at").try_cast("timestamp_ntz").alias("decided_at"),
            F.col("doc.decision.risk_category").alias("risk_category"),
            F.col("doc.decision.final_decision").alias("decision"),
            F.col("doc.decision.failed_business_rules").alias("failed_business_rules"),
        )
        .filter(on_days("decided_at", lo, hi))
    )
    return latest_per_key(parsed, "member_id", "decided_at")


def decision_spine(
    entities: DataFrame,
    members: DataFrame,
    decisions: DataFrame,
    actions: DataFrame,
    escalations: DataFrame,
    lo,
    hi,
    categories: Mapping[str, str] | None = None,
    involuntary: str = "Involuntary",
    onboarding_days: int | None = None,
    days: int = 90,
) -> DataFrame:
    """One row per decided entity with its decision, outcome and three 0/1 labels.

    With ``categories`` the action code is mapped to a closure category; without it the
    column ``action_type`` is read as is. ``onboarding_days`` also limits the rejection
    label to actions that long after creation.
    """
    flags = member_flags(members, lo, hi, days)
    latest = latest_per_key(actions, "entity_id", "ts")
    category = map_codes("action", categories) if categories else F.col("action_type")
    closures = latest.select("entity_id", F.col("ts").cast("date").alias("acted_on"), "action", category.alias("closure"))
    escalated = days_to_escalation(escalations, entities, members).select("entity_id", "days_to_sar")

    joined = (
        entities.select("entity_id", "member_id")
        .join(flags, "member_id")
        .join(parse_decisions(decisions, lo, hi).select("member_id", "decision"), "member_id")
        .join(closures, "entity_id", "left")
        .join(escalated, "entity_id", "left")
        .filter(~((F.col("decision") == "approved") & (F.col("is_rejected_at_onb") == 1)))
    )

    def acted_within(start: str, limit: int) -> Column:
        day = F.col(start).cast("date")
        return F.col("acted_on").between(day, F.date_add(day, limit))

    forced = F.col("closure") == involuntary
    at_onboarding = forced if onboarding_days is None else forced & acted_within("created_at", onboarding_days)
    approved, refused = F.col("is_approved"), F.col("is_rejected_at_onb")
    return joined.select(
        "entity_id",
        "member_id",
        F.col("created_at").alias("company_created_on"),
        "decision",
        "is_approved",
        "is_rejected",
        "is_rejected_at_onb",
        case_label(
            [
                ((F.col("decision") == "mkyc") & (approved == 1), "mkyc_approved"),
                ((F.col("decision") == "mkyc") & (refused == 1), "mkyc_rejected"),
                ((F.col("decision") == "approved") & (approved == 1), "auto_approved"),
            ],
            F.col("decision"),
        ).alias("decision_outcome"),
        (refused * F.when(at_onboarding, 1).otherwise(0)).alias("is_rejected_inv_at_onb"),
        (approved * F.when(forced & acted_within("approved_at", days), 1).otherwise(0)).alias("is_rejected_inv_af_app"),
        F.when((approved == 1) & (F.col("days_to_sar") <= days), 1).otherwise(0).alias("is_sar90"),
        F.when(acted_within("created_at", days) | acted_within("approved_at", days), F.col("action"))
        .otherwise("")
        .alias("staff_action"),
    ).distinct()


def fraud_labels(
    tickets: DataFrame,
    changes: DataFrame,
    txns: DataFrame,
    entities: DataFrame,
    members: DataFrame,
    lo,
    hi,
    project: str,
    fraud_types: Mapping[str, str],
    ref_cols: Sequence[str],
    change_field: str,
    skip_status: Sequence[str] = ("Duplicate", "Duplicates"),
    months: int = 6,
    since="2022-01-01",
) -> DataFrame:
    """Cohort entities with a payment-fraud flag and amount within ``months`` of approval.

    A ticket counts if it was reported in the window; its references are matched to
    transactions, each transaction goes to its earliest ticket, and sub-tickets stand
    for their parent.
    """
    first, last = F.lit(lo).cast("date"), F.add_months(F.lit(hi).cast("date"), months)
    changed = changes.filter(F.col("change_field") == change_field).select("ticket_id", "change_at")
    reported = F.coalesce("change_at", "created_at")
    known = (
        tickets.filter(
            (F.col("project_key") == project)
            & F.col("n_reports").isNotNull()
            & (F.col("is_subtask") != 1)
            & in_codes("fraud_type", fraud_types)
            & ~in_codes("status", skip_status)
        )
        .join(changed, "ticket_id", "left")
        .filter(reported.cast("date").between(first, last))
        .groupBy("ticket_key", "entity_id", "ticket_id")
        .agg(F.min(reported).alias("reported_at"))
        .filter(F.col("reported_at").between(first, last))
        .select("ticket_key")
        .distinct()
    )
    refs = unpivot_refs(tickets, "ticket_key", ref_cols)
    cases = tickets.filter(F.col("project_key") == project).select(
        "ticket_key", "parent_key", "fraud_type", F.col("created_at").alias("opened_at"), F.col("entity_id").alias("ticket_entity")
    )
    # The parent's type comes from any project; only the case itself must be of this one.
    parents = tickets.select(F.col("ticket_key").alias("_parent"), F.col("fraud_type").alias("_parent_type"))
    # Most cases have no parent; they must not meet in one task.
    named = (
        left_join_spread(cases, parents, "parent_key", "_parent")
        .join(refs, "ticket_key")
        .select(
            F.coalesce("parent_key", "ticket_key").alias("ticket_key"),
            F.when(F.col("parent_key").isNull(), F.col("fraud_type")).otherwise(F.col("_parent_type")).alias("fraud_type"),
            "opened_at",
            "ticket_entity",
            "ref",
        )
    )
    paid = txns.filter(F.col("transaction_at") >= F.lit(since).cast("date")).select(
        F.col("entity_id").alias("paid_entity"), "txn_ref", "transaction_at", "amount"
    )
    # A transaction reference belongs to its earliest ticket. Each side is reduced to its
    # first row per reference before they meet, so a reference used everywhere joins once.
    first_ticket = dedupe(named, "ref", ["opened_at", "ticket_key", "ticket_entity", "fraud_type"])
    first_paid = dedupe(paid, "txn_ref", ["transaction_at", "amount", "paid_entity"])
    claimed = first_ticket.join(first_paid, F.col("ref") == F.col("txn_ref"))
    fraud = (
        claimed.join(known, "ticket_key", "left_semi")
        .filter(in_codes("fraud_type", fraud_types))
        .select(F.coalesce("ticket_entity", "paid_entity").alias("entity_id"), F.col("transaction_at").cast("date").alias("paid_on"), "amount")
    )
    approved = F.col("approved_at").cast("date")
    inside = F.col("paid_on").between(approved, F.add_months(approved, months))
    return (
        members.filter(F.col("is_completed") == 1)
        .select("member_id", "approved_at")
        .join(entities.select("member_id", "entity_id", "created_at"), "member_id")
        .filter(cohort_filter("created_at", "approved_at", lo, hi))
        .join(fraud, "entity_id", "left")
        .groupBy("member_id", "entity_id", "created_at", "approved_at")
        .agg(
            F.max(F.when(inside, 1).otherwise(0)).alias("is_app_fraud"),
            F.sum(F.when(inside, F.col("amount")).otherwise(0)).alias("app_fraud_amount"),
        )
        .withColumn("is_approved", F.col("approved_at").isNotNull().cast("int"))
    )


__all__ = [
    "days_to_escalation",
    "decision_spine",
    "first_escalation",
    "fraud_labels",
    "member_flags",
    "parse_decisions",
]
