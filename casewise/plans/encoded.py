"""Base and encoded data sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.functions import clip
from casewise.operators.encode import merge_flags, one_hot, scale_columns
from casewise.operators.temporal import time_split

# Fixed values: {output: (column, low, high, reversed)}.
SCALES = {
    "age_at_completion_rev": ("age_at_completion", 18, 100, True),
    "directors_avg_age_at_completion_rev": ("directors_avg_age_at_completion", 18, 100, True),
    "years_to_id_expiry": ("years_to_id_expiry", 0, 10, False),
    "count_failed_business_rules": ("count_failed_business_rules", 0, 5, False),
}

# Encoded levels per column; others are the all-zero base level.
RISK = ["High", "Low", "Medium"]
LEVELS = {
    "applicant_postcode": RISK,
    "applicant_idcountry_issue": RISK,
    "applicant_nationality": RISK,
    "applicant_id_type": [
        "Driving_Licence",
        "National_ID",
        "Other_ID",
        "Passport",
        "Provisional_Licence",
        "Residence_Permit",
    ],
    "applicant_device_type": ["android"],
    "applicant_email_domain": [
        "gmail.com",
        "hotmail.com",
        "outlook.com",
        "yahoo.com",
        "hotmail.co.uk",
        "icloud.com",
        "yahoo.co.uk",
        "live.co.uk",
    ],
    "company_type": ["High", "Low", "Prohibited"],
    "company_nob": ["High", "Low", "Medium", "Prohibited"],
    "company_keywords": ["High", "Low", "Medium", "Prohibited"],
    "company_postcode": RISK,
    "company_status": ["Active", "Undefined"],
    "company_directors_count": ["1", "2", "3+"],
    "company_structurelevelwise": ["1", "2", "3+"],
    "age_of_company_bucket": ["< 1M", "< 6M", "< 12M", ">= 12M"],
}
MERGED = {"applicant_id_type_RP_Nid": ["applicant_id_type_Residence_Permit", "applicant_id_type_National_ID"]}

# 0/1 columns that are already flags, and the level left out per column
# when clustering, so that the remaining ones are not determined by each other.
FLAGS = [
    "fraud_fail",
    "individual_blocklist",
    "individual_identity_address",
    "individual_sanctions_pep",
    "individual_id_scan",
    "business_internal_checks",
]
BASE_LEVELS = {
    "applicant_postcode": ["Low"],
    "applicant_idcountry_issue": ["Low"],
    "applicant_nationality": ["Low"],
    "applicant_id_type": ["Driving_Licence"],
    "company_type": ["Low"],
    "company_nob": ["Low"],
    "company_keywords": ["Low"],
    "company_postcode": ["Low"],
    "company_status": ["Undefined"],
    "company_directors_count": ["1", "2", "3+"],
    "company_structurelevelwise": ["1"],
    "age_of_company_bucket": ["< 1M"],
}


def cluster_features() -> list[str]:
    """The encoded columns used for clustering and linear scoring."""
    gone = {part for parts in MERGED.values() for part in parts}
    gone |= {f"{c}_{level}" for c, levels in BASE_LEVELS.items() for level in levels}
    dummies = [f"{c}_{level}" for c, levels in LEVELS.items() for level in levels]
    numbers = ["directors_avg_age_at_completion_rev", "years_to_id_expiry"]
    return [*numbers, *[d for d in dummies if d not in gone], *MERGED, *FLAGS]


def add_fraud(spine: DataFrame, fraud: DataFrame) -> DataFrame:
    """Spine plus fraud labels; no label is 0 and amounts are not negative."""
    joined = spine.join(fraud.select("entity_id", "is_app_fraud", "app_fraud_amount"), "entity_id", "left")
    filled = joined.na.fill({"is_app_fraud": 0, "app_fraud_amount": 0})
    return filled.withColumn("app_fraud_amount", clip("app_fraud_amount", 0))


def base_sets(labels: DataFrame, features: DataFrame, ts: str, end, days: int = 90) -> tuple[DataFrame, DataFrame]:
    """Train rows with labels and features; test rows for every feature row, labelled or not.

    Features are split on their own ``ts``, labels on theirs.
    """
    train_labels, test_labels = time_split(labels, ts, end, days)
    train_features, test_features = time_split(features, ts, end, days)
    return (
        train_labels.join(train_features.drop(ts), "entity_id"),
        test_labels.join(test_features.drop(ts), "entity_id", "right"),
    )


def encode(
    df: DataFrame,
    scales: Mapping[str, tuple] = SCALES,
    levels: Mapping[str, Sequence[str]] = LEVELS,
    merged: Mapping[str, Sequence[str]] = MERGED,
) -> DataFrame:
    """Scaled numbers and 0/1 levels; every other column is kept."""
    out = one_hot(scale_columns(df, scales), levels)
    for name, parts in merged.items():
        out = merge_flags(out, parts, name)
    return out


def encoded_sets(
    train: DataFrame,
    test: DataFrame,
    least: Mapping[str, float] | None = None,
    decision: str = "decision",
    review: str = "mkyc",
    **spec,
) -> tuple[DataFrame, DataFrame]:
    """Encode both sets; ``least`` drops train rows below a value (NULL too), and test
    rows without a decision count as manual review."""
    # Applicants and officers are adults.
    least = {"age_at_completion": 18, "directors_avg_age_at_completion": 18} if least is None else least
    for col, value in least.items():
        train = train.filter(F.col(col) >= value)
    return encode(train, **spec), encode(test, **spec).na.fill({decision: review})
