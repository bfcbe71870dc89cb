"""Applicant features: documents, registry, officers, point-in-time cells and rules."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise.functions import (
    band,
    clip,
    cohort_filter,
    contains_any,
    count_band,
    email_domain,
    mean_age,
    mean_months,
    on_days,
    outward_code,
    parse_people,
    single_name,
    startswith_any,
    unwrap_cells,
    worst_level,
    year_boundaries,
)
from casewise.operators.frames import drop_missing, fill_median, left_join_filtered, left_join_spread
from casewise.operators.lookup import prefix_lookup
from casewise.operators.people import match_person, nationality_levels_join
from casewise.operators.rules import apply_rules, fail_flag, group_triggers, summarize_rules
from casewise.operators.temporal import asof_join, first_per_key, latest_per_key

# Trigger groups and the codes that put a case into them.
TRIGGER_GROUPS = {
    "individual_blocklist": ["bl001", "bl002", "bl004", "bl005", "bl006", "bl007", "bl008"],
    "individual_identity_address": ["applicant_address_fail"],
    "individual_sanctions_pep": ["applicant_pep", "sanction_fail"],
    "individual_id_scan": [
        "facematch_verification_failed",
        "id_scan_images_download_failed",
        "id_scan_verification_failed",
        "idscan_mismatch",
    ],
    "business_internal_checks": [
        "missing_country_shareholder",
        "director_mismatch",
        "missing_number_or_name_registered_address",
        "missing_shareholder",
        "missing_sic_codes",
    ],
}

# Email domains kept as their own level.
EMAIL_DOMAINS = (
    "gmail.com",
    "hotmail.com",
    "outlook.com",
    "yahoo.com",
    "hotmail.co.uk",
    "icloud.com",
    "yahoo.co.uk",
    "live.co.uk",
)

# Bands of company age in months as (upper, inclusive, label).
AGE_BANDS = [(1, True, "< 1M"), (6, False, "< 6M"), (12, False, "< 12M")]
AGE_TOP = ">= 12M"


# Fields read from a registry document; the officer list is kept as text.
REGISTRY = (
    "data struct<companyNumber:string,address:struct<postcode:string,countryCode:string>,incorporationDate:string,"
    "directorsTree:string,structureLevelWise:map<string,string>,status:string>, metadata struct<created_at:string>"
)


def application_columns(df: DataFrame) -> DataFrame:
    """Company age band, device type and email domain of an application."""
    months = mean_months("incorporation_date", "created_on")
    return df.withColumns(
        {
            "age_of_company_bucket": band(months, AGE_BANDS, AGE_TOP),
            "applicant_device_type": F.lower(F.coalesce("device_type", F.lit("none"))),
            "applicant_email_domain": email_domain("email", EMAIL_DOMAINS),
        }
    )


def _mentions(col: str, *codes: str) -> Column:
    return contains_any(col, codes, "upper")


def country_rules(codes: Mapping[str, Sequence[str]], col: str = "id_country") -> dict[str, Column]:
    """One substring rule per country, e.g. ``{"russia": ["RU", "RUS"]}``."""
    return {f"rule_idcountry_{name}": _mentions(col, *texts) for name, texts in codes.items()}


def application_rules() -> dict[str, Column]:
    """The named rules over an application's raw columns."""
    # Country codes, postal prefixes, industry names and codes of the rules.
    countries = {"russia": ["RU", "RUS"], "ukraine": ["UA", "UKR"], "belarus": ["BY", "BLR"]}
    romania_postcodes = ["E", "B", "IP", "IG", "ST", "CV", "PR1", "PR2"]
    romania_industries = [
        "category.construction",
        "category.cleaner",
        "category.transport_and_storage",
        "category.decorator_&_painter",
        "category.painter_&_decorator",
        "category.furniture_removal",
        "category.domestic_cleaner",
        "category.household_cleaning_services",
        "category.industrial_cleaning_services",
        "category.hygiene_and_cleansing_services",
        "category.carpenter_/_carpentry",
        "category.plumbing_/_plumber",
        "category.builder",
    ]
    romania_codes = ["59111", "96090", "59112", "59200", "74209", "74202", "74201"]
    portugal_postcodes = ["M3", "M6", "M7", "M8", "G20", "G21", "G22", "G31", "G51", "ML1", "PA1"]
    bank_words = ["bank", "64191", "64110"]

    other_entity = F.col("entity_type").isNull() | contains_any("entity_type", ["LTD", "null", "None"])
    romania = (
        _mentions("id_country", "RO", "ROU")
        & contains_any("id_type", ["PASSPORT"])
        & other_entity
        & (
            startswith_any("postcode", romania_postcodes)
            | contains_any("industry", romania_industries)
            | contains_any("industry_code", romania_codes)
        )
    )
    portugal = (
        _mentions("id_country", "PT", "PRT")
        & contains_any("id_type", ["PASSPORT", "ID_CARD"])
        & F.coalesce(F.col("is_registered").cast("boolean"), F.lit(False))
        & startswith_any("postcode", portugal_postcodes)
        & contains_any("email", ["@gmail.com"], "lower")
        & contains_any("device_type", ["ios"], "lower")
    )
    return {
        "rule_applicant_singlename": single_name("first_name", "last_name"),
        "rule_industry_animal_breeder": contains_any("industry", ["animal_breeder"], "lower"),
        **country_rules(countries),
        "rule_idcountry_romania": romania,
        "rule_idcountry_portugal": portugal,
        "rule_company_bank": contains_any("trading_name", bank_words, "lower"),
    }


def feature_set(
    applications: DataFrame,
    history: DataFrame,
    cells: Sequence[str],
    rules: Mapping[str, Column] | None = None,
    triggers: str = "manual_approval_triggers",
    passes: Sequence[str] = ("applicant_fraud_pass", "director_fraud_pass", "shareholder_fraud_pass"),
    groups: Mapping[str, Sequence[str]] | None = None,
    include_any: bool = False,
) -> DataFrame:
    """Point-in-time feature cells of each application plus rule and trigger flags.

    ``history`` holds ``entity_id, ts`` and one JSON cell column per feature. Applications
    without a complete set of cells are dropped. ``count_failed_business_rules`` adds
    rules, the fraud check and trigger groups, capped at 5.
    """
    rules = application_rules() if rules is None else rules
    groups = TRIGGER_GROUPS if groups is None else groups
    flagged = summarize_rules(
        apply_rules(application_columns(applications), rules), list(rules), "rc_rule_in_fbr", "count_rc_rule_in_fbr", include_any
    )
    past = history.select("entity_id", F.col("ts").alias("feature_ts"), *cells)
    found = drop_missing(asof_join(flagged, past, "entity_id", "timestamp", "feature_ts"), ["feature_ts", *cells])
    valued = unwrap_cells(found, cells)
    checked = fail_flag(
        valued.withColumns({p: F.col(p).try_cast("boolean") for p in passes}), passes, "fraud_fail", "count_rc_rule_in_fbr"
    )
    grouped = group_triggers(checked, triggers, groups)
    parts = [F.col("count_rc_rule_in_fbr"), *[F.col(g) for g in groups]]
    total = sum(parts[1:], parts[0])
    return grouped.withColumn("count_failed_business_rules", clip(total, 0, 5)).drop(
        triggers, *passes, *rules, "count_rc_rule_in_fbr", "feature_ts"
    )


def document_features(
    entities: DataFrame, members: DataFrame, id_scans: DataFrame, users: DataFrame, lo, hi,
    scan_types: Sequence[str] = ("ID_SCAN", "ID_SCAN_VALIDATIONS"),
    scan_uses: Sequence[str] = ("REGISTRATION", "ACCOUNT_RECOVERY"),
    latest_only: bool = False,
) -> DataFrame:
    """Cohort entities with their latest identity document and first known birth date.

    An entity row that is not its entity's latest keeps NULL document fields unless
    ``latest_only`` drops it.
    """
    done = members.filter(F.col("is_completed") == 1).select("member_id", "approved_at")
    cohort = (
        entities.join(done, "member_id")
        .filter(cohort_filter("created_at", "approved_at", lo, hi))
        .select("entity_id", "member_id", "created_at")
    )
    newest = cohort.groupBy("entity_id").agg(F.max("created_at").alias("_newest"))
    ranked = cohort.join(newest, "entity_id").withColumn("_latest", F.col("created_at").eqNullSafe(F.col("_newest")))
    if latest_only:
        ranked = ranked.filter("_latest")
    scans = latest_per_key(
        id_scans.filter(F.col("verification_type").isin(*scan_types) & F.col("verification_usage").isin(*scan_uses)),
        "member_id",
        "created_at",
    ).select("member_id", "id_first_name", "id_last_name", "id_expiry_at")
    births = first_per_key(users, "member_id", "created_at").select("member_id", "date_of_birth")
    joined = left_join_filtered(ranked, scans, "member_id", left_pred=F.col("_latest"))
    return (
        left_join_filtered(joined, births, "member_id")
        .select(
            "entity_id",
            "created_at",
            "id_expiry_at",
            "id_first_name",
            "id_last_name",
            "date_of_birth",
            year_boundaries("created_at", "id_expiry_at").alias("years_to_id_expiry"),
        )
        .distinct()
    )


def clean_expiry(df: DataFrame, **options) -> DataFrame:
    """Clip years to expiry to 0..10 and fill NULL with the median of the clipped values."""
    clipped = df.withColumn("years_to_id_expiry", clip("years_to_id_expiry", 0, 10))
    return fill_median(clipped, ["years_to_id_expiry"], **options)


def registry_enrich(
    entities: DataFrame, members: DataFrame, registry: DataFrame, lo, hi, keep: Sequence[str] | None = None,
    prepare: Callable[[DataFrame], DataFrame] | None = None, beside: DataFrame | None = None,
) -> DataFrame:
    """Entities created in [lo, hi] with the first registry payload of their company number.

    Documents are parsed once, and the first per number is chosen before the join. ``keep`` names the document columns
    wanted; first documents of a number that are equal in them, or in what ``prepare`` makes of them, join once. An entity
    may meet many first documents: what is known per document or, with ``beside``, per ``entity_id`` is best joined before.
    """
    parsed = registry.select(F.from_json("json_col", REGISTRY).alias("doc")).select(
        F.col("doc.data.companyNumber").alias("_number"),
        F.col("doc.metadata.created_at").try_cast("timestamp_ntz").alias("registry_created_at"),
        F.col("doc.data.address.postcode").alias("company_postcode"),
        F.col("doc.data.address.countryCode").alias("company_countrycode"),
        F.col("doc.data.incorporationDate").alias("incorporation_date"),
        F.col("doc.data.directorsTree").alias("directors_tree"),
        F.try_element_at(F.col("doc.data.structureLevelWise"), F.lit("1")).alias("structure_level"),
        F.col("doc.data.status").alias("registry_status"),
    )
    first = first_per_key(parsed.filter(F.col("_number").isNotNull()), "_number", "registry_created_at")
    done = members.filter(F.col("is_completed") == 1).select("member_id")
    rows = entities.filter(on_days("created_at", lo, hi)).join(done, "member_id")
    kept = [c for c in parsed.columns if c != "_number" and (keep is None or c in keep)]
    found = first.select("_number", *kept).distinct()
    if prepare is not None:
        found = prepare(found).distinct()
    # Both sides are distinct, so their pairs are.
    rows = rows.select("entity_id", "member_id", "created_at", "registry_no")
    rows = (rows if beside is None else rows.join(beside, "entity_id")).distinct()
    joined = left_join_spread(rows, found, "registry_no", "_number")
    return joined.select(
        *rows.columns,
        F.col("_number").isNotNull().cast("int").alias("registry_hit"),
        *[c for c in found.columns if c != "_number"],
    )


def postcode_level(df: DataFrame, col: str, levels: DataFrame, out: str) -> DataFrame:
    """Risk level of a postal code by its longest known outward prefix."""
    code = outward_code(col)
    split = df.withColumn("_code", code.getField("value")).withColumn("_error", code.getField("error"))
    return prefix_lookup(split, "_code", levels, out, error="_error").drop("_code", "_error")


def graded_people(df: DataFrame, countries: DataFrame) -> DataFrame:
    """Replace ``directors_tree`` by its officers: names, month of birth and worst level of their nationalities.

    Equal texts are parsed and graded once. A text without officers gets NULL.
    """
    texts = df.select(F.col("directors_tree").alias("_text")).distinct()  # unfiltered, so that Spark reads ``df`` once
    officers = texts.select("_text", F.posexplode(parse_people("_text")).alias("_at", "_one")).select(
        "_text", "_at", "_one.first", "_one.last", F.trunc("_one.born", "month").alias("born"), F.col("_one.nationalities").alias("_nations")
    )
    graded = nationality_levels_join(officers, "_nations", countries, "level")
    lists = graded.groupBy("_text").agg(F.array_sort(F.collect_list(F.struct("_at", "first", "last", "born", "level"))).alias("people"))
    lists = lists.withColumn("people", F.transform("people", lambda p: F.struct(*[p[c].alias(c) for c in ("first", "last", "born", "level")])))
    return left_join_spread(df, lists, "directors_tree", "_text").drop("directors_tree", "_text")


def applicants(documents: DataFrame) -> DataFrame:
    """Who applied and when, as :func:`people_enrich` compares them with officers."""
    return documents.select("entity_id", F.col("created_at").alias("applied_at"), "id_first_name", "id_last_name", "date_of_birth").distinct()


def people_enrich(
    registry_rows: DataFrame, documents: DataFrame | None, countries: DataFrame, threshold: int = 90, first_only: bool = False
) -> DataFrame:
    """Per entity: level of the matched officer's nationalities, mean officer age, officer
    count band and structure level band.

    Rows may come with :func:`graded_people` and, if ``documents`` is None, with their :func:`applicants` already. Then
    nothing is joined to the pairs of entities and documents any more.
    """
    rows = registry_rows if "people" in registry_rows.columns else graded_people(registry_rows, countries)
    if documents is not None:
        rows = rows.select("entity_id", "people", "structure_level").join(
            documents.select("entity_id", F.col("created_at").alias("applied_at"), "id_first_name", "id_last_name", "date_of_birth"), "entity_id"
        )
    found = match_person("people", "id_first_name", "id_last_name", "date_of_birth", threshold, "level")
    level = F.col("structure_level")
    return rows.select(
        "entity_id",
        F.coalesce(found, F.lit("Undefined")).alias("applicant_dd_nationality"),
        mean_age("people", "applied_at", "date_of_birth", first_only).alias("directors_avg_age_at_completion"),
        count_band(F.when(F.size("people") > 0, F.size("people"))).alias("company_directors_count"),
        F.when(level.isNull(), "Undefined").when(level.isin("1", "2"), level).otherwise("3+").alias("company_structurelevelwise"),
    )


def combine_levels(df: DataFrame) -> DataFrame:
    """Worst of declared and officer nationality, then worst with the document's country."""
    merged = df.withColumn(
        "applicant_nationality", worst_level("applicant_nationality", "applicant_dd_nationality")
    ).drop("applicant_dd_nationality")
    return merged.withColumn(
        "applicant_idcountry_idnationality", worst_level("applicant_idcountry_issue", "applicant_nationality")
    )
