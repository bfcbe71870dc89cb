"""Rules, triggers, encoded levels and scaled numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.catalog.registry import Tables, query, r6
from casewise.functions import contains_any, single_name, startswith_any
from casewise.operators.encode import merge_flags, one_hot, scale_columns, standardize
from casewise.operators.rules import apply_rules, capped_count, fail_flag, group_triggers, rule_report, summarize_rules

_RULES_SQL = """
SELECT p_partkey,
  (contains(lower(p_name), 'bolt') OR contains(lower(p_name), 'ring'))::INT AS rule_name,
  (starts_with(p_brand, 'Brand#1') OR starts_with(p_brand, 'Brand#20'))::INT AS rule_brand,
  (contains(upper(p_type), 'EC') AND p_size > 25)::INT AS rule_type,
  coalesce(NOT ((a IS NULL AND b IS NULL) OR (coalesce(a <> '', false) AND coalesce(b <> '', false))), false)::INT AS rule_single
FROM (SELECT *, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN '' ELSE 'x' END AS a,
             CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'y' END AS b FROM part)"""

FLAGS = ["rule_name", "rule_brand", "rule_type", "rule_single"]


def _flagged(t: Tables) -> DataFrame:
    rest = F.col("p_partkey") % 4
    first = F.when(rest == 0, F.lit(None)).when(rest == 1, "").otherwise("x")
    last = F.when(F.col("p_partkey") % 3 != 0, "y")
    rules = {
        "rule_name": contains_any("p_name", ["bolt", "ring"], "lower"),
        "rule_brand": startswith_any("p_brand", ["Brand#1", "Brand#20"]),
        "rule_type": contains_any("p_type", ["EC"], "upper") & (F.col("p_size") > 25),
        "rule_single": single_name(first, last),
    }
    return apply_rules(t.part, rules)


@query(f"""
SELECT *, greatest(rule_name, rule_brand, rule_type, rule_single)::INT AS any_rule,
  (rule_name + rule_brand + rule_type + rule_single)::INT AS rule_count,
  (1 - least(rule_name, rule_brand))::INT AS fail,
  least(rule_name + rule_brand + rule_type + rule_single + 1 - least(rule_name, rule_brand), 3)::INT AS capped
FROM ({_RULES_SQL})""")
def rule_flags_and_counts(t: Tables) -> DataFrame:
    summed = summarize_rules(_flagged(t), FLAGS)
    failed = fail_flag(summed, ["rule_name", "rule_brand"], "fail")
    capped = capped_count(failed, ["rule_count", "fail"], "capped", cap=3)
    return capped.select("p_partkey", *FLAGS, "any_rule", "rule_count", "fail", "capped")


@query(f"""
SELECT unnest(['rule_name', 'rule_brand', 'rule_type', 'rule_single']) AS feature,
  unnest([round(avg(rule_name), 6), round(avg(rule_brand), 6), round(avg(rule_type), 6), round(avg(rule_single), 6)]) AS rate
FROM ({_RULES_SQL})""")
def rule_hit_rates(t: Tables) -> DataFrame:
    rates, _ = rule_report(_flagged(t), FLAGS)
    return rates.select("feature", r6("rate").alias("rate"))


@query(f"""
WITH f AS ({_RULES_SQL})
SELECT 'rule_name' AS var_i, 'rule_brand' AS var_j, round(corr(rule_name, rule_brand), 6) AS r FROM f
UNION ALL SELECT 'rule_name', 'rule_type', round(corr(rule_name, rule_type), 6) FROM f
UNION ALL SELECT 'rule_name', 'rule_single', round(corr(rule_name, rule_single), 6) FROM f
UNION ALL SELECT 'rule_brand', 'rule_type', round(corr(rule_brand, rule_type), 6) FROM f
UNION ALL SELECT 'rule_brand', 'rule_single', round(corr(rule_brand, rule_single), 6) FROM f
UNION ALL SELECT 'rule_type', 'rule_single', round(corr(rule_type, rule_single), 6) FROM f""")
def rule_flag_correlation(t: Tables) -> DataFrame:
    _, pairs = rule_report(_flagged(t), FLAGS)
    return pairs.filter("var_i <> var_j").select("var_i", "var_j", r6("r").alias("r"))


@query("""
SELECT lang, sum((contains(upper(text), 'THE') OR contains(upper(text), 'AND'))::INT)::BIGINT AS common,
  sum((contains(upper(text), 'EMAIL') OR contains(upper(text), '@'))::INT)::BIGINT AS contact,
  sum(contains(upper(text), 'LICENSE')::INT)::BIGINT AS legal FROM documents GROUP BY 1""")
def trigger_groups_in_texts(t: Tables) -> DataFrame:
    groups = {"common": ["the", "and"], "contact": ["email", "@"], "legal": ["license"]}
    flagged = group_triggers(t.documents, "text", groups)
    return flagged.groupBy("lang").agg(*[F.sum(g).alias(g) for g in groups])


@query("""
SELECT c_custkey, round((c_acctbal + 1000) / 11000.0, 6) AS balance, round(1 - (c_acctbal + 1000) / 11000.0, 6) AS balance_rev,
  (c_mktsegment = 'BUILDING')::INT AS "segment_BUILDING", (c_mktsegment = 'ABSENT')::INT AS "segment_ABSENT",
  (c_mktsegment IN ('MACHINERY', 'HOUSEHOLD'))::INT AS segment_either FROM customer""")
def encoded_customers(t: Tables) -> DataFrame:
    rows = t.customer.withColumnRenamed("c_mktsegment", "segment")
    scaled = scale_columns(rows, {"balance": ("c_acctbal", -1000, 10000, False), "balance_rev": ("c_acctbal", -1000, 10000, True)})
    hot = one_hot(scaled, {"segment": ["BUILDING", "ABSENT", "MACHINERY", "HOUSEHOLD"]})
    merged = merge_flags(hot, ["segment_MACHINERY", "segment_HOUSEHOLD"], "segment_either")
    return merged.select(
        "c_custkey", r6("balance").alias("balance"), r6("balance_rev").alias("balance_rev"), "segment_BUILDING", "segment_ABSENT", "segment_either"
    )


@query("""
SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS size,
  round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS price FROM part""")
def standardized_parts(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), F.lit(1.0).alias("flat"))
    done = standardize(rows, ["size", "price", "flat"])
    return done.select("p_partkey", r6("size").alias("size"), r6("price").alias("price"))
