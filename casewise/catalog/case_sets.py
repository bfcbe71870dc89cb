"""Base and encoded sets of the stand-in cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.catalog import standins as s
from casewise.catalog.case_labels import _BY_CODE, FRAUD_SQL, fraud, spine
from casewise.catalog.registry import Tables, query, r6
from casewise.plans.encoded import add_fraud, base_sets, encoded_sets

_LABELLED = f"""
spine AS ({_BY_CODE}), {FRAUD_SQL},
labelled AS (SELECT s.*, coalesce(is_app_fraud, 0) AS is_app_fraud, greatest(coalesce(app_fraud_amount, 0), 0) AS amount
             FROM spine s LEFT JOIN fraud_labels f USING (entity_id)),
features AS (SELECT (c_custkey + 1000)::VARCHAR AS entity_id, (DATE '1995-06-01' + (c_custkey * 7 % 1800)::INT) AS made,
               (c_custkey % 80 + 10) AS age, c_mktsegment AS segment FROM customer WHERE c_custkey % 5 <> 0),
edge AS (SELECT DATE '1998-12-31' - 90 AS day)"""


def _features(t: Tables) -> DataFrame:
    c = F.col("c_custkey")
    return t.customer.filter(c % 5 != 0).select(
        (c + 1000).cast("string").alias("entity_id"),
        F.date_add(F.lit("1995-06-01").cast("date"), (c * 7 % 1800).cast("int")).alias("company_created_on"),
        (c % 80 + 10).alias("age_at_completion"),
        F.col("c_mktsegment").alias("segment"),
    )


@query(f"""
WITH {_LABELLED},
train AS (SELECT entity_id, decision, is_sar90, is_app_fraud, amount, age, segment FROM labelled JOIN features USING (entity_id), edge
          WHERE created::DATE <= edge.day AND made <= edge.day AND age >= 18),
test AS (SELECT entity_id, coalesce(decision, 'mkyc') AS decision, is_sar90, is_app_fraud, amount, age, segment
         FROM (SELECT * FROM features, edge WHERE made > edge.day) LEFT JOIN (SELECT labelled.* FROM labelled, edge WHERE created::DATE > edge.day) USING (entity_id)),
both_ AS (SELECT 'train' AS part, * FROM train UNION ALL SELECT 'test', * FROM test)
SELECT part, entity_id, decision, is_sar90::INT AS is_sar90, is_app_fraud::INT AS is_app_fraud, round(amount, 2) AS amount,
  round(1 - (age - 18) / 82.0, 6) AS age_rev, (segment IN ('BUILDING', 'MACHINERY'))::INT AS segment_core, (segment = 'HOUSEHOLD')::INT AS "segment_HOUSEHOLD"
FROM both_""")
def encoded_train_and_test(t: Tables) -> DataFrame:
    labels = add_fraud(spine(t), fraud(t)).persist()  # read for both sets
    train, test = base_sets(labels, _features(t), "company_created_on", s.HI)
    train, test = encoded_sets(
        train,
        test,
        least={"age_at_completion": 18},
        scales={"age_rev": ("age_at_completion", 18, 100, True)},
        levels={"segment": ["BUILDING", "MACHINERY", "HOUSEHOLD"]},
        merged={"segment_core": ["segment_BUILDING", "segment_MACHINERY"]},
    )
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")), allowMissingColumns=True)
    return both.select(
        "part",
        "entity_id",
        "decision",
        "is_sar90",
        "is_app_fraud",
        F.round("app_fraud_amount", 2).alias("amount"),
        r6("age_rev").alias("age_rev"),
        "segment_core",
        "segment_HOUSEHOLD",
    )
