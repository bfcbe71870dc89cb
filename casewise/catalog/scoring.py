"""Reward counts, posteriors, Thompson scores, ROC and AUC."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.catalog.matrices import EMBEDDED, _embedded
from casewise.catalog.registry import Tables, query, r6
from casewise.operators.bandit import arm_counts, beta_posterior, beta_ts, fit_logit_by_group, lin_mean_score, lin_ts
from casewise.operators.evaluate import auc, auc_by_reward, roc
from casewise.operators.stats import spearman
from casewise.plans.learn import learn_and_score

_ROWS = """
SELECT o_orderkey, c_nationkey AS cluster, o_orderstatus AS arm, o_orderstatus AS decision,
  (o_orderpriority = '1-URGENT' OR (c_acctbal < 1000 AND o_totalprice > 200000))::INT AS urgent, (o_totalprice > 300000)::INT AS large,
  (c_acctbal + 1000) / 11000 AS balance, o_totalprice / 500000 AS price
FROM orders JOIN customer ON o_custkey = c_custkey"""
REWARDS = {"urgent": ["F", "P"], "large": ["O", "P"]}
XS = ["balance", "price"]


def _rows(t: Tables) -> DataFrame:
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    poor = (F.col("c_acctbal") < 1000) & (F.col("o_totalprice") > 200000)
    return joined.select(
        "o_orderkey",
        F.col("c_nationkey").alias("cluster"),
        F.col("o_orderstatus").alias("arm"),
        F.col("o_orderstatus").alias("decision"),
        ((F.col("o_orderpriority") == "1-URGENT") | poor).cast("int").alias("urgent"),
        (F.col("o_totalprice") > 300000).cast("int").alias("large"),
        ((F.col("c_acctbal") + 1000) / 11000).alias("balance"),
        (F.col("o_totalprice") / 500000).alias("price"),
    )


_COUNTS = f"""
SELECT cluster, sum(urgent) FILTER (WHERE arm IN ('F', 'P'))::BIGINT AS urgent_success,
  (count(*) FILTER (WHERE arm IN ('F', 'P')) - sum(urgent) FILTER (WHERE arm IN ('F', 'P')))::BIGINT AS urgent_failure,
  sum(large) FILTER (WHERE arm IN ('O', 'P'))::BIGINT AS large_success,
  (count(*) FILTER (WHERE arm IN ('O', 'P')) - sum(large) FILTER (WHERE arm IN ('O', 'P')))::BIGINT AS large_failure
FROM ({_ROWS}) GROUP BY 1"""


@query(_COUNTS)
def reward_counts_by_cluster(t: Tables) -> DataFrame:
    return arm_counts(_rows(t), "cluster", "arm", REWARDS)


@query(f"""
SELECT cluster, urgent_success + 1 AS urgent_alpha, urgent_failure + 1 AS urgent_beta,
  round((urgent_success + 1) / (urgent_success + urgent_failure + 2), 6) AS urgent_mean,
  round((large_success + 1) * (large_failure + 1) / ((large_success + large_failure + 2) ** 2 * (large_success + large_failure + 3)), 8) AS large_var
FROM ({_COUNTS})""")
def beta_posteriors(t: Tables) -> DataFrame:
    posterior = beta_posterior(arm_counts(_rows(t), "cluster", "arm", REWARDS), "cluster", list(REWARDS))
    return posterior.select(
        "cluster", "urgent_alpha", "urgent_beta", r6("urgent_mean").alias("urgent_mean"), F.round("large_var", 8).alias("large_var")
    )


@query()
def beta_thompson_scores(t: Tables) -> DataFrame:
    rows = _rows(t)
    posterior = beta_posterior(arm_counts(rows, "cluster", "arm", REWARDS), "cluster", list(REWARDS))
    return beta_ts(rows, posterior, "cluster", "o_orderkey", list(REWARDS))


# Newton steps of an intercept alone, with the same stop rule.
@query(f"""
WITH RECURSIVE k AS ({_COUNTS}),
c AS (SELECT cluster, 'urgent' AS reward, coalesce(urgent_success, 0) AS s, coalesce(urgent_failure, 0) AS f FROM k
      UNION ALL SELECT cluster, 'large', coalesce(large_success, 0), coalesce(large_failure, 0) FROM k),
fit AS (
  SELECT *, 0 AS step, 0.0::DOUBLE AS b, NULL::DOUBLE AS l0, NULL::DOUBLE AS l1, NULL::DOUBLE AS l2 FROM c
  UNION ALL
  SELECT cluster, reward, s, f, step + 1, nb, l1, l2, -s * ln(least(greatest(1 / (1 + exp(-nb)), 1e-10), 1 - 1e-10))
  FROM (SELECT *, b - ((s + f) * p - s) / ((s + f) * p * (1 - p) + 0.001) AS nb FROM (SELECT *, 1 / (1 + exp(-b)) AS p FROM fit))
  WHERE step < 100 AND NOT (step >= 3 AND l1 - l2 < 1e-4 AND l0 - l1 < 1e-4))
SELECT cluster, reward, s AS success, f AS failure, round(b, 6) + 0.0 AS intercept FROM fit
QUALIFY row_number() OVER (PARTITION BY cluster, reward ORDER BY step DESC) = 1""")
def intercept_only_models(t: Tables) -> DataFrame:
    models = fit_logit_by_group(_rows(t), "cluster", "arm", [], REWARDS)
    return models.select("cluster", "reward", "success", "failure", r6(F.get("beta", F.lit(0))).alias("intercept"))


@query()
def logistic_models_by_cluster(t: Tables) -> DataFrame:
    return fit_logit_by_group(_rows(t), "cluster", "arm", XS, REWARDS).select(
        "cluster", "reward", "success", "failure", "beta", "steps", "converged", "loss"
    )


@query(f"""
WITH r AS ({_ROWS}), b AS (SELECT cluster, avg(urgent) AS b0, avg(balance) AS b1, avg(price) AS b2 FROM r GROUP BY 1)
SELECT o_orderkey, round(b0 + b1 * balance + b2 * price, 6) AS odds FROM r JOIN b USING (cluster)""")
def mean_log_odds_of_given_models(t: Tables) -> DataFrame:
    rows = _rows(t)
    given = rows.groupBy("cluster").agg(F.array(F.avg("urgent"), F.avg("balance"), F.avg("price")).alias("beta"))
    models = given.withColumn("reward", F.lit("urgent"))
    return lin_mean_score(rows, models, "cluster", XS, "urgent", "odds").select("o_orderkey", r6("odds").alias("odds"))


@query()
def linear_thompson_scores(t: Tables) -> DataFrame:
    rows = _rows(t)
    models = fit_logit_by_group(rows, "cluster", "arm", XS, REWARDS)
    return lin_ts(rows, models, "cluster", "o_orderkey", XS, list(REWARDS))


_TOXIC = "SELECT doc_id, toxic, round(n_chars / 50.0) AS score, n_chars FROM documents JOIN labels USING (doc_id)"


def _toxic(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id").withColumn("score", F.round(F.col("n_chars") / 50.0))


@query(f"""
WITH s AS (SELECT score, sum(toxic) AS pos, sum(1 - toxic) AS neg FROM ({_TOXIC}) GROUP BY 1)
SELECT score::DOUBLE AS threshold, round(sum(neg) OVER w / sum(neg) OVER (), 6) AS fpr, round(sum(pos) OVER w / sum(pos) OVER (), 6) AS tpr
FROM s WINDOW w AS (ORDER BY score DESC) UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0""")
def roc_points(t: Tables) -> DataFrame:
    return roc(_toxic(t), "toxic", "score").select("threshold", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@query(f"""
WITH r AS (SELECT toxic, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM ({_TOXIC}))
SELECT count(*)::BIGINT AS rows, sum(toxic)::BIGINT AS positives,
  round((sum(rk * toxic) - sum(toxic) * (sum(toxic) + 1) / 2) / (sum(toxic) * sum(1 - toxic)), 6) AS auc FROM r""")
def area_under_roc(t: Tables) -> DataFrame:
    return auc(_toxic(t), "toxic", "score").select("rows", "positives", r6("auc").alias("auc"))


def _reward_auc_sql(reward: str, score: str, arms: str) -> str:
    return f"""
SELECT '{reward}' AS reward, count(*)::BIGINT AS rows, sum(y)::BIGINT AS positives,
  round((sum(rk * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS auc
FROM (SELECT {reward} AS y, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0 AS rk
      FROM ({_ROWS}) WHERE arm IN ({arms}))"""


@query(_reward_auc_sql("urgent", "round(balance * 1000)", "'F', 'P'") + " UNION ALL " + _reward_auc_sql("large", "round((balance + price) * 500)", "'O', 'P'"))
def area_under_roc_by_reward(t: Tables) -> DataFrame:
    scored = _rows(t).withColumns(
        {"urgent_score": F.round(F.col("balance") * 1000), "large_score": F.round((F.col("balance") + F.col("price")) * 500)}
    )
    return auc_by_reward(scored, "arm", REWARDS).select("reward", "rows", "positives", r6("auc").alias("auc"))


@query(f"""
WITH s AS (SELECT round(balance * 100) AS a, round((balance + price) * 50) AS b FROM ({_ROWS})),
r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS a, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS b FROM s)
SELECT 'a' AS var_i, 'b' AS var_j, round(corr(a, b), 6) AS r FROM r""")
def rank_correlation_of_scores(t: Tables) -> DataFrame:
    scores = _rows(t).select(F.round(F.col("balance") * 100).alias("a"), F.round((F.col("balance") + F.col("price")) * 50).alias("b"))
    return spearman(scores, ["a", "b"]).filter("var_i <> var_j").select("var_i", "var_j", r6("r").alias("r"))


def _learned(t: Tables, method: str, table: str) -> DataFrame:
    """Embeddings as cases: cluster, fit, score and evaluate on the same rows, over all vector columns."""
    rows = _embedded(t).withColumns(
        {
            "arm": F.when(F.col("label") % 3 == 0, "mkyc_rejected").when(F.col("label") % 3 == 1, "mkyc_approved").otherwise("auto_approved"),
            "decision": F.lit("mkyc"),
            "bad": (F.col("label") > 4).cast("int"),
        }
    )
    found = learn_and_score(
        rows, rows, EMBEDDED, "arm", "vec_id", {"bad": ["mkyc_approved", "auto_approved"]},
        ["mkyc_approved", "mkyc_rejected"], ["mkyc_approved", "auto_approved"], k=6, restarts=2, method=method,
    )
    return found[table]


@query()
def learned_linear_scores(t: Tables) -> DataFrame:
    return _learned(t, "lin", "scores")


@query()
def learned_beta_auc(t: Tables) -> DataFrame:
    return _learned(t, "beta", "auc")


@query()
def learned_cluster_profile(t: Tables) -> DataFrame:
    return _learned(t, "beta", "profile")
