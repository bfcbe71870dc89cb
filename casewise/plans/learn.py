"""Cluster the history, fit per-cluster models, score new rows, evaluate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from casewise.operators.bandit import arm_counts, beta_posterior, beta_ts, fit_logit_by_group, lin_ts
from casewise.operators.clusters import assign, centers_of, cluster_profile, fit_kmeans
from casewise.operators.evaluate import auc_by_reward


def score_beta(
    train: DataFrame, test: DataFrame, cluster: str, arm: str, key: str, rewards: Mapping[str, Sequence[str]], draws: int = 10, seed: int = 42
) -> DataFrame:
    """Beta Thompson scores of ``test`` from the counts of ``train``."""
    posterior = beta_posterior(arm_counts(train, cluster, arm, rewards), cluster, list(rewards))
    return beta_ts(test, posterior, cluster, key, list(rewards), draws, seed)


def score_lin(
    train: DataFrame,
    test: DataFrame,
    cluster: str,
    arm: str,
    key: str,
    xs: Sequence[str],
    rewards: Mapping[str, Sequence[str]],
    draws: int = 10,
    seed: int = 42,
) -> DataFrame:
    """Linear Thompson scores of ``test`` from per-cluster logistic models of ``train``."""
    models = fit_logit_by_group(train, cluster, arm, xs, rewards)
    return lin_ts(test, models, cluster, key, xs, list(rewards), draws, seed)


def score_table(scored: DataFrame, key: str, cluster: str, arm: str, rewards: Sequence[str], decision: str = "decision") -> DataFrame:
    """Scores next to the actual decision, outcome and rewards."""
    return scored.select(key, cluster, *[f"{r}_score" for r in rewards], decision, arm, *rewards)


def learn_and_score(
    train: DataFrame,
    test: DataFrame,
    cols: Sequence[str],
    arm: str,
    key: str,
    rewards: Mapping[str, Sequence[str]],
    review_arms: Sequence[str],
    approved_arms: Sequence[str],
    k: int = 200,
    restarts: int = 10,
    method: str = "lin",
    draws: int = 10,
    seed: int = 42,
) -> dict[str, DataFrame]:
    """Cluster profile, score table and AUC per reward for ``lin`` or ``beta`` scoring."""
    centers = centers_of(fit_kmeans(train, cols, k, restarts, seed=seed))
    near_train, near_test = assign(train, cols, centers), assign(test, cols, centers)
    if method == "lin":
        scored = score_lin(near_train, near_test, "cluster", arm, key, cols, rewards, draws, seed)
    else:
        scored = score_beta(near_train, near_test, "cluster", arm, key, rewards, draws, seed)
    return {
        "profile": cluster_profile(near_train, "cluster", arm, review_arms, approved_arms, cols),
        "scores": score_table(scored, key, "cluster", arm, list(rewards)),
        "auc": auc_by_reward(scored, arm, rewards),
    }
