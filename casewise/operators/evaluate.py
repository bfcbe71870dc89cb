"""ROC curves and AUC."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.operators.ordered import running_totals, slice_edges


def _by_score(df: DataFrame, label: str, score: str, **options) -> DataFrame:
    rows = df.select(F.col(score).cast("double").alias("threshold"), F.col(label).cast("int").alias("y")).na.drop("any")
    edges = slice_edges(rows, ["threshold"], **options)
    sums = {"pos": F.sum("y"), "neg": F.sum(1 - F.col("y"))}
    return running_totals(rows, "threshold", sums, edges, descending=True)


def roc(df: DataFrame, label: str, score: str, **options) -> DataFrame:
    """``(threshold, fpr, tpr)``, one point per distinct score plus the origin (threshold inf).

    A rate is NULL if the label has one class only.
    """
    steps = _by_score(df, label, score, **options)
    total = steps.agg(F.struct(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))).scalar()
    points = steps.select(
        "threshold",
        F.try_divide(F.col("cum_neg"), total.getField("neg")).alias("fpr"),
        F.try_divide(F.col("cum_pos"), total.getField("pos")).alias("tpr"),
    )
    origin = df.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return origin.unionByName(points)


def auc(df: DataFrame, label: str, score: str, **options) -> DataFrame:
    """``(rows, positives, auc)``: area under the ROC curve, ties counted as one half."""
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2))
    pos, neg = F.sum("pos"), F.sum("neg")
    return _by_score(df, label, score, **options).agg(
        (pos + neg).alias("rows"), pos.alias("positives"), F.try_divide(area, (pos * neg).cast("double")).alias("auc")
    )


def auc_by_reward(df: DataFrame, arm: str, rewards: Mapping[str, Sequence[str]], **options) -> DataFrame:
    """One AUC per reward against ``<reward>_score``, each on its own arms."""
    out = None
    for reward, arms in rewards.items():
        part = auc(df.filter(F.col(arm).isin(list(arms))), reward, f"{reward}_score", **options)
        part = part.select(F.lit(reward).alias("reward"), "rows", "positives", "auc")
        out = part if out is None else out.unionByName(part)
    return out
