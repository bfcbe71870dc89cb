"""Feature selection on correlation matrices.

Row-level work is one Spark pass that builds the D x D matrix; D is the number of
columns, so what follows on the driver is small matrix algebra.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.operators.stats import complete_pearson, complete_spearman, covariance, sscp, to_matrix

_MEASURES = {
    "pearsonr": (complete_pearson, "r"),
    "spearmanr": (complete_spearman, "r"),
    "cov": (covariance, "cov"),
    "sscp": (sscp, "sscp"),
}


@dataclass
class FeatureMatrix:
    names: list[str]
    values: np.ndarray
    dropped: list[str]

    def block(self, left: Sequence[str], right: Sequence[str] | None = None) -> np.ndarray:
        at = {n: i for i, n in enumerate(self.names)}
        return self.values[np.ix_([at[n] for n in left], [at[n] for n in (left if right is None else right)])]


def feature_matrix(
    df: DataFrame, cols: Sequence[str], method: str = "pearsonr", cutoff: float = 1.0, keep: Sequence[str] = ()
) -> FeatureMatrix:
    """Matrix of ``method``; correlation methods drop constant columns and every column
    whose absolute correlation with an earlier one exceeds ``cutoff`` (never ``keep``)."""
    build, measure = _MEASURES[method]
    names = list(cols)
    values = to_matrix(build(df, names), names, measure)
    dropped: list[str] = []
    if measure == "r":
        live = [i for i in range(len(names)) if not np.isnan(values[i, i])]
        dropped = [n for i, n in enumerate(names) if i not in live]
        names, values = [names[i] for i in live], values[np.ix_(live, live)]
        # Rounding can put equal columns a hair above 1.
        close = np.triu(np.abs(values) > cutoff + 1e-12, k=1).any(axis=0)
        near = [n for n, c in zip(names, close) if c and n not in keep]
        left = [i for i, n in enumerate(names) if n not in near]
        dropped, names, values = dropped + near, [names[i] for i in left], values[np.ix_(left, left)]
    return FeatureMatrix(names, values, dropped)


def explained_variance(df: DataFrame, cols: Sequence[str], selected: Sequence[str]) -> DataFrame:
    """``(explained, total, ratio, dropped)``: variance of ``cols`` explained by ``selected``."""
    everything = list(dict.fromkeys([*cols, *selected]))
    matrix = feature_matrix(df, everything, cutoff=float("inf"))
    chosen = [c for c in selected if c in matrix.names]
    across = matrix.block(matrix.names, chosen)
    gain = float(np.trace(across @ np.linalg.pinv(matrix.block(chosen)) @ across.T))
    total = float(len(matrix.names))
    row = (round(gain, 3), total, round(gain / total, 3), sorted(matrix.dropped))
    return df.sparkSession.createDataFrame([row], "explained double, total double, ratio double, dropped array<string>")


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(feature, vif)``: 1 / (1 - R²) of each column on the others, 2 decimals.

    A perfectly determined column counts as R² = 0.999.
    """
    matrix = feature_matrix(df, cols, cutoff=float("inf"))
    rows = []
    for name in matrix.names:
        others = [n for n in matrix.names if n != name]
        r2 = 0.0
        if others:
            link = matrix.block([name], others)
            r2 = float((link @ np.linalg.pinv(matrix.block(others)) @ link.T)[0, 0])
        r2 = 0.999 if r2 >= 1 - 1e-12 else r2
        rows.append((name, round(1 / (1 - r2), 2)))
    return df.sparkSession.createDataFrame(rows, "feature string, vif double")


def encode_target(df: DataFrame, target: str) -> tuple[DataFrame, list[str]]:
    """Replace a class column by one centred indicator per class, in class order."""
    counts = {r[0]: r[1] for r in df.filter(F.col(target).isNotNull()).groupBy(target).count().collect()}
    total = float(sum(counts.values()))
    added = {}
    for i, value in enumerate(sorted(counts)):
        share = counts[value] / total
        inside, outside = (1 / share**0.5 - share**0.5) / total**0.5, -(share**0.5) / total**0.5
        added[f"{target}_{i}"] = F.when(F.col(target) == F.lit(value), inside).otherwise(outside)
    return df.withColumns(added).drop(target), list(added)


def _forward(
    matrix: FeatureMatrix, targets: Sequence[str], varexp: float, maxeffects: int, tol: float
) -> list[tuple[int, str, float]]:
    """Add the feature that leaves the least variance of ``targets`` unexplained.

    After each pick the matrix is reduced to what the picked features do not explain,
    so one step scores every candidate at once.
    """
    names, left = matrix.names, matrix.values.copy()
    goal = np.array([n in targets for n in names]) if targets else np.ones(len(names), bool)
    open_ = ~goal if targets else goal.copy()
    total = float(np.trace(left[np.ix_(goal, goal)]))
    floor = 1e-10 * np.abs(np.diag(left)).max()
    picked: list[tuple[int, str, float]] = []
    while open_.any():
        spread = np.diag(left)
        usable = spread > floor
        gain = np.where(usable, (left[goal] ** 2).sum(axis=0) / np.where(usable, spread, 1.0), 0.0)
        best = int(np.argmax(np.where(open_, gain, -np.inf)))
        score = 1.0 - (float(spread[goal].sum()) - gain[best]) / total
        if usable[best]:
            left -= np.outer(left[:, best], left[best]) / spread[best]
        open_[best] = False
        before = picked[-1][2] if picked else None
        picked.append((len(picked) + 1, names[best], score))
        # The limits apply from the second feature on.
        if before is not None and (score >= varexp or len(picked) >= maxeffects or score - before <= tol):
            break
    return picked


def _selection_frame(df: DataFrame, picked: list[tuple[int, str, float]]) -> DataFrame:
    rows = [(step, name, float(np.around(score, 4))) for step, name, score in picked]
    return df.sparkSession.createDataFrame(rows, "step int, feature string, var_exp double")


def select_unsupervised(
    df: DataFrame,
    cols: Sequence[str],
    varexp: float = 0.95,
    maxeffects: int = 200,
    tol: float = 0.001,
    method: str = "pearsonr",
    cutoff: float = 1.0,
) -> DataFrame:
    """``(step, feature, var_exp)``: features that preserve most of the variance of all."""
    matrix = feature_matrix(df, cols, method, cutoff)
    return _selection_frame(df, _forward(matrix, [], varexp, maxeffects, tol))


def select_supervised(
    df: DataFrame,
    cols: Sequence[str],
    target: str,
    target_type: str = "Class",
    varexp: float = 0.95,
    maxeffects: int = 200,
    tol: float = 0.001,
    method: str = "pearsonr",
    cutoff: float = 1.0,
) -> DataFrame:
    """``(step, feature, var_exp)``: features that explain most of the target."""
    if target_type in ("Binary", "Class"):
        rows, targets = encode_target(df.select(*cols, target), target)
    else:
        rows, targets = df, [target]
    matrix = feature_matrix(rows, [*cols, *targets], method, cutoff, keep=targets)
    return _selection_frame(df, _forward(matrix, targets, varexp, maxeffects, tol))


def _split(matrix: FeatureMatrix, names: list[str], maxeigen: float) -> list[list[str]]:
    """Halve a group by its two leading directions while the second one is strong."""
    done, todo = [], [names]
    while todo:
        group = todo.pop()
        if len(group) < 2:
            done.append(group)
            continue
        directions, strength, _ = np.linalg.svd(matrix.block(group))
        second = np.abs(directions[:, 1]) > np.abs(directions[:, 0])
        if strength[1] <= maxeigen or second.all() or not second.any():
            done.append(group)
            continue
        halves = ([n for n, s in zip(group, second) if not s], [n for n, s in zip(group, second) if s])
        todo += [halves[1], halves[0]]
    return done


def feature_clusters(df: DataFrame, cols: Sequence[str], maxeigen: float = 0.7) -> DataFrame:
    """``(feature, cluster)``: correlated features grouped by recursive two-way splits."""
    matrix = feature_matrix(df, cols, cutoff=float("inf"))
    rows = [(n, i) for i, group in enumerate(_split(matrix, matrix.names, maxeigen)) for n in group]
    return df.sparkSession.createDataFrame(rows, "feature string, cluster int")


def feature_cluster_report(
    df: DataFrame, cols: Sequence[str], maxeigen: float = 0.7, method: str = "r-square_ratio"
) -> DataFrame:
    """How well each feature stands for its cluster, and which one does best (``chosen``).

    All four methods follow from the correlation matrix of standardised columns:
    ``correlation`` (sum of absolute correlations, greatest wins), ``r-square_ratio``
    ((1 - R² own) / (1 - R² nearest), least wins), ``centroid`` and ``closest_to_PCA``
    (distance of the column to the cluster mean or first component, least wins).
    """
    rows = df.na.drop("any", subset=list(cols))
    matrix = feature_matrix(rows, cols, cutoff=float("inf"))
    n = rows.count()
    groups = _split(matrix, matrix.names, maxeigen)
    axes = []
    for group in groups:
        strength, directions = np.linalg.eigh(matrix.block(group))
        axis = directions[:, -1]
        axis = axis * np.sign(axis[np.argmax(np.abs(axis))])  # the sign is free; pin it
        axes.append((axis, float(strength[-1])))

    def shared(p: int, q: int) -> float:
        return float(axes[p][0] @ matrix.block(groups[p], groups[q]) @ axes[q][0])

    nearest = []
    for p in range(len(groups)):
        apart = [np.inf if p == q else axes[p][1] + axes[q][1] - 2 * shared(p, q) for q in range(len(groups))]
        nearest.append(int(np.argmin(apart)) if len(groups) > 1 else None)

    def r2(name: str, c: int) -> float:
        axis, strength = axes[c]
        return float((matrix.block([name], groups[c]) @ axis)[0] ** 2 / strength)

    out = []
    for c, group in enumerate(groups):
        inner = matrix.block(group)
        axis, strength = axes[c]
        near = nearest[c]
        extra = [(None, None, None)] * len(group)
        if method == "correlation":
            score = np.abs(inner).sum(axis=1) - 1
        elif method == "centroid":
            score = np.sqrt(n * np.maximum(1 - 2 * inner.mean(axis=1) + inner.mean(), 0))
        elif method == "closest_to_PCA":
            score = np.sqrt(n * np.maximum(1 + strength - 2 * inner @ axis, 0))
        else:
            own = [r2(name, c) for name in group]
            other = [r2(name, near) if near is not None else 0.0 for name in group]
            gap = [1 - o if o < 1 - 1e-12 else 1 - 0.99999999999 for o in other]
            score = np.array([round((1 - a) / g, 2) for a, g in zip(own, gap)])
            extra = [(round(a, 2), near, round(o, 2)) for a, o in zip(own, other)]
        best = int(np.argmax(score) if method == "correlation" else np.argmin(score))
        for i, name in enumerate(group):
            out.append((c, name, float(score[i]), *extra[i], i == best))
    schema = "cluster int, feature string, score double, r2_own double, next_closest int, r2_nc double, chosen boolean"
    return df.sparkSession.createDataFrame(out, schema)
