"""Every registered query runs; those with SQL give the same rows as DuckDB."""

from __future__ import annotations

import re

import numpy as np
import pytest
from oracle import SMALL, compare, connect

import __spark_entry__ as entry

# Too few rows at this size to find anything.
MAY_BE_EMPTY = {"conditional_totals_of_large_customers", "reasons_of_forced_closures"}


# Queries whose work needs NumPy inside the tasks; all others must stay native.
PYTHON = {
    "intercept_only_models",
    "label_centre_distortion",
    "label_silhouette",
    "label_silhouette_of_squares",
    "nearest_label_centre",
    "pearson_of_embedding_columns",
}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(df))
    if name not in PYTHON:
        assert not re.search("Python|Pandas|ArrowEval", plan(df))
    note = compare(df, entry.oracle_sql()[name], duck)
    if name in MAY_BE_EMPTY and note == "both empty":
        note = None
    assert note is None, note


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs_and_returns_rows(spark, name):
    assert entry.queries()[name](spark, SMALL).limit(1).count() == 1


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_learned_queries_use_every_vector_column(spark, tmp_path):
    """Only column 40 tells the labels apart; the first eight say nothing."""
    draw = np.random.default_rng(4)
    rows = []
    for i in range(240):
        x = draw.normal(1, 0.05, 64)
        x[40] += 5.0 * (i % 10 > 4)
        rows.append((i, i % 10, [float(v) for v in x]))
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    profile = entry.queries()["learned_cluster_profile"](spark, str(tmp_path)).collect()
    assert "e40" in {r.drivers[0].feature for r in profile}
    scores = entry.queries()["learned_linear_scores"](spark, str(tmp_path)).collect()
    mean = {bad: np.mean([r.bad_score for r in scores if r.bad == bad]) for bad in (0, 1)}
    assert mean[1] > mean[0] + 300
    auc = entry.queries()["learned_beta_auc"](spark, str(tmp_path)).first()
    assert auc.auc > 0.95
