"""The ways taken for large inputs give the same rows as those for small ones; filters
reach the scan; sources and sinks keep what they are given."""

from __future__ import annotations

import datetime
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewise.operators import evaluate, ordered, stats
from casewise.sources import read_csv, read_parquet, read_range, load_model, save_model, write_csv, write_parquet

COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@pytest.fixture(scope="module")
def lines(table):
    # A third of all rows share one price.
    price = F.when(F.col("l_orderkey") % 3 == 0, 5.0).otherwise(F.col("l_extendedprice"))
    return table("lineitem").withColumn("l_extendedprice", price).cache()


def matrix(pairs, cols=COLS):
    return stats.to_matrix(pairs, cols)


def test_sliced_ranks_equal_plain_ranks(lines):
    plain = matrix(stats.spearman(lines, COLS))
    assert np.allclose(plain, matrix(stats.spearman(lines, COLS, one_task=100, slices=9)))
    assert np.allclose(plain, lines.select(COLS).toPandas().corr("spearman").to_numpy())


def test_quantiles_are_exact(spark, lines, monkeypatch):
    probs = [0, 0.01, 0.2, 0.5, 0.77, 1]
    pandas = lines.select(COLS).toPandas().quantile(probs)
    want = {c: pytest.approx(list(pandas[c])) for c in COLS}
    assert ordered.quantile_table(lines, COLS, probs) == want
    assert ordered.quantile_table(lines, COLS, probs, one_task=100) == want
    # Brackets that miss must be noticed.
    monkeypatch.setattr(ordered, "_brackets", lambda *a: [(1.5, 2.5), (4.5, 5.5), (20000.0, 20001.0)])
    assert ordered.quantile_table(lines, COLS, probs) == want


@pytest.mark.parametrize("n", [1, 2, 5, 99, 100, 101, 1000, 60_000])
def test_quantiles_of_any_size(spark, n):
    probs = [0, 0.001, 0.25, 1 / 3, 0.5, 0.9, 0.999, 1]
    df = spark.range(n).select(F.xxhash64("id").cast("double").alias("x"), (F.col("id") % 7).alias("k"), F.lit(None).cast("double").alias("none"))
    got = ordered.quantile_table(df, ["x", "k", "none"], probs)
    pandas = df.select("x", "k").toPandas().quantile(probs)
    assert got["none"] == []
    for c in ("x", "k"):
        assert got[c] == pytest.approx(list(pandas[c]))


def test_sliced_roc_equals_plain_roc(lines):
    rows = lines.withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    plain = evaluate.roc(rows, "y", "l_extendedprice").toPandas().sort_values("threshold").to_numpy()
    cut = evaluate.roc(rows, "y", "l_extendedprice", one_task=100, slices=5).toPandas().sort_values("threshold").to_numpy()
    assert np.allclose(plain[:-1], cut[:-1])


@pytest.mark.parametrize("build, measure", [(stats.pearson, "r"), (stats.covariance, "cov"), (stats.sscp, "sscp")])
def test_block_sums_equal_native(lines, monkeypatch, build, measure):
    native = stats.to_matrix(build(lines, COLS), COLS, measure)
    monkeypatch.setattr(stats, "NATIVE_COLUMNS", 1)
    assert np.allclose(native, stats.to_matrix(build(lines, COLS), COLS, measure))
    assert np.allclose(matrix(stats.spearman(lines, COLS)), lines.select(COLS).toPandas().corr("spearman").to_numpy())


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_time_filters_reach_the_scan(spark, table):
    from datetime import datetime

    text = plan(read_range(table("events"), "ts", datetime(2024, 1, 8), datetime(2024, 1, 15)).select("event_id"))
    assert "GreaterThanOrEqual(ts" in text and "LessThan(ts" in text
    assert re.search(r"ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>", text)


def test_day_filters_reach_the_scan(spark, table):
    from casewise.functions import on_days
    from casewise.operators.temporal import time_split

    orders = table("orders").select("o_orderkey", "o_orderdate")
    train, test = time_split(orders, "o_orderdate", "2000-12-31", 90)
    assert "LessThan(o_orderdate" in plan(train) and "GreaterThanOrEqual(o_orderdate" in plan(test)
    days = plan(orders.filter(on_days("o_orderdate", "1996-01-01", "1996-12-31")))
    assert "GreaterThanOrEqual(o_orderdate" in days and "LessThan(o_orderdate" in days


def test_parquet_csv_and_model_round_trips(spark, table, tmp_path):
    nation = table("nation")
    write_parquet(nation, str(tmp_path / "n"), ["n_regionkey"])
    assert read_parquet(spark, str(tmp_path / "n")).count() == 25
    ids = spark.createDataFrame([("00123", 1.5), ("7", None)], "entity_id string, x double")
    write_csv(ids, str(tmp_path / "c"))
    back = read_csv(spark, str(tmp_path / "c"), "entity_id string, x double")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, ids.collect()))

    from casewise.operators.clusters import centers_of, fit_kmeans

    model = fit_kmeans(table("customer"), ["c_acctbal"], 3, restarts=1, max_iter=5)
    save_model(model, str(tmp_path / "m"))
    assert centers_of(load_model(spark, str(tmp_path / "m"))) == centers_of(model)
    save_model(ids, str(tmp_path / "t"))
    assert load_model(spark, str(tmp_path / "t"), "table").count() == 2


def test_query_parameters_and_column_names(spark, table):
    from casewise.sources import normalize_columns, read_query, rows_to_frame

    spine = rows_to_frame(spark, [("1", 5)], "entity_id string, n int")
    got = read_query(spark, "SELECT n + :more AS N_ FROM {spine}", {"more": 2}, {"spine": spine})
    assert got.first()[0] == 7 and normalize_columns(got).columns == ["n_"]
    assert normalize_columns(spine.toDF("svc__A", "svc__B"), "__").columns == ["a", "b"]
    with pytest.raises(ValueError):
        normalize_columns(spine.toDF("x.a", "y.A"))


def test_rows_without_a_key_are_spread_by_the_left_join(spark):
    from casewise.operators.frames import left_join_spread

    left = spark.createDataFrame([(i, None if i % 10 else i) for i in range(4000)] + [(4000, 0)], "id long, k long")
    right = spark.createDataFrame([(0, "a"), (10, "b"), (10, "c"), (None, "d")], "r long, v string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = left_join_spread(left, right, "k", "r")
        sizes = joined.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
        assert sum(sizes) == 4002 and max(sizes) < 1500
        plain = left.join(right, left["k"] == right["r"], "left")
        assert joined.columns == plain.columns and joined.exceptAll(plain).isEmpty() and plain.exceptAll(joined).isEmpty()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_equal_registry_documents_join_once(spark):
    from casewise.plans.features import registry_enrich

    entities = spark.createDataFrame([(f"e{i}", f"m{i}", "2000-01-02", "7" if i else None) for i in range(3)], "entity_id string, member_id string, created_at string, registry_no string").withColumn("created_at", F.col("created_at").cast("date"))
    members = spark.createDataFrame([(f"m{i}", 1) for i in range(3)], "member_id string, is_completed int")
    doc = '{{"data": {{"companyNumber": "7", "address": {{"postcode": "P{}"}}, "directorsTree": [{{"officerId": "{}"}}]}}, "metadata": {{"created_at": "2000-01-01 00:00:00"}}}}'
    registry = spark.createDataFrame([(doc.format(i % 2, i),) for i in range(50)], "json_col string")
    every = registry_enrich(entities, members, registry, "2000-01-01", "2000-12-31")
    some = registry_enrich(entities, members, registry, "2000-01-01", "2000-12-31", ["company_postcode"])
    assert every.count() == 101 and some.count() == 5
    names = ["entity_id", "registry_no", "registry_hit", "company_postcode"]
    assert sorted(map(str, every.select(names).distinct().collect())) == sorted(map(str, some.select(names).collect()))


def test_officers_are_read_before_entities_meet_documents(spark):
    from casewise.plans.features import applicants, graded_people, people_enrich, registry_enrich

    def doc(number, officers):
        people = [
            {"officerId": str(i), "person": {"firstName": first, "lastName": "Lee", "dateOfBirth": born, "nationalities": nations}}
            for i, (first, born, nations) in enumerate(officers)
        ]
        data = {"companyNumber": number, "address": {}, "structureLevelWise": {"1": "2"}, "directorsTree": json.dumps(people)}
        return (json.dumps({"data": data, "metadata": {"created_at": "2020-01-01 00:00:00"}}),)

    day = datetime.date(2000, 5, 5)
    entities = spark.createDataFrame([("e1", "m1", day, "1"), ("e1", "m1", day, "1"), ("e2", "m2", day, None), ("e3", "m3", day, "2")], "entity_id string, member_id string, created_at date, registry_no string")
    members = spark.createDataFrame([("m1", 1), ("m2", 1), ("m3", 1)], "member_id string, is_completed int")
    registry = spark.createDataFrame(
        [doc("1", [("Ann", "1960-04-03", ["A", "B"])]), doc("1", [("Ann", "1960-04-20", ["A", "B"])]), doc("1", [("Bob", "1960-04-03", ["A"]), ("Ann", "1970-01-01", ["B"])]), doc("2", []), doc("2", [("Ann", "x", ["A"])])],
        "json_col string",
    )
    documents = spark.createDataFrame([("e1", day, "Ann", "Lee", datetime.date(1960, 4, 9)), ("e1", day, "Bo", "Lu", None), ("e2", day, "Ann", "Lee", None), ("e3", day, "A", "B", datetime.date(1980, 1, 1))], "entity_id string, created_at date, id_first_name string, id_last_name string, date_of_birth date")
    countries = spark.createDataFrame([("A", "Low"), ("B", "High")], "code string, level string")
    range_ = ("2000-01-01", "2000-12-31", ["directors_tree", "structure_level"])
    late = people_enrich(registry_enrich(entities, members, registry, *range_), documents, countries)
    found = registry_enrich(entities, members, registry, *range_, prepare=lambda docs: graded_people(docs, countries), beside=applicants(documents))
    early = people_enrich(found, None, countries)
    rows = {tuple(r) for r in early.collect()}
    assert rows == {tuple(r) for r in late.collect()} == {
        ("e1", "High", 40, "1", "2"),
        ("e1", "Undefined", 40, "1", "2"),
        ("e1", "Undefined", 35, "2", "2"),
        ("e2", "Undefined", None, "Undefined", "Undefined"),
        ("e3", "Undefined", 20, "Undefined", "2"),
    }
    assert found.where("entity_id = 'e1'").count() == 4  # documents whose officers differ in the day of birth only meet entities once
