"""Column functions on hand-made rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from casewise import functions as fn
from casewise.operators.people import match_person

D = dt.date


def values(df, column):
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def frame(spark, rows, schema):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")


def test_within_days_is_one_sided(spark):
    day = D(2022, 1, 1)
    gaps = [-1, 0, 90, 91, None]
    df = frame(spark, [(day, None if g is None else day + dt.timedelta(g)) for g in gaps], "a date, b date")
    assert values(df, fn.within_days("a", "b", 90)) == [1, 1, 1, 0, 0]


def test_cohort_keeps_late_approvals_by_calendar_month(spark):
    rows = [
        (D(2022, 1, 31), None, True),
        (D(2021, 11, 30), D(2022, 2, 28), True),  # exactly three months later
        (D(2021, 11, 29), D(2022, 3, 1), False),
        (D(2022, 1, 1), D(2023, 1, 1), False),  # approved after the range
        (D(2021, 12, 1), D(2021, 12, 5), False),
    ]
    df = frame(spark, [r[:2] for r in rows], "made date, ok date")
    got = values(df, fn.cohort_filter("made", "ok", "2022-01-01", "2022-06-30"))
    assert [bool(g) for g in got] == [r[2] for r in rows]


def test_is_not_value_keeps_null(spark):
    df = frame(spark, [(None,), ("a",), ("b",)], "x string")
    assert values(df, fn.is_not_value("x", "a")) == [True, False, True]


def test_json_get_swallows_every_failure(spark):
    texts = ['{"a":{"b":5}}', '{"a":{"b":"x"}}', '{"a"', "", None, '{"a":1}']
    df = frame(spark, [(t,) for t in texts], "j string")
    assert values(df, fn.json_get("j", "$.a.b", "int")) == [5, None, None, None, None, None]
    keyed = frame(spark, [('{"s":{"1":"3"}}',)], "j string")
    assert values(keyed, fn.json_get("j", '$.s["1"]')) == ["3"]


def test_extract_first(spark):
    df = frame(spark, [("none",), ("a 123",), (" x1234 ",), ("12 5678 99999",), (None,)], "x string")
    assert values(df, fn.extract_first("x")) == [None, None, "1234", "5678", None]


def test_dates(spark):
    rows = [(D(2020, 12, 31), D(2021, 1, 1)), (D(2020, 5, 5), D(2020, 5, 5)), (D(2021, 3, 1), D(2019, 2, 1))]
    df = frame(spark, rows, "a date, b date")
    assert values(df, fn.year_boundaries("a", "b")) == [1, 0, -2]
    assert values(df, fn.month_diff("b", "a")) == [1, 0, -25]
    assert values(df, fn.days_between("a", "b")) == [1, 0, -759]
    assert values(df, fn.month_key("a")) == ["2020-12", "2020-05", "2021-03"]


def test_bands(spark):
    df = frame(spark, [(x,) for x in [None, 0.5, 1.0, 1.0001, 5.99, 6.0, 12.0]], "x double")
    bands = [(1, True, "< 1M"), (6, False, "< 6M"), (12, False, "< 12M")]
    want = ["Undefined", "< 1M", "< 1M", "< 6M", "< 6M", "< 12M", ">= 12M"]
    assert values(df, fn.band("x", bands, ">= 12M")) == want
    counts = frame(spark, [(n,) for n in [None, 0, 1, 2, 3, 9]], "n int")
    assert values(counts, fn.count_band("n")) == ["Undefined", "Undefined", "1", "2", "3+", "3+"]


@pytest.mark.parametrize(
    "raw, code",
    [(None, None), ("  ", None), ("E", None), ("E1", "E1"), (" SW1A ", "SW1A"), ("E1 6AN", "E1"), ("SW1A1AA", "SW1A"),
     ("SW1A  1AA", "SW1A"), ("ABCDEFGHI", None), ("A BCD", None)],
)
def test_outward_code(spark, raw, code):
    df = frame(spark, [(raw,)], "x string").select("i", fn.outward_code("x").alias("c"))
    row = df.first()["c"]
    assert row["value"] == code
    assert (row["error"] is None) == (code is not None)


def test_single_name_truth_table(spark):
    rows = [(None, None), ("a", "b"), ("a", None), (None, "b"), ("", ""), ("", "b"), ("", None)]
    df = frame(spark, rows, "a string, b string")
    assert values(df, fn.single_name("a", "b")) == [False, False, True, True, True, True, True]


def test_worst_level_of_every_pair(spark):
    order = ["High", "Medium", "Low", "Undefined"]
    pairs = [(a, b) for a in [*order, None] for b in order]
    df = frame(spark, pairs, "a string, b string")
    want = [min((x for x in p if x), key=order.index) for p in pairs]
    assert values(df, fn.worst_level("a", "b")) == want
    lists = frame(spark, [([],), (["Low", "High"],), (None,), (["Undefined", "Medium"],)], "xs array<string>")
    assert values(lists, fn.worst_in_array("xs")) == ["Undefined", "High", "Undefined", "Medium"]


def test_clip_keeps_null(spark):
    df = frame(spark, [(None,), (-1.0,), (5.0,), (11.0,)], "x double")
    assert values(df, fn.clip("x", 0, 10)) == [None, 0.0, 5.0, 10.0]


def test_email_domain(spark):
    df = frame(spark, [("a@b.com",), ("a@b@c.org",), ("a@x#b.com",), ("plain",)], "e string")
    assert values(df, fn.email_domain("e")) == ["b.com", "c.org", "b.com", "plain"]
    assert values(df, fn.email_domain("e", ["b.com"])) == ["b.com", "other", "b.com", "other"]


def test_round_even_and_sigmoid(spark):
    df = frame(spark, [(0.5,), (1.5,), (2.5,), (2000.0,)], "x double")
    assert values(df, fn.round_even("x")) == [0.0, 2.0, 2.0, 2000.0]
    assert values(df, fn.sigmoid("x"))[3] == 1.0


def officers(*people):
    import json

    return json.dumps(
        [
            {"officerId": i, "person": {"firstName": f, "lastName": l, "dateOfBirth": b, "nationalities": n}}
            for i, f, l, b, n in people
        ]
    )


def test_parse_people(spark):
    good = officers(("1", "Ann", "Lee", "1980-05-17", ["GB"]), ("2", "Bo", "Ray", "1990-01-02", ["FR"]))
    again = officers(("1", "Ann", "Lee", "1980-05-17", ["GB"]), ("2", "Bo", "Ray", "1990-01-02", []), ("1", "Eve", "Lee", "1970-01-01", []))
    no_birth = officers(("1", "Ann", "Lee", "", ["GB"]))
    df = frame(spark, [(good,), (again,), (no_birth,), ("[",), ("[]",), (None,)], "j string")
    people = values(df, fn.parse_people("j"))
    assert [p["first"] for p in people[0]] == ["ann", "bo"]
    assert [(p["id"], p["first"]) for p in people[1]] == [("1", "eve"), ("2", "bo")]
    assert people[2:] == [None, None, [], None]


def test_mean_age(spark):
    two = officers(("1", "A", "B", "1980-05-17", []), ("2", "A", "B", "2000-05-17", []))
    df = frame(spark, [(two, D(2020, 6, 1), D(1990, 1, 1)), ("[]", D(2020, 6, 1), D(1990, 1, 1))], "j string, at date, born date")
    df = df.withColumn("people", fn.parse_people("j"))
    assert values(df, fn.mean_age("people", "at", "born")) == [30, 30]
    assert values(df, fn.mean_age("people", "at", "born", first_only=True)) == [40, 30]


@pytest.mark.parametrize(
    "a, b, score",
    [("ann", "ann", 100), ("Ann Marie", "marie", 100), ("katherine", "katharine", 89), ("lee ann", "ann lee", 100),
     ("", "ann", 0), (None, "ann", 0), ("bob", "xyz", 0), ("jon", "jonathan", 100), ("jane", "jena", 50)],
)
def test_name_score(spark, a, b, score):
    df = frame(spark, [(a, b)], "a string, b string")
    assert values(df, fn.name_score("a", "b")) == [score]
    assert values(df, fn.name_score("b", "a")) == [score]


def test_first_matching_officer_wins(spark):
    tree = officers(
        ("1", "Zed", "Lee", "1980-05-17", ["A"]),
        ("2", "Ann", "Lee", "1980-05-02", ["B"]),
        ("3", "Ann", "Lee", "1980-05-30", ["C"]),
    )
    df = frame(spark, [(tree, "ann", "lee", D(1980, 5, 9)), (tree, "ann", "lee", D(1981, 5, 9))], "j string, f string, l string, born date")
    df = df.withColumn("people", fn.parse_people("j"))
    assert values(df, match_person("people", "f", "l", "born")) == [["B"], None]


def test_unwrap_cells(spark):
    df = frame(spark, [('{"input":{"p":1},"output":{"value":"High","error":null}}',), ("bad",)], "cell string")
    rows = fn.unwrap_cells(df, ["cell"], ["value", "error", "input"]).orderBy("i").collect()
    assert rows[0]["cell_value"] == "High" and rows[0]["cell_input"] == '{"p":1}' and rows[1]["cell_value"] is None
    assert fn.unwrap_cells(df, ["cell"]).columns == ["i", "cell"]


def test_log_loss_of_positives(spark):
    df = frame(spark, [(1, 0.5), (0, 0.9), (1, 0.0)], "y int, p double")
    import math

    assert df.agg(fn.log_loss_pos("y", "p")).first()[0] == pytest.approx(math.log(2) - math.log(1e-10))


def test_case_label_needs_rules():
    with pytest.raises(ValueError):
        fn.case_label([])


def test_map_codes(spark):
    df = frame(spark, [("a",), ("z",), (None,)], "x string")
    assert values(df, fn.map_codes("x", {"a": "A"}, "none")) == ["A", "none", "none"]
    assert values(df, fn.map_codes("x", {"a": "A"}, F.col("x"))) == ["A", "z", None]
