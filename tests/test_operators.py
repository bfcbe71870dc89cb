"""Table operators on hand-made rows and against brute force."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from casewise.operators import bandit, clusters, encode, evaluate, frames, information, lookup, rules, selection, stats, temporal

T = dt.datetime
D = dt.date


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_latest_keeps_ties_and_null_is_latest(spark):
    df = spark.createDataFrame(
        [("a", T(2022, 1, 1), 1), ("a", T(2022, 1, 2), 2), ("a", T(2022, 1, 2), 3), ("b", None, 4), ("b", T(2022, 1, 1), 5), (None, T(2022, 1, 1), 6)],
        "k string, ts timestamp_ntz, v int",
    )
    assert [r[2] for r in rows(temporal.latest_per_key(df, "k", "ts"), "v")] == [2, 3, 4, 6]
    assert [r[2] for r in rows(temporal.first_per_key(df, "k", "ts"), "v")] == [1, 5, 6]
    assert [r[2] for r in rows(temporal.latest_per_key(df, "k", "ts", ties=False, tie_break=["v"]), "v")] == [3, 4, 6]
    assert [r[2] for r in rows(temporal.dedupe(df, "k", ["ts", "v"]), "v")] == [1, 5, 6]


def test_interval_match_is_two_sided(spark):
    anchors = spark.createDataFrame([("a", D(2022, 1, 31)), ("b", D(2020, 2, 29)), ("c", None)], "k string, day date")
    events = spark.createDataFrame(
        [("a", D(2022, 1, 30), 1), ("a", D(2022, 1, 31), 2), ("a", D(2022, 5, 1), 4), ("a", D(2022, 5, 2), 8), ("b", D(2020, 5, 29), 16), ("b", D(2020, 5, 30), 32)],
        "k string, at date, v int",
    )
    aggs = {"n": F.sum("v")}
    days = temporal.interval_match(anchors, events, "k", "day", "at", days=90, aggs=aggs)
    assert rows(days.select("k", "n"), "k") == [("a", 6), ("b", 16), ("c", None)]
    months = temporal.interval_match(anchors, events, "k", "day", "at", months=3, aggs=aggs)
    assert rows(months.select("k", "n"), "k") == [("a", 2), ("b", 16), ("c", None)]


HISTORY = [("a", T(2022, 1, 1), 1), ("a", T(2022, 1, 5), 2), ("a", T(2022, 1, 5), 3), ("b", T(2022, 2, 1), 4)]
SPINE = [("a", T(2021, 12, 31)), ("a", T(2022, 1, 1)), ("a", T(2022, 1, 4)), ("a", T(2022, 1, 5)), ("a", T(2022, 3, 1)), ("c", T(2022, 1, 1)), (None, T(2022, 1, 1))]


@pytest.mark.parametrize("bucket_seconds", [10**9, 86_400, 60])
def test_asof_before_equal_after(spark, bucket_seconds):
    spine = spark.createDataFrame(SPINE, "k string, ts timestamp_ntz")
    hist = spark.createDataFrame(HISTORY, "k string, h timestamp_ntz, v int")

    def values(**options):
        joined = temporal.asof_join(spine, hist, "k", "ts", "h", tie_break=["v"], bucket_seconds=bucket_seconds, **options)
        return [r["v"] for r in joined.orderBy(F.col("k").asc_nulls_last(), "ts").collect()]

    assert values() == [None, 1, 1, 3, 3, None, None]
    assert values(strict=True) == [None, None, 1, 1, 3, None, None]
    assert values(max_age_days=3) == [None, 1, 1, 3, None, None, None]


def test_asof_of_hot_keys_equals_plain(spark, table):
    e = table("events")
    spine = e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    past = e.filter("event_type <> 'purchase'").select("user_id", F.col("ts").alias("h"), F.col("event_id").alias("v"))
    # One user holds a third of all rows.
    hot = F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id"))
    spine, past = spine.withColumn("user_id", hot), past.withColumn("user_id", hot)
    plain = rows(temporal.asof_join(spine, past, "user_id", "ts", "h", tie_break=["v"]), "event_id")
    for seconds in (10**10, 5_000):
        assert plain == rows(temporal.asof_join(spine, past, "user_id", "ts", "h", tie_break=["v"], bucket_seconds=seconds), "event_id")


def test_asof_spreads_one_key_and_starts_no_job(spark, table):
    e = table("events").withColumn("user_id", F.lit(1))
    spine = e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    past = e.filter("event_type <> 'purchase'").select("user_id", F.col("ts").alias("h"), F.col("event_id").alias("v"))
    context = spark.sparkContext
    context.setJobGroup("asof", "building the join")
    joined = temporal.asof_join(spine, past, "user_id", "ts", "h", tie_break=["v"], bucket_seconds=600)
    assert not context.statusTracker().getJobIdsForGroup("asof")
    context.setJobGroup("rest", "")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = joined.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sum(size > 0 for size in sizes) == 8 and max(sizes) < sum(sizes) / 4


def test_asof_of_null_keys_and_times(spark):
    spine = spark.createDataFrame([("a", None, 1), (None, T(2022, 1, 1), 2), ("a", T(2022, 1, 9), 3)], "k string, ts timestamp, i int")
    hist = spark.createDataFrame([("a", T(2022, 1, 1), 1), ("a", None, 2), (None, T(2022, 1, 1), 3)], "k string, h timestamp, v int")
    for seconds in (60, 10**9):
        joined = temporal.asof_join(spine, hist, "k", "ts", "h", tie_break=["v"], bucket_seconds=seconds)
        assert [r["v"] for r in joined.orderBy("i").collect()] == [None, None, 1]


def test_parent_rollup(spark):
    df = spark.createDataFrame([("p", None, "x"), ("c", "p", "y"), ("o", "gone", "z")], "k string, p string, kind string")
    got = frames.rollup_parent(df, "k", "p", ["kind"]).select("k", "kind")
    assert sorted(map(tuple, got.collect()), key=str) == [("gone", None), ("p", "x"), ("p", "x")]


def test_unpivot_refs_cleans_after_distinct(spark):
    df = spark.createDataFrame([(1, ' "a",', "a", None), (1, "a", " ", "b]")], "k int, r1 string, r2 string, r3 string")
    got = sorted(r[1] for r in frames.unpivot_refs(df, "k", ["r1", "r2", "r3"]).collect())
    assert got == ["", "a", "a", "b"]


def test_prefix_lookup(spark):
    df = spark.createDataFrame([("SW1A", None), ("SW9", None), ("E1", None), ("ZZ", None), (None, "bad")], "c string, e string")
    codes = spark.createDataFrame([("SW1A", "High"), ("SW", "Medium"), ("E", "Low2")], "code string, level string")
    got = {r["c"]: r["lvl"] for r in lookup.prefix_lookup(df, "c", codes, "lvl", error="e").collect()}
    assert got == {"SW1A": "High", "SW9": "Medium", "E1": "Low2", "ZZ": "Low", None: "Undefined"}


def test_rules_count_and_cap(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "b")], "i int, x string")
    flagged = rules.apply_rules(df, {"r1": F.col("x").contains("a"), "r2": F.col("x").contains("b")})
    plain = rules.summarize_rules(flagged, ["r1", "r2"])
    assert rows(plain.select("i", "any_rule", "rule_count"), "i") == [(1, 1, 2), (2, 0, 0), (3, 1, 1)]
    extra = rules.summarize_rules(flagged, ["r1", "r2"], include_any=True)
    assert rows(extra.select("i", "rule_count"), "i") == [(1, 3), (2, 0), (3, 2)]


def test_triggers(spark):
    from casewise.plans.features import TRIGGER_GROUPS

    texts = [None, "", "bl001", "Bl001,BL008", "applicant_pep director_mismatch", "sanction_fail"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    names = list(TRIGGER_GROUPS)
    got = rows(rules.group_triggers(df, "t", TRIGGER_GROUPS).select("i", *names), "i")
    assert [sum(r[1:]) for r in got] == [0, 0, 1, 1, 2, 1]
    assert got[4][1 + names.index("business_internal_checks")] == 1


def test_one_hot_is_fixed(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "zzz")], "i int, c string")
    got = encode.one_hot(df, {"c": ["a", "b"]})
    assert got.columns == ["i", "c_a", "c_b"]
    assert rows(got, "i") == [(1, 1, 0), (2, 0, 0), (3, 0, 0)]


def test_encoder_has_all_columns(spark):
    from casewise.plans import encoded

    base = {c: "High" for c in encoded.LEVELS}
    numbers = {c[0]: 20.0 for c in encoded.SCALES.values()}
    df = spark.createDataFrame(pd.DataFrame([{"entity_id": "1", **base, **numbers}]))
    out = encoded.encode(df)
    assert sum(len(v) for v in encoded.LEVELS.values()) == 50
    dummies = [c for c in out.columns if any(c.startswith(f"{k}_") for k in encoded.LEVELS)]
    assert len(dummies) == 50 - 2 + 1 and "applicant_id_type_RP_Nid" in out.columns


def test_cluster_features():
    from casewise.plans import encoded

    names = encoded.cluster_features()
    assert len(names) == len(set(names)) == 43
    assert "applicant_id_type_RP_Nid" in names and "company_status_Undefined" not in names


def test_iv_zero_cell_is_null(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (0, 1.0, 2.0), (1, 2.0, 1.0), (1, 2.0, 2.0)], "y int, x double, z double")
    got = {r["feature"]: r for r in information.iv_class(df, "y", ["x", "z"]).collect()}
    assert got["x"]["iv"] is None and got["x"]["zero_cell"] and got["x"]["strength"] == "useless"
    assert got["z"]["iv"] == 0.0 and not got["z"]["zero_cell"]
    one = information.iv_class(df.withColumn("x", F.lit(1.0)), "y", ["x"]).first()
    assert one["iv"] == 0.0


def test_correlation_edges(spark):
    x = np.arange(20.0)
    df = spark.createDataFrame(pd.DataFrame({"a": x, "b": -x, "c": x * 2, "k": 1.0}))
    r = stats.to_matrix(stats.pearson(df, ["a", "b", "c", "k"]), ["a", "b", "c", "k"])
    assert r[0, 1] == pytest.approx(-1) and r[0, 2] == pytest.approx(1) and np.isnan(r[0, 3]) and np.isnan(r[3, 3])
    matrix = selection.feature_matrix(df, ["a", "b", "c", "k"], cutoff=0.9)
    assert matrix.names == ["a"] and sorted(matrix.dropped) == ["b", "c", "k"]
    vif = {r["feature"]: r["vif"] for r in selection.vif(df.select("a", "c"), ["a", "c"]).collect()}
    assert vif == {"a": 1000.0, "c": 1000.0}


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(400, 3))
    x = np.column_stack([base, base @ rng.normal(size=(3, 3)) + rng.normal(size=(400, 3)) * 0.7, rng.normal(size=(400, 9))])
    pdf = pd.DataFrame(x, columns=[f"f{i}" for i in range(15)])
    pdf["y"] = (pdf["f0"] + pdf["f4"] + rng.normal(size=400) > 0).astype(int)
    return pdf, spark.createDataFrame(pdf).repartition(5)


def greedy(r, targets, candidates, steps):
    """Brute force: refit every candidate from scratch."""
    picked, scores = [], []
    total = np.trace(r[np.ix_(targets, targets)])
    for _ in range(steps):
        best = None
        for c in candidates:
            if c in picked:
                continue
            s = picked + [c]
            left = [t for t in targets if t not in picked]
            cross = r[np.ix_(left, s)]
            score = np.trace(r[np.ix_(left, left)] - cross @ np.linalg.pinv(r[np.ix_(s, s)]) @ cross.T)
            if best is None or score < best[0] - 1e-12:
                best = (score, c)
        picked.append(best[1])
        scores.append((total - best[0]) / total)
    return picked, scores


def test_forward_selection_matches_brute_force(wide):
    pdf, df = wide
    cols = [f"f{i}" for i in range(15)]
    r = np.corrcoef(pdf[cols].to_numpy(), rowvar=False)
    got = selection.select_unsupervised(df, cols, varexp=0.9).orderBy("step").collect()
    picked, scores = greedy(r, list(range(15)), list(range(15)), len(got))
    assert [g["feature"] for g in got] == [cols[i] for i in picked]
    assert [g["var_exp"] for g in got] == pytest.approx(scores, abs=1e-4)
    assert scores[-1] >= 0.9 > scores[-2]

    got = selection.select_supervised(df, cols[1:], "f0", "Continuous")
    order = [*cols[1:], "f0"]
    r = np.corrcoef(pdf[order].to_numpy(), rowvar=False)
    got = got.orderBy("step").collect()
    picked, scores = greedy(r, [14], list(range(14)), len(got))
    assert [g["feature"] for g in got] == [order[i] for i in picked]


def test_supervised_class_target(wide):
    pdf, df = wide
    cols = [f"f{i}" for i in range(15)]
    first = selection.select_supervised(df, cols, "y", "Class").orderBy("step").first()
    strongest = pdf[cols].corrwith(pdf["y"]).abs().idxmax()
    assert first["feature"] == strongest


def test_vif_and_explained_variance_match_regression(wide):
    pdf, df = wide
    cols = [f"f{i}" for i in range(15)]
    got = {r["feature"]: r["vif"] for r in selection.vif(df, cols).collect()}
    x = pdf[cols].to_numpy()
    for i, c in enumerate(cols):
        others = np.column_stack([np.ones(len(x)), np.delete(x, i, axis=1)])
        fit = others @ np.linalg.lstsq(others, x[:, i], rcond=None)[0]
        r2 = 1 - ((x[:, i] - fit) ** 2).sum() / ((x[:, i] - x[:, i].mean()) ** 2).sum()
        assert got[c] == pytest.approx(1 / (1 - r2), abs=0.006)
        assert got[c] >= 1
    everything = selection.explained_variance(df, cols, cols).first()
    assert everything["ratio"] == 1.0


def test_feature_clusters_and_reports(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 300))
    noise = lambda: rng.normal(size=300) * 0.2
    pdf = pd.DataFrame({"a1": a + noise(), "a2": a + noise(), "a3": -a + noise(), "b1": b + noise(), "b2": b + noise()})
    df = spark.createDataFrame(pdf)
    cols = list(pdf.columns)
    groups = {}
    for r in selection.feature_clusters(df, cols).collect():
        groups.setdefault(r["cluster"], set()).add(r["feature"])
    assert sorted(map(sorted, groups.values())) == [["a1", "a2", "a3"], ["b1", "b2"]]

    x = (pdf - pdf.mean()) / pdf.std(ddof=0)
    for method in ("correlation", "r-square_ratio", "centroid", "closest_to_PCA"):
        report = selection.feature_cluster_report(df, cols, method=method).toPandas().set_index("feature")
        assert report["chosen"].sum() == 2
        for group in groups.values():
            names = [c for c in cols if c in group]
            z = x[names].to_numpy()
            u, s, v = np.linalg.svd(z, full_matrices=False)
            axis = v[0] * np.sign(v[0][np.argmax(np.abs(v[0]))])
            first = z @ axis
            for i, c in enumerate(names):
                want = {
                    "correlation": np.abs(np.corrcoef(z, rowvar=False)[i]).sum() - 1,
                    "centroid": np.linalg.norm(z[:, i] - z.mean(axis=1)),
                    "closest_to_PCA": np.linalg.norm(z[:, i] - first),
                }.get(method)
                if want is not None:
                    assert report.loc[c, "score"] == pytest.approx(want, abs=1e-6)
                else:
                    assert report.loc[c, "r2_own"] == pytest.approx(np.corrcoef(z[:, i], first)[0, 1] ** 2, abs=0.006)


CENTRES = [[0.0, 0.0], [10.0, 0.0]]


def test_assignment_and_silhouette(spark):
    points = [(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 0.0, 2.0), (4, 10.0, 0.0), (5, 9.0, 1.0), (6, 5.0, 0.0)]
    df = spark.createDataFrame(points, "id int, x double, y double")
    near = clusters.assign(df, ["x", "y"], CENTRES)
    assert [r["cluster"] for r in near.orderBy("id").collect()] == [0, 0, 0, 1, 1, 0]  # a tie goes to the lower number
    mean = clusters.distortion(df, ["x", "y"], CENTRES).first()["distortion"]
    assert mean == pytest.approx((0 + 1 + 2 + 0 + 2**0.5 + 5) / 6)

    single = near.withColumn("cluster", F.when(F.col("id") == 6, 2).otherwise(F.col("cluster")))
    x = np.array([p[1:] for p in points])
    label = np.array([0, 0, 0, 1, 1, 2])
    for metric, power in (("euclidean", 1), ("squared", 2)):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) ** power
        want = []
        for i in range(6):
            own = label == label[i]
            if own.sum() == 1:
                want.append(0.0)
                continue
            a = d[i, own].sum() / (own.sum() - 1)
            b = min(d[i, label == c].mean() for c in set(label) - {label[i]})
            want.append((b - a) / max(a, b))
        for tile in (4096, 2):
            got = clusters.silhouette(single, ["x", "y"], "cluster", "id", metric=metric, tile_rows=tile).first()
            assert got["silhouette"] == pytest.approx(np.mean(want)) and -1 <= got["silhouette"] <= 1


def test_knee(spark):
    xs = list(range(1, 11))
    curves = [("elbow", x, 1 / x) for x in xs] + [("line", x, 10.0 - x) for x in xs]
    df = spark.createDataFrame([(c, x, float(y)) for c, x, y in curves], "c string, x int, y double")
    got = {r["c"]: r["knee"] for r in clusters.knee(df, ["c"], "x", "y").collect()}
    assert got["elbow"] in (2.0, 3.0)
    up = df.filter("c = 'elbow'").withColumn("y", 1 - F.col("y"))
    assert clusters.knee(up, ["c"], "x", "y", "concave", "increasing").first()["knee"] == got["elbow"]
    with pytest.raises(ValueError):
        clusters.knee(df, ["c"], "x", "y", "concave", "decreasing")


def test_more_clusters_cost_less(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame(pd.DataFrame(rng.normal(size=(300, 2)), columns=["a", "b"]))
    models, table = clusters.kmeans_sweep(df, ["a", "b"], ks=(2, 6), restarts=2, max_iter=10)
    value = {r["k"]: r["value"] for r in table.collect()}
    assert value[6] < value[2] and set(models) == {2, 6}


def plain_lloyd(x, centers, steps):
    for _ in range(steps):
        near = ((x[:, None] - centers[None]) ** 2).sum(-1).argmin(1)
        moved = np.array([x[near == j].mean(0) if (near == j).any() else centers[j] for j in range(len(centers))])
        if ((moved - centers) ** 2).sum() <= 1e-4 * x.var(0).mean():
            break
        centers = moved
    return centers, ((x[:, None] - centers[None]) ** 2).sum(-1).min(1).sum()


def plain_silhouette(x, centers):
    apart = ((x[:, None] - x[None]) ** 2).sum(-1)
    near = ((x[:, None] - centers[None]) ** 2).sum(-1).argmin(1)
    out = []
    for i in range(len(x)):
        same = near == near[i]
        if same.sum() == 1:
            out.append(0.0)
            continue
        a = apart[i][same].sum() / (same.sum() - 1)
        b = min(apart[i][near == j].mean() for j in set(near) - {near[i]})
        out.append((b - a) / max(a, b))
    return np.mean(out)


def test_sweep_equals_plain_fits(spark, monkeypatch):
    from casewise.operators import sweep

    monkeypatch.setattr(sweep, "BLOCK_ROWS", 37)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.4, (60, 3)) for c in ((0, 0, 0), (4, 0, 1), (0, 5, 2))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(999, None, 1.0, 1.0)], "i long, a double, b double, c double").repartition(5)
    cols = ["a", "b", "c"]
    models, table = sweep.kmeans_sweep(df, cols, ks=(2, 3, 7), restarts=3, max_iter=25, key="i", sample=1.0)
    begun = sweep.starts(df, cols, 7, 3, 42)
    value = {(r["k"], r["metric"]): r["value"] for r in table.collect()}
    for k in (2, 3, 7):
        centers, _ = min((plain_lloyd(x, begun[r][:k], 25) for r in range(3)), key=lambda f: f[1])
        np.testing.assert_allclose(models[k], centers, atol=1e-9)
        gap = np.sqrt(((x[:, None] - centers[None]) ** 2).sum(-1).min(1)).mean()
        assert value[k, "distortion"] == pytest.approx(gap) and value[k, "silhouette"] == pytest.approx(plain_silhouette(x, centers))
    assert value[3, "silhouette"] > 0.9


def test_sweep_looks_in_single_precision_where_it_decides(spark, monkeypatch):
    from casewise.operators import sweep

    rng = np.random.default_rng(2)
    x = 1e6 + rng.normal(size=(3000, 5)) * [1, 2, 3, 1e-3, 1]
    centers = np.concatenate([x[:40], x[:40], x[:40] + 1e-7])  # equal centres and centres closer than single precision tells
    look = sweep.Scaled(x.mean(axis=0), float(x.std()))
    looked = []
    plain = sweep.nearest
    monkeypatch.setattr(sweep, "nearest", lambda rows, c: looked.append(len(rows)) or plain(rows, c))
    assert (look.nearest(x, look.rows(x), centers, look.centers(centers)) == plain(x, centers)[0]).all()
    few = x[:40]
    looked.clear()
    assert (look.nearest(x, look.rows(x), few, look.centers(few)) == plain(x, few)[0]).all()
    assert sum(looked) < 300


def test_sweep_looks_again_at_rows_whose_bounds_meet_only(monkeypatch):
    from casewise.operators import sweep

    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 6)) + 5
    x = np.concatenate([x, x[:50], 5 * x[:3]])  # rows that come twice, and some far off
    look, looked = sweep.Scaled(x.mean(axis=0), float(np.sqrt(x.var(axis=0).sum()))), []
    plain = sweep.Scaled.look
    monkeypatch.setattr(sweep.Scaled, "look", lambda self, rows, *rest: looked.append(len(rows)) or plain(self, rows, *rest))
    centers, rows, kept, far = np.concatenate([x[:40], x[:2], x[-1:]]), look.rows(x), None, None
    for _ in range(30):
        looked.append(0)
        model = sweep.Moved(look, centers, far)
        kept = model.first(x, rows) if kept is None else model.next(x, rows, kept)
        near, square = sweep.nearest(x, centers)
        assert (kept[0] == near).all() and (kept[1] * look.scale * (1 + 1e-6) >= np.sqrt(square)).all()
        others = ((x[:, None] - centers[None]) ** 2).sum(axis=-1)
        others[np.arange(len(x)), near] = np.inf
        assert (kept[2] * look.scale * (1 - 1e-6) <= np.sqrt(others.min(axis=1))).all()
        moved = np.array([x[near == j].mean(axis=0) if (near == j).any() else centers[j] for j in range(len(centers))])
        far, centers = np.sqrt(((moved - centers) ** 2).sum(axis=1)), moved
    assert looked[:2] == [0, len(x)] and sum(looked[2:]) < 20 * len(x) and looked[-1] < len(x) / 2


def test_sweep_begins_new_chains(spark, monkeypatch):
    from casewise.operators import sweep

    monkeypatch.setattr(sweep, "CHAIN", 3)
    monkeypatch.setattr(sweep, "BLOCK_ROWS", 50)
    x = np.random.default_rng(4).normal(size=(500, 3))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"])).repartition(4)
    models, steps = sweep.fit_all(df, ["a", "b", "c"], [4, 9], 2, 12, 42)
    begun = sweep.starts(df, ["a", "b", "c"], 9, 2, 42)
    for k in (4, 9):
        centers, _ = min((plain_lloyd(x, begun[r][:k], 12) for r in range(2)), key=lambda f: f[1])
        np.testing.assert_allclose(models[k], centers, atol=1e-9)
    assert 3 < max(steps.values()) <= 12 and not spark.sparkContext._jsc.getPersistentRDDs()


def test_sweep_deals_rows_of_one_file_over_the_cores(spark):
    from casewise.operators import sweep

    df = spark.createDataFrame([(float(i),) for i in range(20_000)], "a double").coalesce(1)
    blocks = sweep.packed_rows(df, ["a"])
    sizes = blocks.rdd.mapPartitions(lambda part: [sum(r["n"] for r in part)]).collect()
    assert len(sizes) == spark.sparkContext.defaultParallelism and sum(sizes) == 20_000 and max(sizes) <= 4 * sweep.BLOCK_ROWS


def test_sweep_of_few_and_no_rows(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (None,)], "a double")
    models, table = clusters.kmeans_sweep(df, ["a"], ks=(2, 5), restarts=2, max_iter=5)
    assert {k: sorted(m) for k, m in models.items()} == {2: [[1.0], [2.0]], 5: [[1.0], [2.0]]}
    assert {r["value"] for r in table.collect()} == {0.0}
    models, table = clusters.kmeans_sweep(df.limit(0), ["a"], ks=(2,), restarts=2, max_iter=5)
    assert models == {} and table.count() == 0


def irls(x, y, steps=100, tol=1e-4):
    """The documented fit, written out for one small group."""
    b, losses = np.zeros(x.shape[1]), []
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ b))
        cov = np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x + 0.001 * np.eye(x.shape[1]))
        b = b - cov @ (x.T @ (p - y))
        q = np.clip(1 / (1 + np.exp(-x @ b)), 1e-10, 1 - 1e-10)
        losses.append(-(y * np.log(q)).sum())
        if len(losses) >= 3 and losses[-2] - losses[-1] < tol and losses[-3] - losses[-2] < tol:
            break
    return b, cov


@pytest.fixture(scope="module")
def cases(spark):
    rng = np.random.default_rng(5)
    n = 900
    pdf = pd.DataFrame(rng.normal(size=(n, 3)), columns=["a", "b", "c"])
    pdf["id"] = np.arange(n)
    pdf["cluster"] = rng.integers(0, 4, n).astype("int32")
    pdf.loc[: n // 3, "cluster"] = 0  # a third of the rows in one cluster
    pdf["arm"] = rng.choice(["x", "y", "z"], n)
    pdf["r1"] = (rng.random(n) < 1 / (1 + np.exp(-(pdf["a"] - pdf["b"] * 0.5)))).astype(int)
    pdf["r2"] = (rng.random(n) < 0.2).astype(int)
    pdf.loc[pdf["cluster"] == 3, "r2"] = 0  # one class only
    pdf.loc[(pdf["cluster"] == 2) & (pdf["arm"] != "x"), "arm"] = "x"  # no rows for the second reward
    return pdf, spark.createDataFrame(pdf).repartition(7)


REWARDS = {"r1": ["x", "y"], "r2": ["y", "z"]}


def models_of(df, **options):
    fitted = bandit.fit_logit_by_group(df, "cluster", "arm", ["a", "b", "c"], REWARDS, **options)
    return {(r["cluster"], r["reward"]): r for r in fitted.collect()}


def test_large_clusters_are_packed_once(spark, cases, monkeypatch):
    monkeypatch.setattr(bandit, "PACK_ROWS", 50)
    pdf, df = cases
    arms = {f"y{i}": F.when(F.col("arm").isin(REWARDS[r]), F.col(r).cast("double")) for i, r in enumerate(REWARDS)}
    blocks = bandit._packed_clusters(df.withColumns(arms), ["a", "b", "c"], list(arms)).collect()
    assert {b["cluster"] for b in blocks} == {0, 1, 2, 3}
    for c, part in pdf.groupby("cluster"):
        x = np.concatenate([np.frombuffer(b["x"]).reshape(-1, 4) for b in blocks if b["cluster"] == c])
        y = np.concatenate([np.frombuffer(b["y"]).reshape(2, -1) for b in blocks if b["cluster"] == c], axis=1)
        order, expected = np.lexsort(x.T), part[["a", "b", "c"]].to_numpy()
        mine = np.lexsort(np.column_stack([np.ones(len(part)), expected]).T)
        assert (x[order, 1:] == expected[mine]).all() and (x[:, 0] == 1).all()
        wanted = np.where(part["arm"].isin(REWARDS["r2"]), part["r2"], np.nan)[mine]
        np.testing.assert_array_equal(y[1][order], wanted)


def test_logit_models(cases):
    pdf, df = cases
    small, large = models_of(df), models_of(df, group_rows=1)
    mixed = models_of(df, group_rows=300)
    assert len(small) == 8
    for (cluster, reward), got in small.items():
        part = pdf[(pdf["cluster"] == cluster) & pdf["arm"].isin(REWARDS[reward])]
        assert got["success"] == part[reward].sum() and got["success"] + got["failure"] == len(part)
        for other in (large, mixed):
            twin = other[cluster, reward]
            assert np.allclose(got["beta"], twin["beta"]) and np.allclose(got["cov"], twin["cov"])
            assert (got["steps"], got["converged"], got["success"]) == (twin["steps"], twin["converged"], twin["success"])
        if len(part):
            beta, cov = irls(np.column_stack([np.ones(len(part)), part[["a", "b", "c"]]]), part[reward].to_numpy())
            assert np.allclose(got["beta"], beta, atol=1e-8) and np.allclose(got["cov"], cov)
        else:
            assert got["beta"] == [0.0] * 4 and got["cov"][0][0] == 1000.0 and got["steps"] == 0


def test_linear_scores_do_not_depend_on_layout(spark, cases):
    pdf, df = cases
    models = bandit.fit_logit_by_group(df, "cluster", "arm", ["a", "b", "c"], REWARDS).cache()
    score = lambda frame, **o: rows(
        bandit.lin_ts(frame, models, "cluster", "id", ["a", "b", "c"], ["r1", "r2"], **o).select("id", "r1_score", "r2_score"), "id"
    )
    first = score(df)
    assert first == score(df.repartition(2))
    assert first == score(df, model_numbers=0, chunk_rows=100)
    assert all(0 <= s <= 1000 for r in first for s in r[1:])
    assert first != score(df, seed=1)


def test_linear_scores_centre_on_the_model(spark):
    n = 4000
    df = spark.range(n).select("id", F.lit(0).alias("cluster"), F.lit(1.0).alias("a"))
    models = spark.createDataFrame(
        [(0, "r", [0.4, -0.1], [[0.09, 0.02], [0.02, 0.04]])], "cluster int, reward string, beta array<double>, cov array<array<double>>"
    )
    scored = bandit.lin_ts(df, models, "cluster", "id", ["a"], ["r"]).toPandas()["r_score"] / 1000
    odds = np.log(scored / (1 - scored))
    assert odds.mean() == pytest.approx(0.3, abs=4 * np.sqrt(0.17 / 10 / n) + 1e-3)
    assert odds.var() == pytest.approx(0.17 / 10, rel=0.1)


def test_beta_posterior_and_scores(spark):
    counts = spark.createDataFrame([(0, 0, 0), (1, 5, 0), (2, 0, 5), (3, None, None)], "cluster int, r_success bigint, r_failure bigint")
    post = {r["cluster"]: r for r in bandit.beta_posterior(counts, "cluster", ["r"]).collect()}
    assert [post[c]["r_mean"] for c in range(4)] == pytest.approx([0.5, 6 / 7, 1 / 7, 0.5])
    n = 3000
    df = spark.range(5 * n).select("id", (F.col("id") % 5).cast("int").alias("cluster"))  # cluster 4 has no history
    posterior = bandit.beta_posterior(counts, "cluster", ["r"])
    scored = bandit.beta_ts(df, posterior, "cluster", "id", ["r"])
    assert rows(scored, "id") == rows(bandit.beta_ts(df.repartition(3), posterior, "cluster", "id", ["r"]).select(*scored.columns), "id")
    means = scored.groupBy("cluster").agg(F.avg("r_score"), F.variance("r_score")).toPandas().set_index("cluster")
    for c in range(5):
        mean = post[c]["r_mean"] if c in post else 0.5
        var = post[c]["r_var"] if c in post else 1 / 12
        assert means.iloc[:, 0][c] / 1000 == pytest.approx(mean, abs=4 * np.sqrt(var / 10 / n) + 1e-3)
        assert means.iloc[:, 1][c] / 1e6 == pytest.approx(var / 10, rel=0.15)


def test_positive_definite_repair():
    bad = np.array([[1.0, 2.0], [2.0, 1.0]])
    fixed = bandit._positive_definite(bad)
    np.linalg.cholesky(fixed)
    assert np.allclose(fixed, [[1.5, 1.5], [1.5, 1.5]], atol=1e-6)
    good = np.eye(2)
    assert bandit._positive_definite(good) is good


def test_roc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([(1, 3.0), (0, 3.0), (1, 2.0), (0, 1.0), (0, 1.0)], "y int, s double")
    assert evaluate.auc(df, "y", "s").first()["auc"] == pytest.approx((2.5 + 2) / 6)
    points = rows(evaluate.roc(df, "y", "s").select("fpr", "tpr"), "fpr", "tpr")
    assert np.allclose(points, [(0, 0), (1 / 3, 0.5), (1 / 3, 1), (1, 1)])
    assert evaluate.auc(df.filter("y = 1"), "y", "s").first()["auc"] is None
    stretched = df.withColumn("s", F.exp("s"))
    assert evaluate.auc(stretched, "y", "s").first() == evaluate.auc(df, "y", "s").first()


def test_sampling_by_key_ignores_layout(spark):
    df = spark.range(20000)
    one = {r[0] for r in frames.sample_rows(df, 0.2, "id").collect()}
    two = {r[0] for r in frames.sample_rows(df.repartition(13), 0.2, "id").collect()}
    assert one == two and 3700 < len(one) < 4300


def test_mic_finds_shape(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, 500)
    df = spark.createDataFrame(pd.DataFrame({"y": x**2, "x": x, "noise": rng.uniform(size=500)}))
    got = {r["feature"]: r["mic"] for r in information.mic(df, "y", ["x", "noise"]).collect()}
    assert got["x"] > 0.8 > 0.5 > got["noise"]


def test_equal_anchors_get_the_same_result_once_each(spark):
    anchors = spark.createDataFrame([("a", D(2024, 1, 1)), ("a", D(2024, 1, 1)), ("b", None)], "k string, day date")
    events = spark.createDataFrame([("a", D(2024, 1, 5), 7)], "k string, at date, v int")
    found = temporal.interval_match(anchors, events, "k", "day", "at", days=10, aggs={"n": F.count("*"), "s": F.sum("v")})
    assert sorted((r.k, r.n, r.s) for r in found.collect()) == [("a", 1, 7), ("a", 1, 7), ("b", None, None)]


def test_nationality_levels_stay_with_their_row(spark):
    from casewise.operators.people import nationality_levels_join

    rows = spark.createDataFrame([(1, ["X"]), (1, ["Z"]), (1, ["Z", "Y"]), (2, []), (3, None)], "id int, codes array<string>")
    levels = spark.createDataFrame([("X", "High"), ("Y", "Medium"), ("Z", "Low")], "code string, level string")
    found = nationality_levels_join(rows, "codes", levels, "worst").collect()
    assert sorted(r.worst for r in found) == ["High", "Low", "Medium", "Undefined", "Undefined"]
    assert {r.worst for r in found if r.codes == ["Z"]} == {"Low"}


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlations_use_the_rows_of_each_pair(spark, monkeypatch, wide, method):
    if wide and method == "spearman":
        pytest.skip("pairs with NULLs always rank two columns")
    if wide:
        monkeypatch.setattr(stats, "NATIVE_COLUMNS", 1)
    rng = np.random.default_rng(3)
    data = pd.DataFrame(rng.normal(size=(300, 4)), columns=["y", "x", "z", "flat"])
    data["x"] += data["y"]
    data["flat"] = 2.0
    data.loc[rng.random(300) < 0.5, "z"] = np.nan
    data.loc[rng.random(300) < 0.2, "x"] = np.nan
    got = stats.to_matrix(getattr(stats, method)(spark.createDataFrame(data), list(data)), list(data))
    want = data.corr(method).to_numpy()
    assert np.allclose(got, want, equal_nan=True)


def test_measures_of_a_feature_ignore_the_others(spark):
    rng = np.random.default_rng(5)
    data = pd.DataFrame({"y": rng.normal(size=400)})
    data["x"] = data["y"] + rng.normal(size=400)
    data["holes"] = np.where(rng.random(400) < 0.9, np.nan, data["y"])
    df = spark.createDataFrame(data).replace(float("nan"), None)
    for measure in (information.spearman_sq, information.mic):
        alone = dict(map(tuple, measure(df, "y", ["x"]).collect()))
        both = dict(map(tuple, measure(df, "y", ["x", "holes"]).collect()))
        assert alone["x"] == both["x"] and set(both) == {"x", "holes"}


def test_linear_scores_hand_rows_through_unchanged_for_large_models(spark):
    values = [(i, i % 2, float(i), T(2024, 1, 1, 0, 0, 0, 123456), bytes([0, 255, i]), None if i % 3 else "x") for i in range(20)]
    df = spark.createDataFrame(values, "id long, cluster long, x double, at timestamp_ntz, raw binary, note string")
    models = spark.createDataFrame(
        [(c, "bad", [0.1, 0.02 * (c + 1)], [[0.01, 0.0], [0.0, 0.01]]) for c in (0,)],
        "cluster long, reward string, beta array<double>, cov array<array<double>>",
    )
    plain = bandit.lin_ts(df, models, "cluster", "id", ["x"], ["bad"])
    spread = bandit.lin_ts(df, models, "cluster", "id", ["x"], ["bad"], model_numbers=0, chunk_rows=3)
    assert spread.schema.simpleString() == plain.schema.simpleString()
    found = rows(spread, "id")
    assert found == rows(plain, "id") and [r[:6] for r in found] == values
    assert all((r[6] is None) == (r[1] == 1) for r in found)


def test_spearman_of_many_columns_with_nulls(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(300, 20)) + rng.normal(size=(300, 1)), 1)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 7] = 3.0
    names = [f"c {i}" for i in range(20)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in [*x, *x[:50]]], ", ".join(f"`{n}` double" for n in names))
    expected = pd.DataFrame(np.concatenate([x, x[:50]]), columns=names).corr("spearman").to_numpy()
    context = spark.sparkContext
    for options in ({}, {"one_task": 20, "slices": 7}):
        context.setJobGroup("ranks", "")
        found = stats.spearman(df, names, **options)
        assert len(context.statusTracker().getJobIdsForGroup("ranks")) <= 20
        context.setJobGroup("rest", "")
        matrix = stats.to_matrix(found, names)
        matrix[7, 7] = np.nan
        np.testing.assert_allclose(matrix, expected, atol=1e-9)


@pytest.mark.parametrize("native, shared, joined", [(12, 200_000, 2), (1, 200_000, 2), (12, 60, 2), (1, 0, 0)])
def test_ranks_with_nulls_agree_however_they_reach_the_rows(spark, monkeypatch, native, shared, joined):
    rng = np.random.default_rng(9)
    data = pd.DataFrame({"few": rng.integers(0, 5, 400) * 1.0, "some": rng.integers(0, 9, 400) * 1.0, "many": rng.normal(size=400)})
    data["also"] = np.round(data["many"] + rng.normal(size=400), 2)
    data = data.mask(rng.random(data.shape) < 0.3)
    data = pd.concat([data, data[:90]], ignore_index=True)
    df = spark.createDataFrame(data).replace(float("nan"), None)
    monkeypatch.setattr(stats, "NATIVE_COLUMNS", native)
    monkeypatch.setattr(stats, "SHARED_RANKS", shared)
    monkeypatch.setattr(stats, "JOINED_COLUMNS", joined)
    found = stats.to_matrix(stats.spearman(df, list(data), one_task=50, slices=7), list(data))
    np.testing.assert_allclose(found, data.corr("spearman").to_numpy(), atol=1e-9)


def test_ranks_of_few_values_leave_the_rows_in_place(spark):
    df = spark.range(1000).selectExpr("if(id % 7 = 0, null, id % 5) * 1D AS a", "id % 11 * 1D AS b", "if(id % 3 = 0, null, id % 4) * 1D AS c")
    text = stats.spearman(df, ["a", "b", "c"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "hashpartitioning" not in text


def _exact_mic(x, y, alpha):
    """Every way of cutting one axis into runs of values, the other in equal frequency."""
    from itertools import combinations

    n, best = len(x), 0.0
    budget = max(n**alpha, 4.0)
    for fixed, free in ((x, y), (y, x)):
        steps = sorted(set(free))
        for rows in range(2, int(budget // 2) + 1):
            row = [int((sum(w < v for w in fixed) + sum(w == v for w in fixed) / 2) * rows / n) for v in fixed]
            for cuts in range(1, int(budget // rows)):
                for at in combinations(steps[1:], cuts):
                    cells = list(zip(row, (sum(v >= a for a in at) for v in free)))
                    info = sum(
                        cells.count(k) / n * np.log(cells.count(k) * n / (row.count(k[0]) * sum(c[1] == k[1] for c in cells))) for k in set(cells)
                    )
                    best = max(best, info / np.log(min(rows, cuts + 1)))
    return best


def test_mic_is_the_best_over_all_cuts(spark):
    x = [3.0, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8]
    y = [2.0, 7, 1, 8, 2, 8, 1, 8, 2, 8, 4, 5]
    z = [v * v for v in x]
    rows = [*zip(y, x, z, range(12)), (1.0, None, None, None), (None, 1.0, 1.0, 1)]
    df = spark.createDataFrame([(*map(lambda v: None if v is None else float(v), r), 1.0) for r in rows], "y double, x double, z double, i double, one double")
    got = {parts: {r["feature"]: r["mic"] for r in information.mic(df.repartition(parts), "y", ["x", "z", "i", "one"], alpha=0.95).collect()} for parts in (1, 5)}
    assert got[1] == got[5]
    for name, values in (("x", x), ("z", z), ("i", list(range(12)))):
        assert got[1][name] == pytest.approx(_exact_mic(values, y, 0.95), abs=1e-4), name
    assert got[1]["one"] == 0.0
    assert information.mic(df.where("false"), "y", ["x"]).collect() == []


def test_kmeans_persists_its_vectors_itself(spark, monkeypatch):
    """From a persisted frame KMeans would decode every vector again in each step; columns are persisted once for all starts."""
    from casewise.operators import clusters

    seen = []

    class Watched(clusters.KMeans):
        def fit(self, frame):
            level = frame.storageLevel
            seen.append((level.useMemory or level.useDisk, "InMemoryRelation" in frame._jdf.queryExecution().withCachedData().toString()))
            return super().fit(frame)

    monkeypatch.setattr(clusters, "KMeans", Watched)
    df = spark.createDataFrame([(float(i % 2 * 10 + i % 3), float(i % 5)) for i in range(60)], "a double, b double")
    model = clusters.fit_kmeans(df, ["a", "b"], 2, restarts=3)
    assert seen == [(False, True)] * 3
    assert sorted(round(c[0]) for c in clusters.centers_of(model)) == [1, 11]
