"""Correlation tables and what is derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.catalog.registry import Tables, query, r6
from casewise.operators.selection import (
    encode_target,
    explained_variance,
    feature_cluster_report,
    feature_clusters,
    feature_matrix,
    select_supervised,
    select_unsupervised,
    vif,
)
from casewise.operators.stats import covariance, pearson, spearman, sscp

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pairs_sql(cols: list[str], measure: str, table: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{a}' AS var_i, '{b}' AS var_j, {measure.format(a=a, b=b)} AS v FROM {table}"
        for i, a in enumerate(cols)
        for b in cols[i:]
    )


@query(_pairs_sql(LINE, "round(corr({a}, {b}), 6)", "lineitem"))
def pearson_of_line_columns(t: Tables) -> DataFrame:
    return pearson(t.lineitem, LINE).select("var_i", "var_j", r6("r").alias("v"))


@query("WITH r AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in LINE
) + " FROM lineitem)\n" + _pairs_sql(LINE, "round(corr({a}, {b}), 6)", "r"))
def spearman_of_line_columns(t: Tables) -> DataFrame:
    return spearman(t.lineitem, LINE).select("var_i", "var_j", r6("r").alias("v"))


@query(_pairs_sql(LINE, "round(covar_samp({a}, {b}), 4) + 0.0", "lineitem"))
def covariance_of_line_columns(t: Tables) -> DataFrame:
    return covariance(t.lineitem, LINE).select("var_i", "var_j", (F.round("cov", 4) + F.lit(0.0)).alias("v"))


@query(_pairs_sql(["l_quantity", "l_discount", "l_tax"], "round(avg({a} * {b}), 6)", "lineitem"))
def cross_products_of_line_columns(t: Tables) -> DataFrame:
    return sscp(t.lineitem, ["l_quantity", "l_discount", "l_tax"]).select("var_i", "var_j", r6("sscp").alias("v"))


EMBEDDED = [f"e{i}" for i in range(64)]


def _embedded(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(EMBEDDED)])


@query("""
WITH long AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT 'e' || a.i AS var_i, 'e' || b.i AS var_j, round(corr(a.x, b.x), 6) AS v
FROM long a JOIN long b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY 1, 2""")
def pearson_of_embedding_columns(t: Tables) -> DataFrame:
    return pearson(_embedded(t), EMBEDDED).select("var_i", "var_j", r6("r").alias("v"))


_MIXED = """
SELECT l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_quantity * 800 + l_extendedprice AS s,
       l_tax + l_discount AS td, l_extendedprice * (1 - l_discount) AS net FROM lineitem"""
MIXED = ["q", "p", "d", "s", "td", "net"]


def _mixed(t: Tables) -> DataFrame:
    q, p, d = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount")
    return t.lineitem.select(
        q.alias("q"), p.alias("p"), d.alias("d"), (q * 800 + p).alias("s"), (F.col("l_tax") + d).alias("td"), (p * (1 - d)).alias("net")
    )


@query(f"""
WITH m AS ({_MIXED}), r AS (SELECT corr(q, s) AS a, corr(q, td) AS b, corr(s, td) AS c FROM m)
SELECT 'q' AS feature, round(1 / (1 - (a * a + b * b - 2 * a * b * c) / (1 - c * c)), 2) AS vif FROM r
UNION ALL SELECT 's', round(1 / (1 - (a * a + c * c - 2 * a * b * c) / (1 - b * b)), 2) FROM r
UNION ALL SELECT 'td', round(1 / (1 - (b * b + c * c - 2 * a * b * c) / (1 - a * a)), 2) FROM r""")
def variance_inflation(t: Tables) -> DataFrame:
    return vif(_mixed(t), ["q", "s", "td"])


@query()
def variance_inflation_of_embeddings(t: Tables) -> DataFrame:
    return vif(_embedded(t), EMBEDDED)


@query(f"""
WITH m AS ({_MIXED}), r AS (SELECT 1 + corr(p, q) ** 2 + corr(p, d) ** 2 + corr(p, s) ** 2 + corr(p, td) ** 2 + corr(p, net) ** 2 AS g FROM m)
SELECT round(g, 3) AS explained, 6.0::DOUBLE AS total, round(g / 6, 3) AS ratio FROM r""")
def variance_explained_by_one(t: Tables) -> DataFrame:
    return explained_variance(_mixed(t), MIXED, ["p"]).select(
        "explained", "total", "ratio"
    )


def _two_picks_sql(cols: list[str], goal: list[str]) -> str:
    """Two greedy steps: the second works on what the first pick leaves unexplained."""
    names = list(dict.fromkeys([*cols, *goal]))
    pairs = "\nUNION ALL ".join(
        f"SELECT '{a}' AS i, '{b}' AS j, {names.index(a)} AS pi, {'avg(1.0::DOUBLE)' if a == b else f'corr({a}, {b})'} AS r FROM m"
        for a in names
        for b in names
    )
    inside = ", ".join(f"'{g}'" for g in goal)
    open_ = ", ".join(f"'{c}'" for c in cols)
    return f"""
WITH m AS ({_MIXED}), r AS ({pairs}),
one AS (SELECT i, any_value(pi) AS pi, sum(r * r) AS gain FROM r WHERE i IN ({open_}) AND j IN ({inside}) GROUP BY i),
best AS (SELECT i, gain FROM one ORDER BY gain DESC, pi LIMIT 1),
rest AS (SELECT r.i, r.j, r.pi, r.r - a.r * b.r AS v FROM r JOIN best ON true JOIN r a ON a.i = best.i AND a.j = r.i JOIN r b ON b.i = best.i AND b.j = r.j),
two AS (SELECT x.i, any_value(x.pi) AS pi, sum(x.v * x.v / d.v) AS gain FROM rest x JOIN rest d ON d.i = x.i AND d.j = x.i
        WHERE x.i IN ({open_}) AND x.j IN ({inside}) AND d.v > 1e-10 GROUP BY x.i),
next AS (SELECT i, gain FROM two ORDER BY gain DESC, pi LIMIT 1)
SELECT 1 AS step, i AS feature, round_even(gain / {len(goal)}, 4)::DOUBLE AS var_exp FROM best
UNION ALL SELECT 2, next.i, round_even((best.gain + next.gain) / {len(goal)}, 4)::DOUBLE FROM next, best"""


_UNSUPERVISED = ["q", "p", "d", "td"]


@query(_two_picks_sql(_UNSUPERVISED, _UNSUPERVISED))
def features_keeping_most_variance(t: Tables) -> DataFrame:
    return select_unsupervised(_mixed(t), _UNSUPERVISED, maxeffects=2, varexp=2.0, tol=-1.0)


@query(_two_picks_sql(["q", "p", "d", "td"], ["s"]))
def features_explaining_amount(t: Tables) -> DataFrame:
    return select_supervised(_mixed(t), ["q", "p", "d", "td"], "s", "Continuous", maxeffects=2, varexp=2.0, tol=-1.0)


@query()
def features_explaining_label(t: Tables) -> DataFrame:
    return select_supervised(_embedded(t), EMBEDDED, "label", "Class")


@query()
def embedding_features_keeping_most_variance(t: Tables) -> DataFrame:
    return select_unsupervised(_embedded(t), EMBEDDED)


@query("""
WITH c AS (SELECT o_orderstatus AS s, count(*) AS n, sum(count(*)) OVER () AS t FROM orders GROUP BY 1),
v AS (SELECT s, (1 / sqrt(t)) * (sqrt(t / n) - sqrt(n / t)) AS inside, -(1 / sqrt(t)) * sqrt(n / t) AS outside FROM c)
SELECT o_orderkey, round(CASE WHEN o_orderstatus = 'F' THEN f.inside ELSE f.outside END, 6) AS o_orderstatus_0,
  round(CASE WHEN o_orderstatus = 'O' THEN o.inside ELSE o.outside END, 6) AS o_orderstatus_1,
  round(CASE WHEN o_orderstatus = 'P' THEN p.inside ELSE p.outside END, 6) AS o_orderstatus_2
FROM orders, (SELECT * FROM v WHERE s = 'F') f, (SELECT * FROM v WHERE s = 'O') o, (SELECT * FROM v WHERE s = 'P') p""")
def centred_class_indicators(t: Tables) -> DataFrame:
    rows, names = encode_target(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus")
    return rows.select("o_orderkey", *[r6(n).alias(n) for n in names])


@query(f"""
WITH m AS ({_MIXED})
SELECT 'q' AS feature, 0 AS dropped FROM m WHERE q IS NOT NULL GROUP BY 1
UNION ALL SELECT 'p', (abs(corr(q, p)) > 0.8)::INT FROM m
UNION ALL SELECT 'd', (greatest(abs(corr(q, d)), abs(corr(p, d))) > 0.8)::INT FROM m
UNION ALL SELECT 's', (greatest(abs(corr(q, s)), abs(corr(p, s)), abs(corr(d, s))) > 0.8)::INT FROM m
UNION ALL SELECT 'td', (greatest(abs(corr(q, td)), abs(corr(p, td)), abs(corr(d, td)), abs(corr(s, td))) > 0.8)::INT FROM m
UNION ALL SELECT 'net', (greatest(abs(corr(q, net)), abs(corr(p, net)), abs(corr(d, net)), abs(corr(s, net)), abs(corr(td, net))) > 0.8)::INT FROM m""")
def columns_dropped_as_duplicates(t: Tables) -> DataFrame:
    matrix = feature_matrix(_mixed(t), MIXED, cutoff=0.8)
    rows = [(c, int(c in matrix.dropped)) for c in MIXED]
    return t.spark.createDataFrame(rows, "feature string, dropped int")


_BLOCKS = "SELECT p_size AS a, 2 * p_size + 1 AS b, p_retailprice AS c, 5 - p_retailprice AS d, p_retailprice * 3 AS e FROM part"
BLOCKS = ["a", "b", "c", "d", "e"]


def _blocks(t: Tables) -> DataFrame:
    size, price = F.col("p_size"), F.col("p_retailprice")
    return t.part.select(size.alias("a"), (2 * size + 1).alias("b"), price.alias("c"), (5 - price).alias("d"), (price * 3).alias("e"))


@query()
def correlated_feature_groups(t: Tables) -> DataFrame:
    return feature_clusters(_blocks(t), BLOCKS)


@query(f"""
WITH m AS ({_BLOCKS})
SELECT 'a' AS feature, round(abs(corr(a, b)), 6) AS score FROM m UNION ALL SELECT 'b', round(abs(corr(a, b)), 6) FROM m
UNION ALL SELECT 'c', round(abs(corr(c, d)) + abs(corr(c, e)), 6) FROM m
UNION ALL SELECT 'd', round(abs(corr(d, c)) + abs(corr(d, e)), 6) FROM m
UNION ALL SELECT 'e', round(abs(corr(e, c)) + abs(corr(e, d)), 6) FROM m""")
def feature_group_report(t: Tables) -> DataFrame:
    return feature_cluster_report(_blocks(t), BLOCKS, method="correlation").select("feature", r6("score").alias("score"))


@query()
def embedding_feature_group_report(t: Tables) -> DataFrame:
    return feature_cluster_report(_embedded(t), EMBEDDED)
