"""Information value and other feature-to-target measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.catalog.registry import Tables, query, r6
from casewise.operators.information import iv_class, iv_group, iv_reg, mic, spearman_sq
from casewise.operators.stats import pearson, spearman

_ROWS = """
SELECT CASE WHEN l_quantity + 300 * l_discount > 45 AND l_linenumber > 2 THEN 2
            WHEN l_tax + l_discount > 0.09 OR l_partkey % 5 = 0 THEN 1 ELSE 0 END AS y,
       l_extendedprice AS target, l_quantity AS quantity, l_discount * 1000 + l_quantity AS mixed,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax END AS tax, l_linenumber::DOUBLE AS line,
       CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_extendedprice - 900 * l_quantity END AS gap
FROM lineitem"""
FEATURES = ["quantity", "mixed", "tax", "line", "gap"]


def _rows(t: Tables) -> DataFrame:
    q, d, tax = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    top = (q + 300 * d > 45) & (F.col("l_linenumber") > 2)
    some = (tax + d > 0.09) | (F.col("l_partkey") % 5 == 0)
    return t.lineitem.select(
        F.when(top, 2).when(some, 1).otherwise(0).alias("y"),
        F.col("l_extendedprice").alias("target"),
        q.alias("quantity"),
        (d * 1000 + q).alias("mixed"),
        F.when(F.col("l_linenumber") != 7, tax).alias("tax"),
        F.col("l_linenumber").cast("double").alias("line"),
        F.when(F.col("l_partkey") % 11 != 0, F.col("l_extendedprice") - 900 * q).alias("gap"),
    )


def _binned_sql(target: str) -> str:
    """Long (feature, bin, y): median fill, raw values up to ten, else five quantile bins."""
    parts = []
    for c in FEATURES:
        parts.append(f"""
SELECT '{c}' AS feature, y, CASE WHEN few THEN x ELSE len(list_filter(q, lambda v: v > lo AND x > v)) END::DOUBLE AS bin
FROM (SELECT {target} AS y, coalesce({c}, med) AS x FROM src, (SELECT median({c}) AS med FROM src)) f,
     (SELECT count(DISTINCT x) <= 10 AS few, min(x) AS lo, list_distinct(quantile_cont(x, [0.2, 0.4, 0.6, 0.8])) AS q
      FROM (SELECT coalesce({c}, med) AS x FROM src, (SELECT median({c}) AS med FROM src))) e""")
    return f"src AS ({_ROWS}), binned AS (" + "\nUNION ALL ".join(parts) + ")"


_LABEL = """CASE WHEN iv >= 0.5 THEN 'suspecious' WHEN iv >= 0.3 THEN 'strong' WHEN iv >= 0.1 THEN 'medium'
  WHEN iv >= 0.02 THEN 'weak' ELSE 'useless' END AS strength"""


@query(f"""
WITH {_binned_sql('y')},
cells AS (SELECT feature, bin, y, count(*) AS n FROM binned GROUP BY 1, 2, 3),
wide AS (SELECT *, sum(n) OVER (PARTITION BY feature, bin) AS size, sum(n) OVER (PARTITION BY feature, y) AS events,
                sum(n) OVER (PARTITION BY feature) AS total, count(*) OVER (PARTITION BY feature, bin) AS present FROM cells),
terms AS (SELECT feature, bin, max(CASE WHEN size > n THEN ((size - n) / (total - events) - n / events)
            * ln(((size - n) / (total - events)) / (n / events)) END) AS term, min(present) AS present FROM wide GROUP BY 1, 2),
ivs AS (SELECT feature, (min(present) < 3)::INT AS zero_cell,
               CASE WHEN min(present) = 3 THEN round_even(sum(term), 3)::DOUBLE END AS iv FROM terms GROUP BY 1)
SELECT feature, iv, zero_cell, {_LABEL} FROM ivs""")
def information_value_of_classes(t: Tables) -> DataFrame:
    return iv_class(_rows(t), "y", FEATURES).withColumn("zero_cell", F.col("zero_cell").cast("int"))


@query(f"""
WITH {_binned_sql('target')},
cells AS (SELECT feature, bin, count(*) AS n, sum(y) AS mass FROM binned GROUP BY 1, 2),
shares AS (SELECT feature, n / sum(n) OVER (PARTITION BY feature) AS pop, mass / sum(mass) OVER (PARTITION BY feature) AS resp FROM cells),
ivs AS (SELECT feature, 0 AS zero_cell, round_even(sum((pop - resp) * ln(pop / resp)), 3)::DOUBLE AS iv FROM shares GROUP BY 1)
SELECT feature, iv + 0.0 AS iv, zero_cell, {_LABEL} FROM ivs""")
def information_value_of_amount(t: Tables) -> DataFrame:
    found = iv_reg(_rows(t), "target", FEATURES)
    return found.withColumn("zero_cell", F.col("zero_cell").cast("int")).withColumn("iv", F.col("iv") + F.lit(0.0))


@query("""
SELECT c_custkey, CASE WHEN x >= 0.5 THEN 'suspecious' WHEN x >= 0.3 THEN 'strong' WHEN x >= 0.1 THEN 'medium'
  WHEN x >= 0.02 THEN 'weak' ELSE 'useless' END AS strength FROM (SELECT c_custkey, c_acctbal / 10000 AS x FROM customer)""")
def strength_labels(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", iv_group(F.col("c_acctbal") / 10000).alias("strength"))


def _rank_sql(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query(f"WITH src AS ({_ROWS})\n" + "\nUNION ALL ".join(f"""
SELECT '{c}' AS feature, round_even(corr(x, y) ** 2, 3)::DOUBLE AS r2
FROM (SELECT {_rank_sql('target')} AS y, {_rank_sql(c)} AS x FROM src WHERE {c} IS NOT NULL)""" for c in FEATURES))
def squared_rank_correlation(t: Tables) -> DataFrame:
    return spearman_sq(_rows(t), "target", FEATURES)


_PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i:]]


@query(f"WITH src AS ({_ROWS})\n" + "\nUNION ALL ".join(
    f"SELECT '{a}' AS var_i, '{b}' AS var_j, round(corr({a}, {b}), 6) AS r FROM src" for a, b in _PAIRS
))
def pearson_of_columns_with_nulls(t: Tables) -> DataFrame:
    return pearson(_rows(t), FEATURES).select("var_i", "var_j", r6("r").alias("r"))


@query(f"WITH src AS ({_ROWS})\n" + "\nUNION ALL ".join(f"""
SELECT '{a}' AS var_i, '{b}' AS var_j, round(corr(x, y), 6) AS r
FROM (SELECT {_rank_sql(a)} AS x, {_rank_sql(b)} AS y FROM src WHERE {a} IS NOT NULL AND {b} IS NOT NULL)""" for a, b in _PAIRS))
def spearman_of_columns_with_nulls(t: Tables) -> DataFrame:
    return spearman(_rows(t), FEATURES).select("var_i", "var_j", r6("r").alias("r"))


@query()
def maximal_information(t: Tables) -> DataFrame:
    return mic(_rows(t), "target", FEATURES)
