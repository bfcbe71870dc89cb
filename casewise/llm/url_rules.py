"""URL filters: fixed host rules, and association rules mined from the URLs they label [native]."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise.llm.common import UPPER, body, saved, small

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
SUPPORT = 0.01
CONFIDENCE = 0.8
DEFAULT = "allow"


def host_of(url: str = "url") -> Column:
    return F.translate(F.regexp_extract(body(url), r"(?s)^.*?://([^/?#]*)", 1), UPPER, UPPER.lower())


def path_of(url: str = "url") -> Column:
    return F.regexp_extract(body(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(rules=RULES) -> Column:
    """The longest rule that fits ``host, path``; null if none does."""
    chain = None
    for rule, _ in sorted(rules, key=lambda r: -len(r[0])):
        host, path = rule.split("/", 1)
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        chain = F.when(fits, rule) if chain is None else chain.when(fits, rule)
    return chain


def tokens() -> Column:
    """Host labels with their place from the right, and path words without digits."""
    labels = F.reverse(F.filter(F.split("host", r"\."), lambda p: p != ""))
    places = F.transform(labels, lambda p, i: F.concat(F.lit("h"), i.cast("string"), F.lit("="), p))
    parts = F.filter(F.split(F.lower("path"), r"[^\p{L}]+"), lambda p: p != "")
    return F.array_distinct(F.concat(places, F.transform(parts, lambda p: F.concat(F.lit("p="), p))))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame | None:
    """``antecedent, verdict, confidence, support, key`` from ``tokens, verdict``; None without labelled rows.

    ``key`` is the antecedent's rarest token: the one under which the inverted index lists the rule.
    """
    if labelled.isEmpty():
        return None
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("verdict="), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    mined = saved(
        model.associationRules.where(F.col("consequent")[0].startswith("verdict="))
        .where(~F.exists("antecedent", lambda t: t.startswith("verdict=")))
        .select("antecedent", F.substring(F.col("consequent")[0], 9, 100).alias("verdict"), "confidence", "support")
    )
    rarest = (
        mined.select("antecedent", F.explode("antecedent").alias("token"))
        .join(single, "token")
        .groupBy("antecedent")
        .agg(F.min(F.struct("freq", "token"))["token"].alias("key"))
    )
    return mined.join(rarest, "antecedent")


def judge(pages: DataFrame, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE, default: str = DEFAULT) -> DataFrame:
    """``page_id, host, path, rule, verdict`` per row of ``page_id, url``.

    URLs that a fixed rule fits carry its verdict and are the labelled rows to mine from. Others take the verdict of
    the matching mined rule with the highest confidence (then longest, best supported, block first),
    and ``default`` if none matches. A null url or one without ``://`` has empty host and path;
    repeated rows are judged alike; with no labelled rows only the default remains.
    """
    rows = pages.select("page_id", host_of().alias("host"), path_of().alias("path")).withColumn("rule", fitting_rule(rules))
    names = F.create_map(*[F.lit(x) for pair in rules for x in pair])
    rows = rows.withColumn("fixed", names[F.col("rule")]).withColumn("tokens", tokens())
    mined = mine(rows.where("rule is not null").select("tokens", F.col("fixed").alias("verdict")), support, confidence)
    if mined is None:
        return rows.select("page_id", "host", "path", "rule", F.lit(default).alias("verdict"))
    index = small(saved(mined))
    rows = rows.withColumn("_k", F.xxhash64("host", "path"))
    order = F.struct("confidence", F.size("antecedent"), "support", (F.col("verdict") == "block"), "verdict")
    found = (
        rows.where("rule is null")
        .select("_k", "tokens")
        .dropDuplicates(["_k"])
        .select("_k", "tokens", F.explode("tokens").alias("key"))
        .join(index, "key")
        .where(F.size(F.array_except("antecedent", "tokens")) == 0)
        .groupBy("_k")
        .agg(F.max(order)["verdict"].alias("mined"))
    )
    return rows.join(found, "_k", "left").select("page_id", "host", "path", "rule", F.coalesce("fixed", "mined", F.lit(default)).alias("verdict"))
