"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, learned from document labels.

A sentence has its words and their beginnings of 4 to 6 letters as features, so that rare forms of a stem count
together. Spark counts in how many sampled documents a feature occurs and how many of these are toxic; the
``FEATURES`` that stand out most are fitted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.llm.common import body, saved

SAMPLE_DOCS = 8_000
FEATURES = 5_000
LEAST_DOCS = 4
STANDS_OUT = 3.0  # standard deviations above the share of toxic documents
STARTS = (4, 5, 6)
STEPS = 300
CACHE = 300_000
RATE = 0.1
DECAY = 2e-4
SPARSE = 2e-3
SENTENCE = r"[^.!?\n]+"
WORD = r"[\p{L}\p{M}']+"


def sentences(text: str | None, find_sentence, find_word) -> list[tuple[int, int, list[str]]]:
    """``(start, end, words)`` of each sentence with words; at least one entry, so that empty texts have a score."""
    out = []
    for m in find_sentence(text or ""):
        if found := find_word(m.group().lower()):
            out.append((m.start(), m.end(), found))
    return out or [(0, 0, [])]


def _finders():
    import regex

    return regex.compile(SENTENCE).finditer, regex.compile(WORD).findall


def features(words: list[str]) -> list[str]:
    """Distinct words, and beginnings of longer ones marked by ``^``."""
    return list(dict.fromkeys([*words, *("^" + w[:n] for w in words for n in STARTS if len(w) >= n)]))


def chosen(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``toxic, text`` of at most ``sample`` labelled rows: those of the least hashes. Only ids and hashes are shuffled."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text", F.lit(11)).alias("_hash"), body().alias("text"))
    named = labels.where("toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    keys = rows.select("doc_id", "_hash").join(named, "doc_id").distinct().orderBy("_hash", "doc_id", "toxic").limit(sample)
    # At most ``sample`` rows of three numbers; repeated rows of a text are one.
    return rows.join(F.broadcast(saved(keys)), ["doc_id", "_hash"]).select("doc_id", "_hash", "toxic", "text").dropDuplicates(["doc_id", "_hash", "toxic"])


def train(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE_DOCS) -> dict[str, float]:
    """Feature weights (and the bias under ``""``) from texts of ``doc_id, text`` with labels of ``doc_id, toxic`` (without: a column of the texts).

    Fits on at most ``sample`` labelled rows, chosen by a hash; a null label or id is left out, repeated rows count
    once. Features of fewer than ``LEAST_DOCS`` sampled documents, and those that are not toxic more often
    than chance explains, get no weight. Each document's loss is the log loss of ``1 - prod(1 - p)`` over its sentences.
    Only numbers come to the driver: a row per sentence with any chosen feature.
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find_sentence, find_word = _finders()
        for frame in frames:
            for doc, toxic, text in zip(frame["doc"], frame["toxic"], frame["text"]):
                parts = [features(w) for _, _, w in sentences(text, find_sentence, find_word)]
                yield pd.DataFrame({"doc": doc, "toxic": toxic, "part": range(len(parts)), "found": parts})

    texts = chosen(docs, docs if labels is None else labels, sample).select(F.xxhash64("doc_id", "_hash", "toxic").alias("doc"), "toxic", "text")
    parts = saved(texts.mapInPandas(cut, "doc long, toxic int, part int, found array<string>"))
    about = {r["doc"]: (r["toxic"], r["n"]) for r in parts.groupBy("doc").agg(F.first("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).collect()}
    if not about:
        return {"": -4.0}
    share = min(max(sum(t for t, _ in about.values()) / len(about), 1e-3), 1 - 1e-3)
    seen = parts.select("doc", "toxic", F.explode("found").alias("name")).distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad"))
    lead = (F.col("bad") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    best = saved(seen.select("name", "n", lead.alias("lead")).where((F.col("n") >= LEAST_DOCS) & (F.col("lead") >= STANDS_OUT)).orderBy(F.desc("lead"), "name").limit(FEATURES))
    names = sorted(r["name"] for r in best.collect())
    number = {name: i for i, name in enumerate(names)}
    rows = parts.select("doc", "part", F.explode("found").alias("name")).join(F.broadcast(best), "name").groupBy("doc", "part").agg(F.collect_list("name").alias("names"))
    order = {doc: i for i, doc in enumerate(sorted(about))}
    doc, sent, cols = [], [], []
    for i, row in enumerate(sorted(rows.collect(), key=lambda r: (r["doc"], r["part"]))):
        ids = sorted(number[n] for n in row["names"])
        sent += [i] * len(ids)
        cols += ids
        doc.append(order[row["doc"]])
    part, doc, sent, cols = len(doc), np.array(doc, np.int64), np.array(sent, np.int64), np.array(cols, np.int64)
    label = np.array([about[d][0] for d in sorted(about)], float)
    plain = np.array([about[d][1] for d in sorted(about)], float) - np.bincount(doc, minlength=len(about))
    weight, bias = np.zeros(len(number)), -5.0
    first, second = np.zeros(len(number) + 1), np.zeros(len(number) + 1)
    for at in range(1, STEPS + 1):
        z = bias + np.bincount(sent, weight[cols], minlength=part)
        p, p0 = 1 / (1 + np.exp(-np.clip(z, -30, 30))), 1 / (1 + np.exp(-bias))
        none = np.exp(-np.bincount(doc, np.logaddexp(0, z), minlength=len(label)) - plain * np.logaddexp(0, bias))
        pull = np.where(label == 1, -none / np.maximum(1 - none, 1e-6), 1.0) / len(label)
        slope = p * pull[doc]
        grad = np.append(np.bincount(cols, slope[sent], minlength=len(number)) + DECAY * weight, slope.sum() + (plain * pull).sum() * p0)
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        move = RATE * (first / (1 - 0.9**at)) / (np.sqrt(second / (1 - 0.99**at)) + 1e-6)
        weight, bias = weight - move[:-1], bias - move[-1]
        weight = np.sign(weight) * np.maximum(np.abs(weight) - RATE * SPARSE, 0)
    return {"": float(bias)} | {w: float(weight[i]) for w, i in number.items() if abs(weight[i]) > 1e-3}


def score(docs: DataFrame, model: dict[str, float], offending: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` and ``offending`` (start, end, score of sentences at or above the bound) added.

    Null and empty texts get the score of a sentence without known features; every sentence of a long text counts, and
    equal texts get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, offending array<struct<start:int,end:int,score:double>>")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        find_sentence, find_word = _finders()
        weights = shared.value
        bias = weights[""]
        known: dict[str, tuple[str, ...]] = {}  # weighted features of a word
        for texts in parts:
            scores, spans = [], []
            for text in texts:
                none, found = 0.0, []
                if len(known) > CACHE:
                    known.clear()
                for start, end, words in sentences(text, find_sentence, find_word):
                    for word in words:
                        if word not in known:
                            known[word] = tuple(f for f in features([word]) if f in weights)
                    met = {f for word in words for f in known[word]}
                    z = max(-30.0, min(30.0, bias + sum(weights[f] for f in sorted(met))))
                    none -= math.log1p(math.exp(z))
                    if (p := 1 / (1 + math.exp(-z))) >= offending:
                        found.append({"start": start, "end": end, "score": p})
                scores.append(-math.expm1(none))
                spans.append(found)
            yield pd.DataFrame({"score": scores, "offending": spans})

    return docs.withColumn("_judged", judge("text")).select(*docs.columns, "_judged.score", "_judged.offending")


def held_out(col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(col).cast("string")), F.lit(5)) == 0
