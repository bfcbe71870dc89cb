"""N-gram Jaccard join: MinHash banding, verification on full n-gram sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.llm.common import row_key, saved

GRAM = 5
SIMILARITY = 0.8
RECALL = 0.9999
HASHES = 128
BLOCK_ROWS = 1024
BLOCK_GRAMS = 2_000_000
CACHE = 300_000
ODD = np.uint64(0x9E3779B97F4A7C15)


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows per band that still reach the recall within the hash budget."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        miss = 1 - similarity**rows
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(miss))) if miss > 0 else 1
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def gram_set(text: str | None, find, digests: dict[bytes, int], gram: int = GRAM) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams, each mixed from the hashes of its words in order; a shorter text is one gram."""
    import xxhash

    words = find(text.encode("utf-8", "surrogatepass").lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(digests) > CACHE:
        digests.clear()
    for word in set(words).difference(digests):
        digests[word] = xxhash.xxh3_64_intdigest(word)
    each = np.fromiter(map(digests.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - gram + 1)
    mixed = np.full(n, min(gram, len(words)), np.uint64)
    for i in range(min(gram, len(words))):
        mixed = (mixed ^ each[i : i + n]) * ODD
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _tools():
    """A finder of words in lower-case UTF-8, and an empty store of their hashes."""
    import re

    return re.compile(rb"[0-9a-z\x80-\xff]+").findall, {}


def signatures(docs: DataFrame, bands: int, rows: int, gram: int = GRAM) -> DataFrame:
    """``doc_id, k, sh, n, bands``: the row's key, a digest of the n-gram set, its size, and one hash per band."""

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, digests = _tools()
        draw = np.random.default_rng(7)
        a = draw.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        mix = draw.integers(1, 1 << 62, rows, dtype=np.uint64) | np.uint64(1)
        for frame in frames:
            out = []
            for text in frame["text"]:
                grams = gram_set(text, find, digests, gram)
                if not len(grams):
                    out.append((None, 0, None))
                    continue
                low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
                for part in range(0, len(grams), 512):
                    # Products wrap at 2**64.
                    low = np.minimum(low, (grams[part : part + 512, None] * a + b).min(axis=0))
                keys = (low.reshape(bands, rows) * mix).sum(axis=1, dtype=np.uint64)
                keys ^= keys >> np.uint64(29)
                out.append((hashlib.md5(grams.tobytes()).hexdigest(), len(grams), keys.view(np.int64)))
            yield pd.DataFrame(
                {"doc_id": frame["doc_id"].astype("Int64"), "k": frame["k"], "sh": [r[0] for r in out], "n": [r[1] for r in out], "bands": [r[2] for r in out]}
            )

    rows_of = docs.select(F.col("doc_id").cast("string"), row_key().alias("k"), "text")
    return rows_of.mapInPandas(sign, "doc_id long, k long, sh string, n long, bands array<bigint>")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 columns in slices of the shared grams."""
    m = len(sets)
    rows = np.repeat(np.arange(m), [len(s) for s in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[at]
    rows, cols = rows[keep], number[at[keep]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    out = np.zeros((m, m), np.float32)
    for first in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(cols, [first, first + 4096])
        flags = np.zeros((m, 4096), np.float32)
        flags[rows[lo:hi], cols[lo:hi] - first] = 1
        out += flags @ flags.T
    return out


def _verified(similarity: float, gram: int):
    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        find, digests = _tools()
        frame = frame.sort_values("sh", ignore_index=True)
        m, band, i, j = len(frame), int(frame["band"][0]), int(frame["i"][0]), int(frame["j"][0])
        sets = [gram_set(t, find, digests, gram) for t in frame["text"]]
        sizes = np.array([len(s) for s in sets], float)
        common = overlaps(sets)
        near = common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-6
        np.fill_diagonal(near, False)
        side = frame["blk"].to_numpy()
        if i != j:
            near &= side[:, None] != side[None, :]
        keys = np.stack(frame["bands"].to_numpy())
        for earlier in range(band):
            near &= keys[:, None, earlier] != keys[None, :, earlier]
        links = near @ frame["copies"].to_numpy(dtype=np.int64)
        root = np.arange(m)
        while True:
            reach = np.where(near, root[None, :], m).min(axis=1, initial=m)
            new = np.minimum(root, reach)
            new = new[new]
            if (new == root).all():
                break
            root = new
        some = links > 0
        names = frame["sh"].to_numpy()
        return pd.DataFrame({"sh": names[some], "links": links[some], "root": names[root[some]]})

    return verify


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the least node of each connected component of ``a, b`` edges.

    Labels spread to neighbours and then jump to their label's label, until no label changes.
    """
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        spread = (
            both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        )
        moved = labels.join(spread, F.col("node") == F.col("a"), "left").select(
            "node", F.least("label", "near").alias("label"), F.col("label").alias("old")
        )
        jump = moved.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        new = saved(
            moved.join(jump, F.col("label") == F.col("_n"), "left").select("node", F.least("label", "_l").alias("label"), "old")
        )
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, gram: int = GRAM, recall: float = RECALL) -> DataFrame:
    """``doc_id, class_id, n_links`` per row of ``doc_id, text``; see :func:`classes`."""
    return classes(docs, similarity, gram, recall).select("doc_id", "class_id", "n_links")


def classes(docs: DataFrame, similarity: float = SIMILARITY, gram: int = GRAM, recall: float = RECALL) -> DataFrame:
    """``doc_id, k, class_id, n_links, chosen`` per row of ``doc_id, text``; ``k`` is its ``row_key``.

    Texts with equal n-gram sets are one vertex with a number of copies. Vertices meet in band
    buckets; a bucket is cut into blocks and each pair of blocks is one task's work, so a hot bucket
    spreads. A pair counts in the first band it shares. ``n_links`` counts other rows at or above the
    similarity, equal texts included; ``class_id`` is the least id of the linked group. A row without words
    (null, empty) is a class of its own with no links; a null id is kept, and its class is the least other id.
    ``chosen`` marks one key per class, the first by (id with nulls last, key); repeated rows share their key.
    """
    bands, rows = bands_for(similarity, recall)
    signed = saved(signatures(docs, bands, rows, gram))
    groups = signed.where("sh is not null").groupBy("sh").agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "k")).alias("top"), F.min("k").alias("k"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    groups = saved(groups)
    placed = groups.select("sh", "n", F.posexplode("bands").alias("band", "h"))
    buckets = (
        placed.groupBy("band", "h")
        .agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("grams"), F.bit_xor(F.xxhash64("sh")).alias("who"))
        .where("m > 1")
        .groupBy("m", "grams", "who")
        .agg(F.min(F.struct("band", "h")).alias("b"))
        .select("b.band", "b.h", F.greatest(F.ceil(F.col("m") / BLOCK_ROWS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    )
    blk = F.pmod(F.xxhash64("sh", F.lit(3)), F.col("blocks")).cast("int")
    member = saved(placed.join(buckets, ["band", "h"]).select("sh", "band", "h", "blocks", blk.alias("blk")))
    wanted = groups.join(member.select("sh").distinct(), "sh", "left_semi").select("sh", "k", "copies", "bands")
    one = docs.select(row_key().alias("k"), "text").join(wanted, "k").dropDuplicates(["sh"])
    work = (
        member.join(one, "sh")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("sh", "band", "h", "blk", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "copies", "bands", "text")
    )
    found = saved(work.groupBy("band", "h", "i", "j").applyInPandas(_verified(similarity, gram), "sh string, links long, root string"))
    links = found.groupBy("sh").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("sh").alias("a"), F.col("root").alias("b")))
    vertices = groups.select("sh", "copies", "least", "top").join(links, "sh", "left").join(labels.withColumnRenamed("node", "sh"), "sh", "left")
    vertices = saved(vertices.withColumn("label", F.coalesce("label", "sh")))
    named = vertices.groupBy("label").agg(F.min("least").alias("class_id"), F.min("top").getField("k").alias("top"))
    placed_rows = vertices.drop("top").join(named, "label").select("sh", "class_id", "top", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return signed.select("doc_id", "k", "sh").join(placed_rows, "sh", "left").select(
        "doc_id",
        "k",
        F.when(F.col("sh").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("k") == F.col("top"), F.lit(True)).alias("chosen"),
    )

