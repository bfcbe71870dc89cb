"""Context-tree weighting over bytes: log probabilities of texts, learned from a corpus.

A symbol is a byte of the UTF-8 text with A-Z lower-cased; 0xFF, which no text holds, ends a text and stands
for the bytes before its start. A byte is coded as eight binary decisions. The decision after the bit prefix
``j`` has a context tree of its own: its nodes are the last 0 to ``DEPTH`` bytes. With ``KT`` the
Krichevsky-Trofimov probability of a node's bits,

    weighted(node) = KT(node)                                      at depth DEPTH
    weighted(node) = KT(node) / 2 + prod weighted(children) / 2    above

A text's probability is the product over its bits of weighted(root with the bit) / weighted(root), the trees
staying as learned. KT depends on counts alone, so learning is counting: each block of texts is reduced to its
distinct (DEPTH + 1)-grams, their counts are summed by a shuffle, and each task weighs the whole subtrees of some
two-byte contexts (at most 2**(8 * (DEPTH - 1)) grams in one). Depths 0 and 1 have at most 65,535 nodes; these alone
are gathered and broadcast. Scores of grams go back to the blocks that hold them, so no task needs the whole model.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewise.llm.common import saved, shared_folder

DEPTH = 4
PAD = b"\xff"
BLOCK_BYTES = 16_000_000
STEP_BYTES = 2_000_000
RUN_GRAMS = 100_000
PACK_ROWS = 500_000
HALF = np.log(0.5)
LN10 = np.log(10.0)
SHIFTS = np.arange(8, 0, -1)


def pieces(texts: list[bytes], size: int = STEP_BYTES) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts with their ends in runs of about ``size`` bytes: whose each piece is, and the piece after ``DEPTH`` bytes before it."""
    owners, parts, total = [], [], 0
    for i, text in enumerate(texts):
        whole = PAD * DEPTH + text + PAD
        for a in range(0, len(text) + 1, size):
            owners.append(i)
            parts.append(whole[a : a + size + DEPTH])
            total += len(parts[-1])
            if total >= size:
                yield owners, parts
                owners, parts, total = [], [], 0
    if owners:
        yield owners, parts


def laid_out(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams of the joined pieces as integers; where those of each piece begin and end."""
    flat = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    grams = flat[: len(flat) - DEPTH].copy()
    for i in range(1, DEPTH + 1):
        grams <<= 8
        grams |= flat[i : len(flat) - DEPTH + i]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(sizes) - sizes
    return grams, starts, starts + sizes - DEPTH


def gram_counts(texts: list[bytes], counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of all texts and how often the ``counted`` texts hold each (0: only the others do)."""
    keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for owners, parts in pieces(texts):
        grams, starts, ends = laid_out(parts)
        inside = np.zeros(len(grams) + 1, np.int8)
        mark = 1 + counted[owners].astype(np.int8)
        np.add.at(inside, starts, mark)
        np.add.at(inside, ends, -mark)
        inside = np.cumsum(inside[:-1], dtype=np.int8)
        for times, place in ((0, inside == 1), (1, inside == 2)):
            new, n = np.unique(grams[place], return_counts=True)
            keys, sums = np.concatenate([keys, new]), np.concatenate([sums, n * times])
        keys, at = np.unique(keys, return_inverse=True)
        sums = np.bincount(at, sums, len(keys)).astype(np.int64)
    return keys, sums


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps up; good to 1e-12 from 0.5 on."""
    product = np.ones_like(x)
    for i in range(8):
        product = product * (x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a bit string with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


class Level:
    """The nodes of one depth: sorted codes (context, bit prefix), counts, KT and weighted probabilities."""

    def __init__(self, contexts: np.ndarray, symbols: np.ndarray, counts: np.ndarray):
        prefix = (symbols[:, None] | 256) >> SHIFTS
        bits = (symbols[:, None] >> (SHIFTS - 1)) & 1
        self.codes, at = np.unique((contexts[:, None] << 8 | prefix).ravel(), return_inverse=True)
        #: Node of each (gram, bit), and the bit.
        self.at, self.bits = at.reshape(prefix.shape), bits
        times = np.repeat(counts, 8).astype(float)
        flat = bits.ravel()
        self.ones = np.bincount(at, times * flat, len(self.codes))
        self.zeros = np.bincount(at, times * (1 - flat), len(self.codes))
        self.kt = log_kt(self.zeros, self.ones)
        self.weighted = self.kt

    def mix(self, below: Level, width: int) -> None:
        """Weighs in the children; codes of ``below`` have one context byte more, in front of ``width`` others."""
        mask = (1 << (8 * width + 8)) - 1
        parents = np.searchsorted(self.codes, below.codes & mask)
        self.weighted = HALF + np.logaddexp(self.kt, np.bincount(parents, below.weighted, len(self.codes)))

    def share(self) -> np.ndarray:
        """Weight of the node's own estimate against its children's."""
        return np.exp(HALF + self.kt - self.weighted)

    def chance(self) -> np.ndarray:
        """The estimate that the next bit is 1."""
        return (self.ones + 0.5) / (self.zeros + self.ones + 1)


def levels(grams: np.ndarray, counts: np.ndarray) -> dict[int, Level]:
    """Levels 2 to ``DEPTH`` of whole subtrees, weighed from below."""
    symbols, before = grams & 255, grams >> 8
    out = {d: Level(before & ((1 << 8 * d) - 1), symbols, counts) for d in range(2, DEPTH + 1)}
    for d in range(DEPTH - 1, 1, -1):
        out[d].mix(out[d + 1], d)
    return out


class Top:
    """Depths 0 and 1 as arrays by (last byte, bit prefix) and by bit prefix: own weight and chance of a 1."""

    def __init__(self, last: np.ndarray, prefix: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        kt = log_kt(zeros, ones)
        weighted = HALF + np.logaddexp(kt, below)
        n0, n1, under = (np.bincount(prefix, x, 256) for x in (zeros, ones, weighted))
        root = log_kt(n0, n1)
        self.share0, self.chance0 = np.exp(-np.logaddexp(0, under - root)), (n1 + 0.5) / (n0 + n1 + 1)
        self.share1, self.chance1 = np.full((256, 256), 0.5), np.full((256, 256), 0.5)
        self.share1[last, prefix] = np.exp(HALF + kt - weighted)
        self.chance1[last, prefix] = (ones + 0.5) / (zeros + ones + 1)

    def logs(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of each gram's last byte after the others."""
        found = levels(grams, counts)
        one = found[DEPTH].chance()[found[DEPTH].at]
        for d in range(DEPTH - 1, 1, -1):
            own = found[d].share()[found[d].at]
            one = own * found[d].chance()[found[d].at] + (1 - own) * one
        prefix = ((grams & 255)[:, None] | 256) >> SHIFTS
        last = (grams >> 8 & 255)[:, None]
        for own, chance in ((self.share1[last, prefix], self.chance1[last, prefix]), (self.share0[prefix], self.chance0[prefix])):
            one = own * chance + (1 - own) * one
        return np.log(np.where(found[DEPTH].bits == 1, one, 1 - one)).sum(axis=1) / LN10


def _whole(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    columns: list[list[np.ndarray]] = [[] for _ in names]
    for batch in batches:
        for held, name in zip(columns, names):
            held.append(batch.column(name).to_numpy(zero_copy_only=False))
    return [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams and counts of whole subtrees below two bytes, small ones together."""
    grams, counts = _whole(batches, ["gram", "n"])
    order = np.argsort(grams >> 8 & 0xFFFF, kind="stable")
    grams, counts = grams[order], counts[order]
    first = 0
    for end in [*(np.flatnonzero(np.diff(grams >> 8 & 0xFFFF)) + 1), len(grams)]:
        if end - first >= RUN_GRAMS or end == len(grams) > first:
            yield grams[first:end], counts[first:end]
            first = end


def _upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the depth-1 nodes, and the product of their children as far as this task has them."""
    for grams, counts in _subtrees(batches):
        two = levels(grams, counts)[2]
        nodes, at = np.unique(two.codes & 0xFFFF, return_inverse=True)
        sums = [np.bincount(at, x, len(nodes)) for x in (two.zeros, two.ones, two.weighted)]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), *map(pa.array, sums)], ["node", "zeros", "ones", "below"])


def packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write(rows)
    return sink.getvalue().to_pybytes()


def unpacked(payload: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(payload.as_buffer()).read_all()


def block_writer(lowered: DataFrame, folder: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``id, held_out, body`` written once as one row (``block, payload``) for about ``block_bytes`` of texts."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"block": uuid.uuid4().int >> 65, "payload": packed(pa.Table.from_batches(held))}])

        for batch in batches:
            first = 0
            for i, length in enumerate(pc.binary_length(batch.column("body")).to_pylist()):
                size += length + 1
                if size >= block_bytes:
                    held.append(batch.slice(first, i + 1 - first))
                    yield block()
                    held, size, first = [], 0, i + 1
            if first < batch.num_rows:
                held.append(batch.slice(first))
        if held:
            yield block()

    lowered.mapInArrow(pack, "block long, payload binary").write.parquet(f"{folder}/blocks")
    return lowered.sparkSession.read.parquet(f"{folder}/blocks")


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block: its distinct grams, and its distinct words under gram -1; the empty word is the end."""
    for batch in batches:
        for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
            rows = unpacked(payload)
            texts, counted = rows["body"].to_pylist(), ~rows["held_out"].to_numpy()
            keys, sums = gram_counts(texts, counted)
            seen, other = Counter(), set()
            for text, flag in zip(texts, counted):
                (seen if flag else other).update(text.split())
            seen[b""] = int(counted.sum())
            words = sorted(other.union(seen))
            n = len(keys) + len(words)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, block)),
                    pa.array(np.concatenate([keys, np.full(len(words), -1)])),
                    pa.array([None] * len(keys) + words, pa.binary()),
                    pa.array(np.concatenate([sums, np.fromiter((seen[w] for w in words), np.int64, len(words))])),
                ],
                ["block", "gram", "word", "n"],
            )


def _pack_by_block(kind: int, names: list[str]):
    """Rows of a task as one payload for each block (of at most ``PACK_ROWS`` rows at once); ``new`` sums a flag of the rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).sort_by("block").combine_chunks()
            blocks = rows["block"].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)]])
            parts = [rows.slice(a, b - a) for a, b in zip(cuts, cuts[1:])]
            fields = [pa.array(blocks[cuts[:-1]]), pa.array([kind] * len(parts), pa.int32()), pa.array([packed(p.select(names)) for p in parts], pa.binary())]
            if "new" in rows.column_names:
                return pa.RecordBatch.from_arrays([*fields, pa.array([int(p["new"].to_numpy().sum()) for p in parts])], ["block", "kind", "payload", "new"])
            return pa.RecordBatch.from_arrays(fields, ["block", "kind", "payload"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= PACK_ROWS:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return pack


def _judge(train_tokens: int, kinds: int):
    """Scores the texts of blocks; a block's grams and words come before its texts."""
    names = ["id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    floor = np.log10(train_tokens + kinds + 1)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, tables, words = None, [], {}
        for batch in batches:
            for at, kind, payload in zip(batch.column("block").to_pylist(), batch.column("kind").to_pylist(), batch.column("payload")):
                if at != block:
                    block, tables, words = at, [], {}
                rows = unpacked(payload)
                if kind == 0:
                    tables.append(rows)
                elif kind == 1:
                    words.update(zip(rows["word"].to_pylist(), np.log10(rows["n"].to_numpy() + 1).tolist()))
                else:
                    grams = pa.concat_tables(tables)
                    keys, logs = grams["gram"].to_numpy(), grams["log"].to_numpy()
                    order = np.argsort(keys)
                    yield scored(rows, keys[order], logs[order], words)

    def scored(rows: pa.Table, keys: np.ndarray, logs: np.ndarray, words: dict[bytes, float]) -> pa.RecordBatch:
        texts, out = rows["body"].to_pylist(), []
        scores = np.zeros(len(texts))
        for owners, parts in pieces(texts):
            grams, starts, ends = laid_out(parts)
            sums = np.concatenate([[0.0], np.cumsum(logs[np.searchsorted(keys, grams).clip(max=len(keys) - 1)])])
            np.add.at(scores, owners, sums[ends] - sums[starts])
        for text, score in zip(texts, scores):
            tokens = [*text.split(), b""]
            heights = list(map(words.__getitem__, tokens))  # log10(count + 1)
            out.append((len(tokens), len(tokens) - heights.count(0.0), sum(heights) - floor * len(tokens), score))
        types = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        judged = [pa.array(c, t) for c, t in zip(zip(*out), types)]
        whole = rows.combine_chunks()
        return pa.RecordBatch.from_arrays([whole["id"].chunk(0), whole["held_out"].chunk(0), *judged], names)

    return judge


def score(docs: DataFrame, held_out, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row of ``doc_id, text``.

    Learns from the rows where ``held_out`` is false, and counts every one of them. ``base_score`` is the add-one
    word model, ``score`` the context trees; both are log10. A null text is empty and has the end alone; a null
    ``held_out`` (of a null id) is true. Repeated rows count, and are scored, each time. Nothing learned gives
    equal chances to every bit. A long text is counted and scored whole, in pieces of ``STEP_BYTES``; an empty table
    gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/context-tree-{uuid.uuid4().hex}"
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    lowered = docs.select(F.col("doc_id").cast("string").alias("id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), low.cast("binary").alias("body"))
    blocks = block_writer(lowered, folder, block_bytes)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    blocks.mapInArrow(_gather, "block long, gram long, word binary, n long").write.parquet(f"{folder}/gathered")
    gathered = spark.read.parquet(f"{folder}/gathered")
    grams, words = gathered.where("gram >= 0").select("block", "gram", "n"), gathered.where("gram < 0").select("block", "word", "n")

    # A subtree below two bytes is whole in one task: bits 8 to 23 of a gram are those bytes.
    summed = grams.groupBy("gram").agg(F.sum("n").alias("n"))
    tree = saved(summed.repartition(parts, F.shiftright("gram", 8).bitwiseAND(0xFFFF)))
    upper = tree.mapInArrow(_upper, "node long, zeros double, ones double, below double").groupBy("node")
    top = upper.agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).toPandas()
    node = top["node"].to_numpy(np.int64)
    model = Top(node >> 8, node & 255, *(top[c].to_numpy(float) for c in ("zeros", "ones", "below")))  # goes with the tasks: four arrays of 65,536

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _subtrees(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(model.logs(keys, counts))], ["gram", "log"])

    form = "block long, kind int, payload binary"
    logs = grams.select("block", "gram").join(tree.mapInArrow(weigh, "gram long, log double"), "gram").select("block", "gram", "log")
    logs = logs.mapInArrow(_pack_by_block(0, ["gram", "log"]), form)

    alike = Window.partitionBy("word")
    counted = words.select("block", "word", F.sum("n").over(alike).alias("n"), F.row_number().over(alike.orderBy("block")).alias("row"))
    counted = counted.select("block", "word", "n", ((F.col("row") == 1) & (F.col("n") > 0)).cast("long").alias("new"))
    counted.mapInArrow(_pack_by_block(1, ["word", "n"]), f"{form}, new long").write.parquet(f"{folder}/words")
    counted = spark.read.parquet(f"{folder}/words")
    tokens = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kinds = counted.agg(F.coalesce(F.sum("new"), F.lit(0))).first()[0]

    together = logs.unionByName(counted.drop("new")).unionByName(blocks.select("block", F.lit(2).alias("kind"), "payload"))
    dealt = together.repartition(parts, "block").sortWithinPartitions("block", "kind")
    judged = dealt.mapInArrow(
        _judge(int(tokens), int(kinds)), "id string, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return judged.select(
        F.col("id").cast("long").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), "base_score", "score"
    )


def learnable(col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(col).cast("string")), F.lit(7)) != 2
