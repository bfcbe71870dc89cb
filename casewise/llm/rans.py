"""Token ids in blocks of a static range asymmetric numeral system.

File format: a folder of Parquet tables. ``table`` holds the shared quantised frequencies
(token id, frequency; they sum to 2**BITS). ``packed`` holds, per shard, a row for each document in
order (seq, doc_id, first token, n_tokens; no payload) and a row for each block (seq, first token,
payload). ``first`` counts the shard's tokens: a block's is a checkpoint at which decoding can begin.
A payload is, little-endian: magic ``RNS1``, u32 tokens, u32 lanes, u32 words, u32 crc32 of the ids,
u32 crc32 of the rest; one u64 state per lane; the u32 words that lanes read in turn.
Lane ``l`` holds tokens ``l, l + lanes, ...`` of its block.
"""

from __future__ import annotations

import json
import re
import string
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewise.llm.common import body, small

END = 1
BITS = 20
LOW = 1 << 31
BLOCK = 1 << 16
CHARS = 4_000_000  # bytes of text a task encodes at once
CACHE = 600_000  # words and other runs a task remembers
AT_ONCE = 250  # words the library encodes as one text
MARKS = "".join(sorted(set(string.punctuation) - {"'"}))
# Latin letters keep to one letter each in lower case and NFC, but for U+0130.
LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c != "\u0130")
SEPARATORS = "[\x1c-\x1f]"
# Patterns of pre-tokenizers whose matches hold no white space and do not look at it.
WITHOUT_SPACE = {"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
ARROW = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}
HEAD = "<4sIIIII"
HEAD_SIZE = struct.calcsize(HEAD)


def by_runs(state: dict) -> bool:
    """Whether the ids of a text are those of its runs between white space, in either case: the normalizer lower-cases, the
    pre-tokenizer keeps no white space, its patterns look at none, and no added token holds or borders on any or begins
    with a letter."""
    steps = (state["pre_tokenizer"] or {}).get("pretokenizers", [])
    first = steps[0] if steps else {}
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and first["pattern"].get("Regex") in WITHOUT_SPACE
    plain = all(s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in steps[1:])
    normal = [s["type"] for s in (state["normalizer"] or {}).get("normalizers", [])]
    lowers = "Lowercase" in normal and set(normal) <= {"NFC", "Replace", "Lowercase"}
    added = all(
        not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"][:1].isalpha()) and t["content"].split() == [t["content"]]
        for t in state["added_tokens"]
    )
    return bool(drops and plain and lowers and added)


def tokenizer_file(path: str | None) -> str:
    import public_tokenizers

    return path or public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=8)
def tokenizer_facts(path: str | None = None) -> tuple[str, bool, np.ndarray]:
    """What tasks need to know of a tokenizer, found out once on the driver: the type of its ids, two bytes if its vocabulary
    allows it, else four; :func:`by_runs`; and which pieces end a word."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file(path))
    size = tokenizer.get_vocab_size()
    ends = np.zeros(size, bool)
    for piece, i in tokenizer.get_vocab().items():
        if i < size:
            ends[i] = piece.endswith("</w>")
    return "<u2" if size <= 1 << 16 else "<u4", by_runs(json.loads(tokenizer.to_str())), ends


def id_type(path: str | None = None) -> str:
    return tokenizer_facts(path)[0]


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def in_a_row(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of a pool one behind the other, and where each begins, the end last."""
    done = np.concatenate([[0], np.cumsum(sizes)])
    return pool[np.repeat(starts - done[:-1], sizes) + np.arange(done[-1])], done


class Encoder:
    """Ids of texts. The library encodes each distinct run between white space once, where ``split`` allows it; runs are counted,
    cut into letters and marks, and their ids put together in arrays, and the ids of words and other runs are kept for the next texts."""

    def __init__(self, tokenizer, kind: str, split: bool, ends: np.ndarray):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.kind, self.split, self.ends = tokenizer, kind, split, ends
        self.forget()
        if split:
            # The same model for lower-case words of plain letters, which the normalizer leaves as they are and the patterns whole.
            self.spaced = Tokenizer(tokenizer.model)
            steps = json.loads(tokenizer.pre_tokenizer.__getstate__())["pretokenizers"][1:]
            bytes_of = [pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False) for _ in steps]
            self.spaced.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), *bytes_of])

    def forget(self) -> None:
        """Known cells are numbered; their ids lie in a row in ``pool``."""
        self.store: dict[str, int] = {}
        self.pool, self.sizes = np.zeros(0, self.kind), np.zeros(0, np.int64)

    def apart(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of each text's."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), self.kind, sizes.sum()), sizes

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of plain letters, encoded as one text and cut behind the pieces that end a word, unless a word has several ends."""
        ids = np.array(self.spaced.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.kind)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(cuts, prepend=0)) if len(cuts) == len(words) and cuts[-1] == len(ids) else self.apart(words)

    def known(self, cells: list[str], words: np.ndarray) -> np.ndarray:
        """Numbers of distinct cells; new ones are learned, as words where ``words`` says so."""
        numbers = list(map(self.store.get, cells))
        new = [i for i, number in enumerate(numbers) if number is None]
        if new:
            new = [i for i in new if words[i]] + (rest := [i for i in new if not words[i]])
            asked = [cells[i] for i in new]
            n_words = len(new) - len(rest)
            parts = [self.words(asked[a : min(a + AT_ONCE, n_words)]) for a in range(0, n_words, AT_ONCE)] + [self.apart(asked[n_words:])]
            first = len(self.sizes)
            self.pool = np.concatenate([self.pool, *[ids for ids, _ in parts]])
            self.sizes = np.concatenate([self.sizes, *[sizes for _, sizes in parts]])
            self.store.update(zip(asked, range(first, len(self.sizes))))
            for number, i in enumerate(new, first):
                numbers[i] = number
        return np.array(numbers, np.int64)

    def of_runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct runs in a row, and the number of each run's."""
        # A word with marks behind it is two pre-tokens: letters never join with the marks.
        marks = pc.utf8_ltrim(runs, characters=LETTERS)
        size, tail = pc.binary_length(runs).to_numpy(), pc.binary_length(marks).to_numpy()
        plain = (tail < size) & (pc.binary_length(pc.utf8_rtrim(marks, characters=MARKS)).to_numpy() == 0)
        is_plain = pa.array(plain)
        heads = pc.if_else(is_plain, pc.utf8_lower(pc.utf8_rtrim(runs, characters=MARKS)), runs).dictionary_encode()
        tails = pc.if_else(is_plain, marks, "").dictionary_encode()
        head, tail = heads.indices.to_numpy(), tails.indices.to_numpy()
        words = np.zeros(len(heads.dictionary), bool)
        words[head] = plain  # other runs are no plain letters, so no cell is both
        if len(self.store) > CACHE:
            self.forget()
        # Each run is its head and its tail.
        head = self.known(strings(heads.dictionary), words)[head]
        tail = self.known(strings(tails.dictionary), np.zeros(len(tails.dictionary), bool))[tail]
        at = np.column_stack([head, tail]).ravel()
        ids, _ = in_a_row(self.pool, (np.cumsum(self.sizes) - self.sizes)[at], self.sizes[at])
        return ids, self.sizes[head] + self.sizes[tail]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of each text's."""
        if not self.split:
            runs = pa.array([[text] for text in texts.to_pylist()], pa.list_(pa.string()))
        elif pc.any(pc.match_substring_regex(texts, SEPARATORS)).as_py():
            # Separators that are white space to Python and Arrow but not to the pre-tokenizer stay for the library.
            separated = re.compile(SEPARATORS)
            runs = pa.array([[text] if separated.search(text) else text.split() for text in texts.to_pylist()], pa.list_(pa.string()))
        else:
            runs = pc.utf8_split_whitespace(texts)
        cells = runs.flatten().dictionary_encode()
        pool, sizes = self.of_runs(cells.dictionary) if self.split else self.apart(strings(cells.dictionary))
        at = cells.indices.to_numpy()
        ids, done = in_a_row(pool, (np.cumsum(sizes) - sizes)[at], sizes[at])
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(runs).to_numpy())])
        return ids, np.diff(done[ends])


def tokenized(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """``doc_id, ids`` (little-endian of :func:`id_type`, the end id last); null is the empty text."""
    kind, split, ends = tokenizer_facts(path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        encoder = Encoder(Tokenizer.from_file(tokenizer_file(path)), kind, split, ends)
        for batch in batches:
            # A part begins with each text that starts in another piece of CHARS bytes.
            size = pc.binary_length(batch.column(1)).to_numpy()
            piece = (np.cumsum(size, dtype=np.int64) - size) // CHARS
            starts = np.flatnonzero(np.diff(piece, prepend=-1))
            for a, b in zip(starts, [*starts[1:], len(size)]):
                part = batch.slice(a, b - a)
                ids, n = encoder.encode(part.column(1))
                whole = np.full(len(ids) + len(n), end, kind)
                whole[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                cuts = (np.concatenate([[0], np.cumsum(n + 1)]) * whole.itemsize).astype(np.int32)
                column = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(cuts), pa.py_buffer(whole)])
                yield pa.RecordBatch.from_arrays([part.column(0), column], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), body().alias("text")).mapInArrow(encode, "doc_id long, ids binary")


def token_counts(tokens: DataFrame, kind: str = "<u4") -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            column = batch.column(0)
            if not len(column):
                continue
            # The ids of all rows lie in one buffer.
            cuts = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            got = np.bincount(np.frombuffer(column.buffers()[2], kind, (cuts[-1] - cuts[0]) // np.dtype(kind).itemsize, cuts[0]))
            if len(got) > len(total):
                got[: len(total)] += total
                total = got
            else:
                total[: len(got)] += got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    return tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def quantised(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies of at least 1 that sum to ``2**bits``, in proportion to positive counts."""
    room = (1 << bits) - len(counts)
    if room < 0:
        raise ValueError("more symbols than slots")
    exact = counts / counts.sum() * room
    freq = np.floor(exact).astype(np.int64)
    extra = np.argsort(freq - exact, kind="stable")[: room - int(freq.sum())]
    freq[extra] += 1
    return freq + 1


class Coder:
    """Encoder and decoder of one block, all lanes at once."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray, bits: int = BITS):
        self.bits, self.ids = np.uint64(bits), ids.astype(np.uint32)
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(ids), dtype=np.int32), freq)
        self.rank = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.int64)
        self.rank[ids] = np.arange(len(ids))

    def encode(self, tokens: np.ndarray) -> bytes:
        n = len(tokens)
        lanes = max(1, min(1024, n // 64))
        ranks = self.rank[tokens]
        freq, start = self.freq.take(ranks), self.start.take(ranks)
        limit, rest = freq << (np.uint64(63) - self.bits), (np.uint64(1) << self.bits) - freq
        state = np.full(lanes, LOW, np.uint64)
        words = []
        for at in range((n - 1) // lanes * lanes, -1, -lanes):
            f = freq[at : at + lanes]
            x = state[: len(f)]
            full = np.flatnonzero(x >= limit[at : at + lanes])
            out = x[full]
            words.append(out.astype("<u4"))
            x[full] = out >> np.uint64(32)
            # (x // f << bits) + x % f + start
            x += x // f * rest[at : at + lanes]
            x += start[at : at + lanes]
        flat = np.concatenate(words[::-1])
        rest = state.astype("<u8").tobytes() + flat.tobytes()
        check = zlib.crc32(tokens.astype("<u4").tobytes())
        return struct.pack(HEAD, b"RNS1", n, lanes, len(flat), check, zlib.crc32(rest)) + rest

    def decode(self, payload: bytes) -> np.ndarray:
        magic, n, lanes, n_words, check, outer = struct.unpack_from(HEAD, payload)
        if magic != b"RNS1" or zlib.crc32(payload[HEAD_SIZE :]) != outer:
            raise ValueError("damaged block")
        state = np.frombuffer(payload, "<u8", lanes, HEAD_SIZE).astype(np.uint64)
        words = np.frombuffer(payload, "<u4", n_words, HEAD_SIZE + 8 * lanes).astype(np.uint64)
        out, used = np.zeros(n, np.int64), 0
        mask = np.uint64((1 << int(self.bits)) - 1)
        for at in range(0, n, lanes):
            x = state[: min(lanes, n - at)]
            slot = x & mask
            rank = self.slot.take(slot.view(np.int64)).astype(np.int64)
            x >>= self.bits
            x *= self.freq.take(rank)
            x += slot
            x -= self.start.take(rank)
            thin = np.flatnonzero(x < LOW)
            take = len(thin)
            x[thin] = (x[thin] << np.uint64(32)) | words[used : used + take]
            used += take
            out[at : at + len(x)] = rank
        tokens = self.ids[out]
        if zlib.crc32(tokens.astype("<u4").tobytes()) != check:
            raise ValueError("damaged block")
        return tokens


def write(docs: DataFrame, folder: str, path: str | None = None) -> None:
    """Encodes ``doc_id, text`` rows in ascending id order (null first, equal ids by their tokens) into the format above."""
    spark = docs.sparkSession
    tokenized(docs, path).write.parquet(f"{folder}/tokens")
    tokens = spark.read.parquet(f"{folder}/tokens")
    kind = id_type(path)
    counts = token_counts(tokens, kind).orderBy("id").toPandas()
    ids = counts["id"].to_numpy()
    freq = quantised(counts["n"].to_numpy()) if len(ids) else np.zeros(0, np.int64)
    spark.createDataFrame([(int(i), int(f)) for i, f in zip(ids, freq)], "id long, freq long").coalesce(1).write.parquet(f"{folder}/table")
    shared = spark.sparkContext.broadcast((ids, freq))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(*shared.value)
        shard = TaskContext.get().partitionId()
        seq = first = block = done = 0
        held: list[np.ndarray] = []
        names = ["shard", "seq", "doc_id", "first", "n_tokens", "payload"]

        def blocks(finish: bool) -> list[tuple]:
            nonlocal block, done, held
            tokens = np.concatenate(held) if held else np.zeros(0, np.uint32)
            whole = len(tokens) if finish else len(tokens) // BLOCK * BLOCK
            out = []
            for at in range(0, whole, BLOCK):
                some = tokens[at : min(at + BLOCK, whole)]
                out.append((shard, block, None, done, None, coder.encode(some)))
                block, done = block + 1, done + len(some)
            held = [tokens[whole:]]
            return out

        for frame in frames:
            rows, waiting = [], sum(map(len, held))
            for doc_id, raw in zip(frame["doc_id"], frame["ids"]):
                n = len(raw) // np.dtype(kind).itemsize
                rows.append((shard, seq, doc_id, first, n, None))
                seq, first, waiting = seq + 1, first + n, waiting + n
                held.append(np.frombuffer(raw, kind))
                if waiting >= BLOCK:
                    rows += blocks(False)
                    waiting = len(held[0])
            yield pd.DataFrame(rows, columns=names)
        yield pd.DataFrame(blocks(True), columns=names)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    packed = ordered.select(F.col("doc_id").cast("string"), "ids").mapInPandas(
        pack, "shard int, seq long, doc_id string, first long, n_tokens long, payload binary"
    )
    packed.write.parquet(f"{folder}/packed")
    raw = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/tokens")  # packed by now
    raw.getFileSystem(spark._jsc.hadoopConfiguration()).delete(raw, True)


def _pieces(spark: SparkSession, folder: str, fields: dict[str, str], piece) -> tuple[DataFrame, DataFrame]:
    """Documents with their first token in the whole file, and ``fields`` of the decoded pieces that their blocks hold of them."""
    packed = spark.read.parquet(f"{folder}/packed")
    rows = spark.read.parquet(f"{folder}/table").orderBy("id").toPandas()
    shared = spark.sparkContext.broadcast((rows["id"].to_numpy(), rows["freq"].to_numpy()))
    heads = packed.where("payload is null").select("shard", "seq", F.col("doc_id").cast("long"), "first", "n_tokens")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        heads.groupBy("shard").agg(F.sum("n_tokens").alias("_n")).withColumn("base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    )
    # A document's pieces: one row for each block that holds some of its ids.
    last = F.floor((F.col("first") + F.col("n_tokens") - 1) / BLOCK)
    kinds = [ARROW[kind] for kind in fields.values()]
    cut = heads.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), last)))
    wanted = cut.groupBy("shard", "block").agg(F.sort_array(F.collect_list(F.struct("seq", "first", "n_tokens"))).alias("docs"))
    blocks = packed.where("payload is not null").select("shard", F.col("seq").alias("block"), "payload")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*shared.value)
        for batch in batches:
            shards, numbers, payloads = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "block", "payload"))
            seqs, firsts, sizes = (batch.column(c) for c in ("seqs", "firsts", "sizes"))
            n, found = pc.list_value_length(seqs).to_numpy(), []
            seqs, firsts, sizes = (column.flatten().to_numpy() for column in (seqs, firsts, sizes))
            ends = np.cumsum(n)
            for number, payload, a, b in zip(numbers.tolist(), payloads, ends - n, ends):
                tokens = coder.decode(payload).astype("<u4")
                at = firsts[a:b] - number * BLOCK
                cuts = zip(np.maximum(at, 0).tolist(), np.minimum(at + sizes[a:b], len(tokens)).tolist())
                found += [piece(tokens[x:y].tobytes()) for x, y in cuts]
            values = [pa.array(column, kind) for column, kind in zip(zip(*found), kinds)] if found else [pa.array([], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(shards, n), pa.int32()), pa.array(np.repeat(numbers, n), pa.int64()), pa.array(seqs, pa.int64()), *values],
                names=["shard", "block", "seq", *fields],
            )

    lists = [F.col("docs.seq").alias("seqs"), F.col("docs.first").alias("firsts"), F.col("docs.n_tokens").alias("sizes")]
    schema = ", ".join(["shard int, block long, seq long", *(f"{name} {kind}" for name, kind in fields.items())])
    parts = blocks.join(wanted.select("shard", "block", *lists), ["shard", "block"]).mapInArrow(unpack, schema)
    placed = heads.join(bases, "shard").select("shard", "seq", "doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens")
    return placed, parts


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``shard, seq, doc_id, start, n_tokens, ids`` of each document, decoded from its blocks; ids are u32 little-endian.

    Null ids come first and keep their place; an empty text has its end id alone; equal ids are in the order they were written.
    """
    placed, parts = _pieces(spark, folder, {"part": "binary"}, lambda part: (part,))
    whole = parts.groupBy("shard", "seq").agg(F.sort_array(F.collect_list(F.struct("block", "part"))).alias("_p"))
    ids = F.aggregate("_p", F.lit(b""), lambda a, p: F.concat(a, p.part))
    return placed.join(whole, ["shard", "seq"]).select(*placed.columns, ids.alias("ids"))


def joined_crc(pieces: list) -> int:
    """crc32 of byte strings in a row from ``(crc32, length)`` of each: crc32 is linear but for its start."""
    total = pieces[0][0]
    for crc, size in pieces[1:]:
        zeros = bytes(size)
        total = zlib.crc32(zeros, total) ^ zlib.crc32(zeros) ^ crc
    return total


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """``shard, seq, doc_id, start, n_tokens, ids_crc32`` as :func:`read` decodes them; ids stay in the tasks, only checksums of pieces travel."""

    def piece(part: bytes) -> tuple[int, int]:
        return zlib.crc32(part), len(part)

    @F.pandas_udf("long")
    def joined(lists: pd.Series) -> pd.Series:
        return pd.Series([joined_crc([(p["crc"], p["size"]) for p in some]) for some in lists], dtype="int64")

    placed, parts = _pieces(spark, folder, {"crc": "long", "size": "int"}, piece)
    whole = parts.groupBy("shard", "seq").agg(F.sort_array(F.collect_list(F.struct("block", "crc", "size"))).alias("_p"))
    return placed.join(whole, ["shard", "seq"]).select(*placed.columns, joined("_p").alias("ids_crc32"))
