"""Language ID by unigram pieces, summed over all segmentations of each word."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise.llm.common import body
from casewise.llm.prefix_trie import DoubleArray

LETTERS = r"\p{L}[\p{L}\p{M}]*"
CHUNK = 32
UNKNOWN = 1e-8
SMOOTH = 1e-3
CACHE = 300_000
GROUP_CHARS = 2_000_000
SAMPLE_DOCS = 10_000  # of each language
HASHES = 1 << 62


def read_pieces(path: str | None = None) -> dict[str, int]:
    """Pieces of letters, lower case, from a public sentencepiece vocabulary."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    names = {model.id_to_piece(i).lower() for i in range(model.vocab_size())}
    return {name: i for i, name in enumerate(sorted(n for n in names if n.replace("▁", "").isalpha() or n == "▁"))}


def split_words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(body(text)), F.lit(LETTERS), F.lit(0))


def chunks(word: str) -> list[str]:
    """A marked word; a very long one as several, so that products stay above underflow."""
    word = "▁" + word
    return [word[i : i + CHUNK] for i in range(0, len(word), CHUNK)]


class PieceTrie:
    """The pieces as a double-array trie, so that a look-up stops at the first prefix that no piece has."""

    def __init__(self, pieces: dict[str, int]):
        letters = sorted({c for name in pieces for c in name})
        #: Codes of all code points; letters of no piece share one code without a child.
        self.codes = np.full(0x110000, len(letters), np.int32)
        self.codes[[ord(c) for c in letters]] = np.arange(len(letters))
        names = list(pieces)
        trie = DoubleArray([self.codes[[ord(c) for c in name]] for name in names])
        last = np.zeros(len(names), np.int64)
        for _, live, place in trie.walk():
            last[live] = place
        room = len(letters) + 1
        self.base = trie.base
        self.check = np.concatenate([trie.check, np.full(room, -1)])
        self.piece = np.full(len(self.check), -1, np.int32)
        self.piece[last] = [pieces[name] for name in names]
        self.longest = max(map(len, names), default=1)
        self.unknown = len(pieces)


def _grids(words: list[str], trie: PieceTrie, longest: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per word length: the words' indices and piece ids by (word, start, piece length - 1); -1 is no piece."""
    by_length: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        by_length.setdefault(len(word), []).append(i)
    for n, where in by_length.items():
        wide = min(n, longest or trie.longest)
        for part in range(0, len(where), 2048):
            some = where[part : part + 2048]
            codes = trie.codes[np.frombuffer("".join([words[i] for i in some]).encode("utf-32-le", "surrogatepass"), "<u4")]
            ids = np.full((len(codes), wide), -1, np.int32)
            live, state = np.arange(len(codes)), np.zeros(len(codes), np.int64)
            for size in range(1, wide + 1):
                fits = live % n + size <= n
                live, state = live[fits], state[fits]
                place = trie.base[state] + codes[live + size - 1]
                goes = trie.check[place] == state
                live, state = live[goes], place[goes]
                if not len(live):
                    break
                ids[live, size - 1] = trie.piece[state]
            ids[:, 0] = np.where(ids[:, 0] < 0, trie.unknown, ids[:, 0])
            yield np.asarray(some), ids.reshape(len(some), n, wide)


def _forward(ids: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Sums over all segmentations of each prefix: (word, end, language)."""
    rows, n, wide = ids.shape
    sums = np.zeros((rows, n + 1, probs.shape[1]))
    sums[:, 0] = 1.0
    for end in range(1, n + 1):
        for size in range(1, min(wide, end) + 1):
            sums[:, end] += sums[:, end - size] * probs[ids[:, end - size, size - 1]]
    return sums


def expected_counts(words: list[str], times: np.ndarray, trie: PieceTrie) -> np.ndarray:
    """Expected piece counts under equal piece probabilities (forward and backward sums)."""
    total = np.zeros(trie.unknown + 1)
    probs = np.full((trie.unknown + 2, 1), 1.0 / trie.unknown)
    probs[-2], probs[-1] = UNKNOWN, 0.0
    for where, ids in _grids(words, trie):
        rows, n, wide = ids.shape
        ahead = _forward(ids, probs)[:, :, 0]
        back = np.zeros((rows, n + 1))
        back[:, n] = 1.0
        for a in range(n - 1, -1, -1):
            for size in range(1, min(wide, n - a) + 1):
                back[:, a] += probs[ids[:, a, size - 1], 0] * back[:, a + size]
        scale = times[where] / ahead[:, n]
        after = np.minimum(np.arange(n)[:, None] + np.arange(1, wide + 1), n)
        share = (ahead[:, :n] * scale[:, None])[:, :, None] * probs[ids, 0] * back[:, after]
        keep = ids >= 0
        total += np.bincount(ids[keep], share[keep], minlength=len(total))
    return total


def train(docs: DataFrame, path: str | None = None, sample: int = SAMPLE_DOCS) -> tuple[list[str], dict[str, int], np.ndarray]:
    """Languages, pieces, and probabilities by (piece, language) from rows of ``doc_id, text, lang``.

    Fits on about ``sample`` rows of each language, those whose hash lies under the language's bound; on all of a language with fewer.
    Words are counted by Spark first, so each distinct word of a language is segmented once.
    The result has one row per vocabulary piece and one column per language.
    """
    pieces = read_pieces(path)
    spark = docs.sparkSession
    trie = PieceTrie(pieces)
    named = docs.where("lang is not null")
    bounds = [(r["lang"], HASHES * sample // max(r["count"], sample)) for r in named.groupBy("lang").count().collect()]
    limits = F.broadcast(spark.createDataFrame(bounds, "lang string, _bound long"))
    counted = (
        named.join(limits, "lang")
        .where(F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(HASHES)) < F.col("_bound"))
        .select("lang", F.explode(split_words("text")).alias("word"))
        .groupBy("lang", "word")
        .agg(F.count(F.lit(1)).alias("n"))
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    )

    def expect(frames):
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            for lang, part in frame.groupby("lang", sort=False):
                cut = [(c, n) for w, n in zip(part["word"], part["n"]) for c in chunks(w)]
                got = expected_counts([c for c, _ in cut], np.array([n for _, n in cut], float), trie)
                sums[lang] = sums[lang] + got if lang in sums else got
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "piece": at.astype("int64"), "n": total[at]})

    rows = counted.mapInPandas(expect, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((len(pieces) + 2, len(langs)))
    for k, lang in enumerate(langs):
        mine = rows[rows["lang"] == lang]
        counts[mine["piece"].to_numpy(), k] = mine["n"].to_numpy()
    known = counts[: len(pieces)]
    probs = np.zeros_like(counts)
    if langs:
        probs[: len(pieces)] = (1 - SMOOTH) * known / np.maximum(known.sum(axis=0), 1e-9) + SMOOTH / len(pieces)
    probs[len(pieces)] = UNKNOWN
    return langs, pieces, probs


def word_scores(words: list[str], pieces: dict[str, int] | PieceTrie, probs: np.ndarray, longest: int | None = None) -> np.ndarray:
    """Natural log of each word's probability, by language; with pieces of at most ``longest`` letters, if given."""
    trie = pieces if isinstance(pieces, PieceTrie) else PieceTrie(pieces)
    out = np.zeros((len(words), probs.shape[1]))
    for where, ids in _grids(words, trie, longest):
        out[where] = np.log(_forward(ids, probs)[:, -1])
    return out


class Scores:
    """Tokens seen by a task: the rows of ``logs`` (by language) of the letter runs in each."""

    def __init__(self, languages: int):
        import regex

        self.find, self.languages = regex.compile(LETTERS).findall, languages
        self.words: dict[str, list[int]] = {}
        self.rows: dict[str, int] = {}
        self.logs = np.zeros((0, languages))

    def add(self, tokens: set[str], trie: PieceTrie, probs: np.ndarray) -> None:
        if len(self.words) + len(tokens.difference(self.words)) > CACHE:
            self.words, self.rows, self.logs = {}, {}, np.zeros((0, self.languages))
        new = []
        for token in tokens.difference(self.words):
            found = self.find(token)
            for word in found:
                if word not in self.rows:
                    self.rows[word] = len(self.rows)
                    new.append(word)
            self.words[token] = [self.rows[word] for word in found]
        cut = [(i, c) for i, word in enumerate(new) for c in chunks(word)]
        more = np.zeros((len(new), self.languages))
        if cut:
            np.add.at(more, [i for i, _ in cut], word_scores([c for _, c in cut], trie, probs))
        self.logs = np.concatenate([self.logs, more])


def detect(docs: DataFrame, langs: list[str], pieces: dict[str, int], probs: np.ndarray) -> DataFrame:
    """``docs`` (any columns, one of them ``text``) with ``lang_pred`` and ``score`` added.

    The score is the best language's posterior under equal priors. A text that is null or without a
    letter, or any text when no language was learned, gets ``und`` and 0. Ties go to the first language by name.
    """
    trie = PieceTrie(pieces)

    def grouped(texts: pd.Series) -> Iterator[list]:
        """Texts in runs of about ``GROUP_CHARS``, so that new words are scored together."""
        held, chars = [], 0
        for text in texts:
            held.append(text)
            chars += len(text or "")
            if chars >= GROUP_CHARS:
                yield held
                held, chars = [], 0
        if held:
            yield held

    def scored(texts: list, cache: Scores) -> pd.DataFrame:
        # White space splits no letter run, so the runs of distinct tokens are those of the text.
        counts = [Counter(text.lower().split()) if text else Counter() for text in texts]
        if langs:
            cache.add({t for c in counts for t in c}, trie, probs)
        names, scores = [], []
        for found in counts:
            at = [i for token in found for i in cache.words[token]] if langs else []
            if not at:
                names.append("und")
                scores.append(0.0)
                continue
            times = [n for token, n in found.items() for _ in cache.words[token]]
            logs = np.array(times, float) @ cache.logs[at]
            best = int(np.argmax(logs))
            names.append(langs[best])
            scores.append(float(1.0 / np.exp(logs - logs[best]).sum()))
        return pd.DataFrame({"lang_pred": names, "score": scores}, columns=["lang_pred", "score"])

    @F.pandas_udf("lang_pred string, score double")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache = Scores(len(langs))
        for texts in parts:
            yield pd.concat([scored(group, cache) for group in grouped(texts)] or [scored([], cache)], ignore_index=True)

    return docs.withColumn("_judged", judge("text")).select(*docs.columns, "_judged.lang_pred", "_judged.score")


def learnable(col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(col).cast("string")), F.lit(4)) != 2
