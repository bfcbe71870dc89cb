"""Prefix trie, fill-in-middle and context trees against SQL, round trips and plain Python."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from casewise.llm import context_tree, fim, prefix_trie

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_sql(folder, table, sql):
    con = duckdb.connect()
    source = f"{folder}/{table}.parquet"
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{source}{'' if folder == SF else '/*.parquet'}')")
    return sorted(map(repr, con.sql(sql).df().astype(object).where(lambda d: d.notna(), None).itertuples(index=False, name=None)))


def by_spark(df, names):
    return sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect())))


def columns(sql, folder, table):
    con = duckdb.connect()
    source = f"{folder}/{table}.parquet"
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{source}{'' if folder == SF else '/*.parquet'}')")
    return con.sql(sql).columns


@pytest.fixture(params=["tables", "edges"])
def folder(request, edge_dir):
    return SF if request.param == "tables" else edge_dir


def plain_trie(turns):
    """Node rows from plain lists, by the contract."""
    convs = {}
    for t in turns:
        if t["conv_id"] is not None:
            convs.setdefault(t["conv_id"], []).append(t)
    key = lambda t: (t["turn"] is not None, t["turn"] or 0, t["role"] or "", hashlib.md5((t["text"] or "").encode()).hexdigest())
    own = {c: [(t["role"] or "", t["text"] or "") for t in sorted(ts, key=key)] for c, ts in convs.items()}
    built = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        first = int(math.fmod(c, 100))
        built[c] = own.get(c - first, [])[:h] + seq[h:]
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    out = []
    for path, who in members.items():
        inside = [p for p in members if p[: len(path)] == path]
        leaves = [p for p in inside if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in inside)]
        ends = ",".join(str(c) for c in sorted(who) if len(built[c]) == len(path))
        out.append(
            (
                min(who),
                len(path),
                min(members[path[:-1]]) if path else None,
                len(who),
                sum(len(q) == len(path) + 1 for q in inside),
                len(leaves),
                sum((len(members[p]) - 1) * len(p[-1][1]) for p in inside if p),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(map(repr, out))


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("shape", [{}, {"span": 2, "shard_turns": 5}])
def test_trie_equals_plain_lists(spark, folder, shape):
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    found = by_spark(prefix_trie.prefix_trie(turns, **shape), TRIE)
    assert found == plain_trie([r.asDict() for r in turns.collect()])


def test_trie_of_copies_and_long_conversations(spark):
    rows = [(c, i, "user" if i % 2 else None, f"t{i % 7}é") for c in (-100, -3, 0, 5, 7, 107) for i in range(40)]
    rows += [(c, None, "user", None) for c in range(200, 240)] + [(0, 39, "user", "t4é")] * 3 + [(3, 1, "x", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for shape in ({}, {"span": 4, "shard_turns": 30}):
        assert by_spark(prefix_trie.prefix_trie(turns, **shape), TRIE) == plain_trie([r.asDict() for r in turns.collect()])


def test_trie_equals_sql(queries, spark, folder):
    sql = prefix_trie.ORACLE
    names = columns(sql, folder, "conversations")
    assert by_spark(queries["op11_prefix_trie"](spark, folder).select(*names), names) == by_sql(folder, "conversations", sql)


def test_double_array_holds_each_sequence():
    rng = np.random.default_rng(3)
    seqs = [rng.integers(0, 50, rng.integers(0, 9)) for _ in range(400)] + [np.arange(60), np.zeros(0, np.int64)]
    trie = prefix_trie.DoubleArray(seqs)
    found = {}
    for d, live, place in trie.walk():
        for i, p in zip(live, place):
            assert found.setdefault(int(p), tuple(seqs[i][:d])) == tuple(seqs[i][:d])
    assert len(found) == len({tuple(s[:d]) for s in seqs for d in range(1, len(s) + 1)}) == int((trie.check >= 0).sum())


def test_end_hash_of_many_members(spark):
    ends = spark.range(50_000).select(F.lit(1).cast("long").alias("x"), F.lit(2).cast("long").alias("y"), F.col("id").alias("conv_id"))
    (row,) = prefix_trie.end_hashes(ends).collect()
    assert row.ends_sha256 == hashlib.sha256(",".join(map(str, range(50_000))).encode()).hexdigest()


def test_cuts_equal_sql(queries, spark, folder):
    names = columns(fim.ORACLE, folder, "documents")
    found = by_spark(queries["op12_fill_in_middle"](spark, folder).select(*names), names)
    expected = by_sql(folder, "documents", fim.ORACLE)
    assert [s.replace(".0,", ",") for s in expected] == [s.replace(".0,", ",") for s in found]


def test_cuts_round_trip(spark):
    texts = ["", None, "a", "a<P>b", "<S", "\n\r \\$1{}<", "é\U0001f600" * 700, "x" * 1024, "y\n" * 100_000]
    docs = spark.createDataFrame([(i, t, i) for i in range(40) for t in texts], "doc_id long, text string, n long")
    for r in fim.transform(docs).withColumn("back", fim.restore(F.col("fim.output"), F.col("fim.form"))).collect():
        text, f = r.text or "", r.fim
        assert r.back == text and r.n == r.doc_id and f.n == len(text)
        if f.form == "plain":
            assert f.output == text and f.prefix_chars is None and f.middle_chars is None
        else:
            a, b = f.prefix_chars, f.prefix_chars + f.middle_chars
            pre, mid, suf = text[:a], text[a:b], text[b:]
            assert f.output == (f"<P>{pre}<S>{suf}<M>{mid}" if f.form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}")
    forms = {r.form for r in fim.transform(docs).select("fim.form").distinct().collect()}
    assert forms == {"plain", "psm", "spm"}


def bits_of(symbol):
    return [(1 << k | symbol >> (8 - k), symbol >> (7 - k) & 1) for k in range(8)]


def log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


def plain_scores(docs):
    """Ratios of weighted block probabilities, one bit at a time, from dictionaries of counts."""
    depth = context_tree.DEPTH
    nodes, kids = {}, {}
    train, words = [], Counter()
    for doc_id, text in docs:
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 != 2:
            low = (text or "").translate(LOWER).encode()
            train.append(low)
            words.update([*low.split(), None])
    for low in train:
        flat = b"\xff" * depth + low + b"\xff"
        for i in range(depth, len(flat)):
            for j, bit in bits_of(flat[i]):
                for d in range(depth + 1):
                    node = (flat[i - d : i], j)
                    nodes.setdefault(node, [0, 0])[bit] += 1
                    if d:
                        kids.setdefault((flat[i - d + 1 : i], j), set()).add(node)
    cache = {}

    def weighted(node):
        if node not in cache:
            a, b = nodes[node]
            cache[node] = log_kt(a, b)
            if len(node[0]) < depth:
                cache[node] = math.log(0.5) + np.logaddexp(cache[node], sum(weighted(k) for k in kids[node]))
        return cache[node]

    for d in range(depth, -1, -1):  # from below, so that recursion stays flat
        for node in [n for n in nodes if len(n[0]) == d]:
            weighted(node)
    memo = {}

    def log_ratio(context, j, bit):
        """The log of the root's probability after one more bit, less that before."""
        change = None
        for d in range(depth, -1, -1):
            node = (context[depth - d :], j)
            counts = list(nodes.get(node, [0, 0]))
            before = cache.get(node, 0.0)
            counts[bit] += 1
            own = log_kt(*counts)
            if d == depth:
                after = own
            else:
                rest = sum(cache[k] for k in kids.get(node, ()))
                after = math.log(0.5) + np.logaddexp(own, rest + change)
            change = after - before
        return change

    out = []
    n, v = sum(words.values()), len(words)
    for doc_id, text in docs:
        low = (text or "").translate(LOWER).encode()
        flat, total = b"\xff" * depth + low + b"\xff", 0.0
        for i in range(depth, len(flat)):
            key = flat[i - depth : i + 1]
            if key not in memo:
                memo[key] = sum(log_ratio(key[:-1], j, bit) for j, bit in bits_of(key[-1]))
            total += memo[key]
        tokens = [*low.split(), None]
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens)
        held = doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 == 2
        out.append((doc_id, held, len(tokens), sum(words[w] > 0 for w in tokens), n, base, total / math.log(10)))
    return out


def test_context_trees_equal_block_probabilities(spark, queries, edge_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{edge_dir}/documents.parquet").collect()]
    rows += [(r.doc_id + 10, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect() if len(r.text) < 1500]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, block string")
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    expected = sorted(plain_scores(rows), key=order)
    for size in (context_tree.BLOCK_BYTES, 3000):
        found = sorted((tuple(r) for r in context_tree.score(docs, ~context_tree.learnable(), size).collect()), key=order)
        assert [r[:5] for r in found] == [r[:5] for r in expected]
        np.testing.assert_allclose([r[5:] for r in found], [r[5:] for r in expected], rtol=1e-7)  # the plain way takes differences of large logarithms
    assert {r.held_out for r in queries["op13_context_tree"](spark, edge_dir).collect()} == {True, False}


def test_context_tree_pieces_of_a_long_text(spark, monkeypatch):
    text = ("Été, ab! " * 4000).encode()
    whole = context_tree.gram_counts([text, b"", b"xy"], np.array([True, False, True]))
    monkeypatch.setattr(context_tree, "STEP_BYTES", 1000)
    monkeypatch.setattr(context_tree.pieces, "__defaults__", (1000,))
    cut = context_tree.gram_counts([text, b"", b"xy"], np.array([True, False, True]))
    assert all((a == b).all() for a, b in zip(whole, cut))


def test_context_tree_predictions_sum_to_one():
    grams = np.array([int.from_bytes(b"abcd" + bytes([s]), "big") for s in range(256)])
    seen, counts = context_tree.gram_counts([b"abcdeabcdfabcd", b"zzz"], np.array([True, True]))
    every = np.unique(np.concatenate([seen, grams]))
    n = np.zeros(len(every))
    n[np.searchsorted(every, seen)] = counts
    two = context_tree.levels(every, n)[2]
    nodes, at = np.unique(two.codes & 0xFFFF, return_inverse=True)
    top = context_tree.Top(nodes >> 8, nodes & 255, *(np.bincount(at, x) for x in (two.zeros, two.ones, two.weighted)))
    assert abs(sum(10 ** top.logs(every, n)[np.searchsorted(every, grams)]) - 1) < 1e-9
