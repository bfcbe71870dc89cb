"""Prefix trie of conversations, as double-array tries of prefix shards.

Turns are numbered within their conversation, conversations are rebuilt on the shared turns they begin with, and every
prefix gets a 128-bit digest: the XOR of hashes of (turn, place), so that a run of turns can be digested apart from what
precedes it. Conversations are cut into segments of ``SPAN`` turns, sorted by prefix and dealt by range: a shard
is a run of neighbours of at most ``SHARD_TURNS`` turns. For its segments a task packs a double-array trie (the child of
state ``s`` by turn id ``t`` is ``BASE[s] + t`` if ``CHECK`` there is ``s``), walks all segments through it and reports its states. Nodes
that several shards hold, the upper ones mostly, are merged by digest. A second pass sums each shard's subtrees along
``CHECK``; each node counts in one shard, so the partial sums of upper nodes add up. Totals of deeper segments join
at the node where they begin.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewise.llm.common import saved

SPAN = 1024
SHARD_TURNS = 50_000
SHARED = 6  # turns taken from the first conversation of a hundred: fewer than this
HUNDRED = 100
CHUNK_IDS = 20_000
TRIES = 16
LANES = ("x", "y")


class DoubleArray:
    """A static double-array trie over sequences of dense ids; state 0 is the root."""

    def __init__(self, seqs: list[np.ndarray]):
        self.seqs = seqs
        symbols = 1 + max((int(s.max()) for s in seqs if len(s)), default=0)
        children = self._children(symbols)
        self.base, self.check = np.zeros(1, np.int64), np.full(1, -1, np.int64)
        self._pack(children, symbols)

    def _children(self, symbols: int) -> list[np.ndarray]:
        """Ids of the children of each node; nodes numbered by level."""
        node = np.zeros(len(self.seqs), np.int64)
        sizes = np.array([len(s) for s in self.seqs])
        out, first, level = [], 0, 1
        for d in range(sizes.max(initial=0)):
            live = np.flatnonzero(sizes > d)
            ids = np.array([self.seqs[i][d] for i in live], np.int64)
            codes, at = np.unique((node[live] - first) * symbols + ids, return_inverse=True)
            split = np.searchsorted(codes, np.arange(1, level) * symbols)
            out += np.split(codes % symbols, split)
            first, level = first + level, len(codes)
            node[live] = first + at
        return out + [np.zeros(0, np.int64)] * level

    def _pack(self, children: list[np.ndarray], symbols: int) -> None:
        """First fit, the widest nodes first; after ``TRIES`` places a node goes behind all others."""
        n = len(children)
        room = n + symbols + 1
        used = np.zeros(room, bool)
        used[0] = True
        base = np.zeros(n, np.int64)  # by node
        free, top = 1, 1
        for i in sorted(range(n), key=lambda i: -len(children[i])):
            ids = children[i]
            if not len(ids):
                break
            while free < len(used) and used[free]:
                free += 1
            at, found = free, False
            for _ in range(TRIES):
                b = at - ids[0]
                if b + ids[-1] >= len(used):
                    break
                if not used[b + ids].any():
                    found = True
                    break
                at += 1
                while at < len(used) and used[at]:
                    at += 1
                if at >= len(used):
                    break
            if not found:
                b = max(top, free) - ids[0]
            if b + ids[-1] >= len(used):
                used = np.concatenate([used, np.zeros(max(len(used), int(b + ids[-1] + 1 - len(used))), bool)])
            used[b + ids] = True
            base[i], top = b, max(top, int(b + ids[-1]) + 1)
        # Slots of the nodes, from the root down: children are numbered in the order of their parents.
        slot, nxt = np.zeros(n, np.int64), 1
        self.base, self.check = np.zeros(top, np.int64), np.full(top, -1, np.int64)
        for i, ids in enumerate(children):
            self.base[slot[i]] = base[i]
            if len(ids):
                places = base[i] + ids
                slot[nxt : nxt + len(ids)] = places
                self.check[places] = slot[i]
                nxt += len(ids)

    def walk(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per depth: the sequences that reach it and their states."""
        state = np.zeros(len(self.seqs), np.int64)
        sizes = np.array([len(s) for s in self.seqs])
        for d in range(sizes.max(initial=0)):
            live = np.flatnonzero(sizes > d)
            place = self.base[state[live]] + np.array([self.seqs[i][d] for i in live], np.int64)
            if not (self.check[place] == state[live]).all():
                raise ValueError("damaged double array")
            state[live] = place
            yield d + 1, live, place


def ranked(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, p, q, chars`` of each turn: its place, a 128-bit digest of role and text, code points of the text.

    Rows are dealt by range, so that a conversation of any length spreads; places are row numbers within a part and the
    counts of the parts before it.
    """
    spark = turns.sparkSession
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(
        "conv_id",
        "turn",
        role.alias("role"),
        F.md5(text.cast("binary")).alias("text_id"),
        F.xxhash64(role, text, F.lit(1)).alias("p"),
        F.xxhash64(F.lit(2), text, role).alias("q"),
        F.char_length(text).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("id"),
    )
    order = ["turn", "role", "text_id", "id"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(rows.repartitionByRange(parts, "conv_id", *order).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("conv_id", "part").count().select("conv_id", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    local = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)) - 1
    placed = dealt.withColumn("pos", local.cast("long")).join(starts, ["conv_id", "part"])
    return placed.select("conv_id", (F.col("pos") + F.col("start")).alias("pos"), "p", "q", "chars")


def rebuilt(places: DataFrame, convs: DataFrame) -> DataFrame:
    """The turns of each conversation after its first ``h`` are replaced by those of the first of its hundred."""
    spread = F.struct("pos", "p", "q", "chars")
    heads = places.where((F.col("conv_id") % HUNDRED == 0) & (F.col("pos") < SHARED - 1))
    heads = heads.groupBy(F.col("conv_id").alias("first_id")).agg(F.sort_array(F.collect_list(spread)).alias("head"))
    shared = F.crc32(F.col("conv_id").cast("string")) % SHARED
    plans = convs.withColumn("first_id", F.col("conv_id") - F.col("conv_id") % HUNDRED).join(heads, "first_id", "left")
    plans = saved(plans.select("conv_id", shared.cast("int").alias("h"), F.coalesce(F.slice("head", 1, shared.cast("int")), F.array()).alias("head")))
    own = places.join(plans.select("conv_id", "h", F.size("head").alias("m")), "conv_id").where("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "p", "q", "chars")
    return own.unionByName(plans.select("conv_id", F.inline("head")).select(*own.columns))


def segments(rows: DataFrame, span: int) -> DataFrame:
    """``conv_id, band, x0, y0, p, q, chars`` with the digest before each segment of ``span`` turns, and ``above``: digests where its earlier bands begin."""
    mixed = rows.select(
        "conv_id",
        F.floor(F.col("pos") / span).alias("band"),
        F.struct("pos", F.xxhash64("p", "q", "pos").alias("x"), F.xxhash64("pos", "q", "p").alias("y"), "chars").alias("t"),
    )
    cut = mixed.groupBy("conv_id", "band").agg(
        F.sort_array(F.collect_list("t")).alias("t"), F.bit_xor("t.x").alias("sx"), F.bit_xor("t.y").alias("sy")
    )
    before = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    start = [F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(a) for c, a in (("sx", "x0"), ("sy", "y0"))]
    out = cut.select("conv_id", "band", "sx", "sy", F.col("t.x").alias("x"), F.col("t.y").alias("y"), F.col("t.chars").alias("chars"), *start)
    begun = F.collect_list(F.when(F.col("band") > 0, F.struct("x0", "y0")))
    up_to = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("above", begun.over(up_to))


def _shards(frames: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for frame in frames:
        ends = np.cumsum([len(x) for x in frame["x"]])
        first = 0
        while first < len(frame):
            taken = ends[first - 1] if first else 0
            last = int(np.searchsorted(ends, taken + most - size)) + 1
            held.append(frame.iloc[first:last])
            size += int(ends[min(last, len(frame)) - 1] - taken)
            first = last
            if size >= most:
                yield pd.concat(held, ignore_index=True)
                held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _trie(shard: pd.DataFrame) -> tuple[DoubleArray, np.ndarray]:
    """The shard's trie; segments of one start share a first symbol that stands for the start."""
    starts = shard[["band", "x0", "y0"]].to_numpy(np.int64)
    _, roots = np.unique(starts, axis=0, return_inverse=True)
    roots = roots.ravel()
    n_roots = int(roots.max()) + 1
    flat = np.stack([np.concatenate([np.asarray(a, np.int64) for a in shard[c]]) for c in LANES], axis=1)
    _, ids = np.unique(flat.view([("x", np.int64), ("y", np.int64)]).ravel(), return_inverse=True)
    cuts = np.cumsum([len(a) for a in shard["x"]])[:-1]
    seqs = [np.concatenate([[r], ids_ + n_roots]) for r, ids_ in zip(roots, np.split(ids, cuts))]
    return DoubleArray(seqs), roots


def states(segs: DataFrame, shard_turns: int) -> DataFrame:
    """One row per state of each shard's trie, without the starts of bands above 0: its node, parent state, members, smallest member."""
    names = "shard string, state long, up long, x long, y long, px long, py long, band long, x0 long, y0 long, depth long, chars long, n long, conv_id long"

    def report(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        for shard in _shards(frames, shard_turns):
            trie, _ = _trie(shard)
            size = len(trie.check)
            conv, band = shard["conv_id"].to_numpy(np.int64), shard["band"].to_numpy(np.int64)
            digest = [shard["x0"].to_numpy(np.int64).copy(), shard["y0"].to_numpy(np.int64).copy()]
            begin = [d.copy() for d in digest]
            span = shard["span"].to_numpy(np.int64)
            out, least, above = [], np.full(size, np.iinfo(np.int64).max), None
            for d, live, place in trie.walk():
                if d > 1:
                    for lane, name in zip(digest, LANES):
                        column = shard[name].to_numpy()
                        lane[live] ^= np.array([column[i][d - 2] for i in live], np.int64)
                one, at, n = np.unique(place, return_index=True, return_counts=True)
                np.minimum.at(least, place, conv[live])
                some = live[at]
                chars = np.array([shard["chars"].iloc[i][d - 2] if d > 1 else 0 for i in some], np.int64)
                was = [x[some] for x in above] if above is not None else [np.zeros(len(some), np.int64)] * 2
                frame = pd.DataFrame(
                    {"state": one, "up": trie.check[one], "x": digest[0][some], "y": digest[1][some], "px": was[0], "py": was[1], "band": band[some]}
                    | {"x0": begin[0][some], "y0": begin[1][some], "depth": band[some] * span[some] + d - 1, "chars": chars, "n": n, "conv_id": least[one]}
                )
                out.append(frame if d > 1 else frame[frame["band"] == 0])
                above = [x.copy() for x in digest]
            done = pd.concat(out, ignore_index=True)
            done.insert(0, "shard", uuid.uuid4().hex)
            yield done

    parts = int(segs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    early = [F.get(F.col(c), F.lit(i)) for i in range(3) for c in LANES]
    dealt = segs.repartitionByRange(parts, "band", "x0", "y0", *early, "conv_id").sortWithinPartitions("band", "x0", "y0", "x", "y")
    return dealt.select("conv_id", "band", "span", "x0", "y0", "x", "y", "chars").mapInPandas(report, names)


def _subtrees(shard: pd.DataFrame) -> pd.DataFrame:
    """Sums over the shard's subtrees along the parent states, deepest first."""
    index = pd.Series(np.arange(len(shard)), shard["state"].to_numpy())
    up = index.reindex(shard["up"].to_numpy()).fillna(-1).to_numpy().astype(np.int64)
    depth = shard["depth"].to_numpy()
    sums = [shard[c].to_numpy(np.int64).copy() for c in ("saved_here", "leaf_here")]
    for d in np.unique(depth)[::-1]:
        rows = np.flatnonzero((depth == d) & (up >= 0))
        for total in sums:
            np.add.at(total, up[rows], total[rows])
    conv = shard["node_conv"].to_numpy()
    parent = pd.Series(np.where(up >= 0, conv[np.maximum(up, 0)], -1))
    return pd.DataFrame({"x": shard["x"], "y": shard["y"], "saved": sums[0], "leaves": sums[1], "up_conv": parent, "has_up": up >= 0})


def _hash_chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted ids of each node joined in chunks."""
    for frame in frames:
        code = frame["x"].to_numpy(), frame["y"].to_numpy()
        change = np.flatnonzero((np.diff(code[0]) != 0) | (np.diff(code[1]) != 0)) + 1
        cuts = sorted({0, len(frame), *change, *range(0, len(frame), CHUNK_IDS)})
        ids = frame["conv_id"].to_numpy()
        pieces = [(code[0][a], code[1][a], ids[a], ",".join(map(str, ids[a:b]))) for a, b in zip(cuts, cuts[1:]) if a < b]
        yield pd.DataFrame(pieces, columns=["x", "y", "first", "ids"])


def _hash_nodes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's chunks in turn; nothing of a node is held but its hash state."""
    node, digest = None, None
    for frame in frames:
        out = []
        for x, y, ids in zip(frame["x"], frame["y"], frame["ids"]):
            if (x, y) != node:
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = (x, y), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield pd.DataFrame(out, columns=["x", "y", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(*node, digest.hexdigest())], columns=["x", "y", "ends_sha256"])


def end_hashes(ends: DataFrame) -> DataFrame:
    """``x, y, ends_sha256`` from rows of ``x, y, conv_id``: chunks of the sorted ids are joined in parallel, then hashed in order."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["x", "y", "conv_id"]
    chunks = ends.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(_hash_chunks, "x long, y long, first long, ids string")
    dealt = chunks.repartition(parts, "x", "y").sortWithinPartitions("x", "y", "first")
    return dealt.mapInPandas(_hash_nodes, "x long, y long, ends_sha256 string")


def prefix_trie(turns: DataFrame, span: int = SPAN, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node, from rows of ``conv_id, turn, role, text``; other columns are ignored.

    Turns are ordered by ``turn`` (null first), ties by role, then by the MD5 of the text; repeated rows are turns of
    their own. Null role or text is empty. Rows without a ``conv_id`` belong to no conversation and are left out. Texts
    count by their code points whatever their length, and travel as digests. An empty table has no members, so no node.
    """
    convs = turns.where("conv_id is not null").select(F.col("conv_id").cast("long")).distinct()
    rows = rebuilt(ranked(turns.select(F.col("conv_id").cast("long"), "turn", "role", "text")), convs)
    segs = segments(rows, span)
    turnless = convs.join(segs.select("conv_id"), "conv_id", "left_anti")
    none = F.array().cast("array<long>")
    blank = [F.lit(0).cast("long").alias(c) for c in ("band", "sx", "sy")]
    zero = [F.lit(0).cast("long").alias(c) for c in ("x0", "y0")]
    above = F.array().cast("array<struct<x0:long,y0:long>>").alias("above")
    empty = turnless.select("conv_id", *blank, *[none.alias(c) for c in (*LANES, "chars")], *zero, above)
    segs = saved(segs.unionByName(empty).withColumn("span", F.lit(span).cast("long")))

    found = saved(states(segs, shard_turns))
    node = ["x", "y"]
    owner = F.min(F.struct("shard", "state"))
    nodes = found.groupBy(*node).agg(
        F.sum("n").alias("n_convs"),
        F.min("conv_id").alias("node_conv"),
        owner.alias("owner"),
        *[F.max(c).alias(c) for c in ("depth", "chars", "px", "py", "band", "x0", "y0")],
    )
    nodes = saved(nodes)
    children = nodes.where("depth > 0").groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, node, "left").fillna(0, ["n_children"])
    spared = (F.col("n_convs") - 1) * F.col("chars")
    nodes = saved(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("spared", spared))

    # What hangs below the node where a deeper band begins: the sums of all bands that pass through it.
    bands = nodes.where("band > 0").groupBy("x0", "y0").agg(F.sum("spared").alias("spared"), F.sum("leaf").alias("leaf"))
    chains = segs.where("band > 0").groupBy("x0", "y0").agg(F.max_by("above", "conv_id").alias("above"))
    passed = bands.join(chains, ["x0", "y0"]).select("spared", "leaf", F.explode("above").alias("a"))
    deep = passed.groupBy(F.col("a.x0").alias("x"), F.col("a.y0").alias("y")).agg(F.sum("spared").alias("deep"), F.sum("leaf").alias("deep_leaves"))
    nodes = nodes.join(deep, node, "left").fillna(0, ["deep", "deep_leaves"])

    own = (F.col("owner.shard") == F.col("shard")) & (F.col("owner.state") == F.col("state"))
    here = found.select("shard", "state", "up", "depth", *node).join(nodes.drop("depth"), node)
    here = here.select(
        "shard", "state", "up", "depth", *node, "node_conv",
        F.when(own, F.col("spared") + F.col("deep")).otherwise(0).alias("saved_here"),
        F.when(own, F.col("leaf") + F.col("deep_leaves")).otherwise(0).alias("leaf_here"),
    )
    summed = here.groupBy("shard").applyInPandas(_subtrees, "x long, y long, saved long, leaves long, up_conv long, has_up boolean")
    totals = summed.groupBy(*node).agg(
        F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"), F.max(F.when(F.col("has_up"), F.col("up_conv"))).alias("up_conv")
    )
    # The first turn of a band has its parent in another shard: the node where the band begins.
    parents = nodes.select(F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("node_conv").alias("band_conv"))
    edge = nodes.where((F.col("band") > 0) & (F.col("px") == F.col("x0")) & (F.col("py") == F.col("y0"))).select(*node, "x0", "y0")
    edge = edge.join(parents, ["x0", "y0"]).select(*node, "band_conv")

    last = segs.groupBy("conv_id").agg(F.bit_xor("sx").alias("x"), F.bit_xor("sy").alias("y"))
    out = nodes.join(totals, node).join(end_hashes(last.select(*node, "conv_id")), node, "left").join(edge, node, "left")
    return out.select(
        F.col("node_conv").alias("conv_id"),
        "depth",
        F.coalesce("up_conv", "band_conv").alias("parent_conv_id"),
        "n_convs",
        F.col("n_children").cast("long").alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


ORACLE = """
WITH t AS (
    SELECT conv_id::BIGINT AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), bits AS (
    SELECT i::BIGINT AS i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v
    FROM range(256) r(i)
), tab AS (
    SELECT list(v ORDER BY i) AS v FROM bits
), conv AS (
    SELECT c, c - c % 100 AS first,
           xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
               lambda x, b: xor(x >> 8, v[xor(x % 256, b) + 1])), 4294967295) % 6 AS h
    FROM (SELECT DISTINCT c FROM t), tab
), heads AS (
    SELECT conv.c, t.pos, t.role, t.text FROM conv JOIN t ON t.c = conv.first AND t.pos < conv.h
), kept AS (
    SELECT c, count(*) AS m FROM heads GROUP BY c
), built AS (
    SELECT c, pos, role, text FROM heads
    UNION ALL
    SELECT t.c, t.pos - conv.h + coalesce(kept.m, 0), t.role, t.text
    FROM t JOIN conv ON t.c = conv.c LEFT JOIN kept ON kept.c = t.c WHERE t.pos >= conv.h
), path AS (
    SELECT c, pos + 1 AS depth, length(text) AS chars,
           string_agg(md5(length(role) || ':' || role || text), '' ORDER BY pos) OVER (PARTITION BY c ORDER BY pos) AS key
    FROM built
    UNION ALL
    SELECT c, 0, 0, '' FROM conv
), node AS (
    SELECT key, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM path GROUP BY key, depth
), kin AS (
    SELECT n.*, p.conv_id AS parent_conv_id, p.key AS parent_key
    FROM node n LEFT JOIN node p ON p.depth = n.depth - 1 AND p.key = left(n.key, length(n.key) - 32)
), fan AS (
    SELECT parent_key AS key, count(*) AS n FROM kin WHERE depth > 0 GROUP BY parent_key
), full_node AS (
    SELECT kin.*, coalesce(fan.n, 0) AS n_children FROM kin LEFT JOIN fan ON fan.key = kin.key
), below AS (
    SELECT a.key, sum((d.n_convs - 1) * d.chars) AS saved_tokens, sum((d.n_children = 0)::INT) AS n_leaves
    FROM full_node d JOIN path a ON a.c = d.conv_id AND a.depth <= d.depth GROUP BY a.key
), size AS (
    SELECT c, max(depth) AS depth FROM path GROUP BY c
), ends AS (
    SELECT p.key, string_agg(p.c::VARCHAR, ',' ORDER BY p.c) AS ids FROM path p JOIN size s ON s.c = p.c AND s.depth = p.depth GROUP BY p.key
)
SELECT f.conv_id, f.depth::BIGINT AS depth, f.parent_conv_id, f.n_convs, f.n_children::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves,
       b.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM full_node f JOIN below b ON b.key = f.key LEFT JOIN ends e ON e.key = f.key
"""
