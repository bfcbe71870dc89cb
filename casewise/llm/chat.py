"""Chat formatting: the cheapest repair of a role sequence, then its rendering.

Legal conversations start with ``system`` or ``user``, alternate ``user`` and ``assistant``, and end with
``assistant``. A turn is kept (0), merged into the one before it with the same role (1), relabelled (2; 1 if its
role is unknown), or preceded by an empty turn of the missing role (3 more). Of equally cheap repairs the first
in this order is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.llm.common import saved

ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LEGAL = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
STATES = (None, *ROLES)
MERGE, RELABEL, UNKNOWN, INSERT = 1.0, 2.0, 1.0, 3.0
NEVER = float("inf")
ENDS = {None: (NEVER, ()), "system": (2 * INSERT, ("user", "assistant")), "user": (INSERT, ("assistant",)), "assistant": (0.0, ())}


def options(role: str | None) -> dict[tuple[int, int], tuple[float, str, str | None]]:
    """Per (state before, state after): the cheapest cost, action, and inserted role for a turn."""
    best: dict[tuple[int, int], tuple[float, str, str | None]] = {}
    for a, before in enumerate(STATES):
        for as_role in ROLES:
            change = 0.0 if as_role == role else UNKNOWN if role is None else RELABEL
            word = "keep" if as_role == role else "relabel"
            choices = []
            if as_role in LEGAL[before]:
                choices.append((change, word, None))
            if before == as_role:
                choices.append((change + MERGE, "merge", None))
            choices += [(change + INSERT, "insert", mid) for mid in LEGAL[before] if as_role in LEGAL[mid]]
            if choices:
                best[a, STATES.index(as_role)] = min(choices, key=lambda c: c[0])
    return best


OPTIONS = {role: options(role) for role in (None, *ROLES)}
COSTS = {}
for _role, _found in OPTIONS.items():
    COSTS[_role] = np.full((4, 4), NEVER)
    for (_a, _b), _choice in _found.items():
        COSTS[_role][_a, _b] = _choice[0]


def known(role: str | None) -> str | None:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return name if name in ROLES else None


def segment_costs(roles: list[str | None]) -> np.ndarray:
    """Least costs from each state before a run of turns to each state after it."""
    costs = np.where(np.eye(4) > 0, 0.0, NEVER)
    for role in roles:
        costs = (costs[:, :, None] + COSTS[role][None]).min(axis=1)
    return costs


def ends_of(costs: list[np.ndarray]) -> list[tuple[int, int]]:
    """States before and after each segment on the cheapest legal path."""
    total, back = np.array([0.0, NEVER, NEVER, NEVER]), []
    for step in costs:
        every = total[:, None] + step
        back.append(every.argmin(axis=0))
        total = every.min(axis=0)
    state = int(np.argmin(total + np.array([ENDS[s][0] for s in STATES])))
    out = []
    for choice in reversed(back):
        before = int(choice[state])
        out.append((before, state))
        state = before
    return out[::-1]


def repair(roles: list[str | None], before: int, after: int) -> list[tuple[str, str | None, str]]:
    """``(action, inserted role, role)`` of each turn on the cheapest path between two states."""
    total, back = np.full(4, NEVER), []
    total[before] = 0.0
    for role in roles:
        every = total[:, None] + COSTS[role]
        back.append(every.argmin(axis=0))
        total = every.min(axis=0)
    out, state = [], after
    for role, choice in zip(reversed(roles), reversed(back)):
        source = int(choice[state])
        _, action, inserted = OPTIONS[role][source, state]
        out.append((action, inserted, STATES[state]))
        state = source
    return out[::-1]


def _segments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The runs of equal ``_c, _part`` in sorted batches, joined across batches."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        change = (frame[["_c", "_part"]] != frame[["_c", "_part"]].shift()).any(axis=1).to_numpy().nonzero()[0]
        for a, b in zip(change, [*change[1:], len(frame)]):
            some = frame.iloc[a:b]
            if held and (held[0]["_c"].iloc[0] != some["_c"].iloc[0] or held[0]["_part"].iloc[0] != some["_part"].iloc[0]):
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(some)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _batched(rows: Iterator[list[tuple]], names: list[str]) -> Iterator[pd.DataFrame]:
    held: list[tuple] = []
    for some in rows:
        held += some
        if len(held) >= 5000:
            yield pd.DataFrame(held, columns=names)
            held = []
    yield pd.DataFrame(held, columns=names)


def _measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows():
        for run in _segments(frames):
            yield [(run["_c"].iloc[0], int(run["_part"].iloc[0]), segment_costs([known(r) for r in run["role"]]).ravel().tolist())]

    return _batched(rows(), ["_c", "_part", "costs"])


def _path(lists: pd.Series) -> pd.Series:
    out = []
    for flat in lists:
        costs = [np.asarray(c, float).reshape(4, 4) for c in np.asarray(flat, float).reshape(-1, 16)]
        out.append([{"before": a, "after": b} for a, b in ends_of(costs)])
    return pd.Series(out)


def _render(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def turn(role, text, first):
        return ("" if first else "<|end|>\n") + f"<|{role}|>\n{text}"

    def rows():
        for run in _segments(frames):
            head = run.iloc[0]
            fixed = repair([known(r) for r in run["role"]], int(head["before"]), int(head["after"]))
            first, seq, out = int(head["before"]) == 0, 0, []
            for conv, n, text, (action, inserted, role) in zip(run["conv_id"], run["turn"], run["text"], fixed):
                body = text or ""
                if inserted:
                    out.append((conv, n, int(head["_part"]), seq, "empty", inserted, turn(inserted, "", first)))
                    first, seq = False, seq + 1
                shown = f"\n{body}" if action == "merge" else turn(role, body, first)
                out.append((conv, n, int(head["_part"]), seq, action, role, shown))
                first, seq = False, seq + 1
            if bool(head["last"]):
                for role in ENDS[STATES[int(head["after"])]][1]:
                    out.append((out[-1][0], out[-1][1], int(head["_part"]), seq, "empty", role, turn(role, "", False)))
                    seq += 1
                out[-1] = (*out[-1][:-1], out[-1][-1] + "<|end|>\n")
            yield out

    return _batched(rows(), ["conv_id", "turn", "part", "seq", "action", "role", "rendered"])


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per turn of the repaired conversation, from rows of ``conv_id, turn, role, text``.

    ``rendered`` pieces of a conversation, joined in the order of (part, seq), are its text; a merged turn
    is a piece without a header. Rows are dealt by range of (conversation, turn), so a hot conversation spreads
    over many tasks: each finds least costs between the states at its ends, these matrices give the cheapest
    path, and each task then repairs its run between the states on it. Ties of a turn are ordered by role,
    then text; null turns come first; null ids are one conversation; null roles are unknown; null texts are empty.
    """
    spark = turns.sparkSession
    order = ["conv_id", "turn", "role", "_t", "_id"]
    rows = turns.select(
        F.col("conv_id").cast("string").alias("_c"), "conv_id", "turn", "role", "text", F.xxhash64("text").alias("_t"), F.monotonically_increasing_id().alias("_id")
    ).withColumn("_c", F.coalesce("_c", F.lit("null")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    by_run = ["_c", "_part", *order[1:]]
    costs = dealt.select("_c", "_part", *order[1:]).sortWithinPartitions(*by_run).mapInPandas(_measure, "_c string, _part int, costs array<double>")
    path = (
        costs.groupBy("_c")
        .agg(F.sort_array(F.collect_list(F.struct("_part", "costs"))).alias("_s"))
        .withColumn("_p", F.pandas_udf(_path, "array<struct<before:int,after:int>>")(F.flatten(F.col("_s.costs"))))
        .select("_c", F.size("_s").alias("_n"), F.posexplode(F.arrays_zip(F.col("_s._part").alias("_part"), F.col("_p").alias("p"))).alias("_i", "_z"))
        .select("_c", F.col("_z._part").alias("_part"), "_z.p.before", "_z.p.after", (F.col("_i") == F.col("_n") - 1).alias("last"))
    )
    joined = dealt.join(path, ["_c", "_part"]).sortWithinPartitions(*by_run)
    cast = [F.col(c).cast("string") for c in ("conv_id", "turn")]
    out = joined.select("_c", "_part", *cast, "role", "text", "before", "after", "last").mapInPandas(
        _render, "conv_id string, turn string, part int, seq int, action string, role string, rendered string"
    )
    return out.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "part", "seq", "action", "role", "rendered")
