"""Conversations checked for faulty turns, and repaired by the cheapest edits (see `turns` for the method).

Two streaming passes over turns that Spark has sorted. The first sees no texts: a conversation is two bytes a turn there,
as long as its audit, which is one value of the result. The second reads the texts in order behind their audit. Whether a
turn was seen before is settled by an aggregate over (conversation, role and text) and a join, so neither a conversation
nor a text that fills a third of the table gathers in one task's memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlelake.llm.turns import BLANK, BLOCK, DUPLICATE, TRUNCATED, cheapest_edits, replay

Batches = Iterator[pa.RecordBatch]

_SPACE = " \t\n\x0b\x0c\r"
_NO_ID = -(1 << 63)
_NAMES = ("", "", "user", "assistant")
_PLAN = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[1, 2, 3], [2, 3, 2]] = True


def _prepared(turns: DataFrame, conv_col: str) -> DataFrame:
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    base = turns.select(F.coalesce(F.col(conv_col).cast("long"), F.lit(_NO_ID)).alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return base.withColumn("key", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


def _role_code() -> Column:
    initial = F.substring("role", 1, 1)
    return F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0).cast("byte")


def _own_fault() -> Column:
    """Blank or truncated, by the text alone."""
    body = F.rtrim(F.col("text"), F.lit(_SPACE))
    return F.when(body == "", BLANK).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0).cast("byte")


def _sorted(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("conv").sortWithinPartitions("conv", *(F.col(c).asc_nulls_first() for c in order))


def _plans(costs: tuple[int, int, int]) -> Callable[[Batches], Batches]:
    def settle(conv: np.ndarray, turn: np.ndarray, known: np.ndarray, role: np.ndarray, fault: np.ndarray, copies: np.ndarray) -> pa.RecordBatch:
        names, first = np.unique(conv, return_index=True)
        owner = np.searchsorted(names, conv)
        n = len(names)
        count = np.bincount(owner[known], minlength=n)
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(low, owner[known], turn[known])
        np.maximum.at(high, owner[known], turn[known])
        fresh = known.copy()
        fresh[1:] &= (conv[1:] != conv[:-1]) | (turn[1:] != turn[:-1]) | ~known[:-1]
        distinct = np.bincount(owner[fresh], minlength=n)
        gaps = np.where(count > 0, np.where(count > 0, high, 0) - np.where(count > 0, low, 0) + 1 - distinct, 0)
        row = np.repeat(np.arange(len(conv)), copies)
        again = np.ones(len(row), bool)
        again[np.cumsum(copies) - copies] = False
        role, owner = role[row], owner[row]
        fault = np.where(again & (fault[row] != BLANK), DUPLICATE, fault[row])
        pair = (owner[1:] == owner[:-1]) & ~_LEGAL[role[:-1], role[1:]]
        cost, audit = cheapest_edits(role, fault, owner, n, costs)
        of = lambda kind: pa.array(np.bincount(owner[fault == kind], minlength=n).astype(np.int64))
        illegal = np.bincount(owner[1:][pair], minlength=n).astype(np.int64)
        columns = [pa.array(names), pa.array(gaps.astype(np.int64)), of(BLANK), of(DUPLICATE), of(TRUNCATED), pa.array(illegal), pa.array(cost), pa.array([a.decode() for a in audit], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _PLAN.split(", ")])

    def run(batches: Batches) -> Batches:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            known = batch.column("turn").is_valid().to_numpy(zero_copy_only=False)
            turn = batch.column("turn").fill_null(0).to_numpy()
            conv, role, fault, copies = (batch.column(c).to_numpy() for c in ("conv", "role", "fault", "copies"))
            held.append([conv, turn, known, role.astype(np.int8), fault.astype(np.int8), copies])
            rows += batch.num_rows
            if rows < BLOCK or held[0][0][0] == conv[-1]:
                continue
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            stop = int(np.searchsorted(whole[0], whole[0][-1]))  # the last conversation may go on
            yield settle(*(c[:stop] for c in whole))
            held = [[c[stop:] for c in whole]]
            rows = len(held[0][0])
        if held:
            yield settle(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def plan_repairs(turns: DataFrame, conv_col: str = "conv_id", costs: tuple[int, int, int] = (2, 3, 1)) -> DataFrame:
    """One row per conversation: `conv_col`, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Turns stand in order of `turn` (null first), those of one turn by role, then by a hash of role and text; a null role
    or text is one space, rows without `conv_col` are one conversation. The first fault of a row counts: blank (no
    character but white space), duplicate (role and text seen earlier), truncated (the last such character is none of
    .!?). gaps: turn numbers missing between least and largest. illegal: neighbours whose role initials are not su, ua
    or au. The audit is the cheapest list of edits, of those the first in ASCII order, that leaves roles `(s?(ua)+)?`:
    K keeps a row, R sets its role (`costs[0]`), D deletes it (`costs[1]`; blank and duplicate rows must go), I inserts
    an empty row (`costs[0]`); truncated rows that stay cost `costs[2]`. Reads conv_col (integer), turn, role, text only;
    no rows give no rows. Lazy.
    """
    base = _prepared(turns, conv_col).select("conv", "turn", "role", "key", _role_code().alias("code"), _own_fault().alias("fault"))
    base = base.groupBy("conv", "turn", "role", "key", "code", "fault").agg(F.count("*").alias("copies"))
    first = base.groupBy("conv", "key").agg(F.min(F.struct("turn")).alias("first"))
    seen = ~F.col("turn").eqNullSafe(F.col("first.turn"))
    rows = base.join(first, ["conv", "key"]).withColumn("fault", F.when(seen & (F.col("fault") != BLANK), F.lit(DUPLICATE).cast("byte")).otherwise(F.col("fault")))
    rows = _sorted(rows, "turn", "role", "key").select("conv", "turn", F.col("code").alias("role"), "fault", "copies")
    plans = rows.mapInArrow(_plans(costs), _PLAN)
    return plans.withColumn("conv", F.when(F.col("conv") != _NO_ID, F.col("conv"))).withColumnRenamed("conv", conv_col)


_TURN = pa.schema([("conv", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_CODES = {"s": 1, "u": 2, "a": 3}


def _applied(batches: Batches) -> Batches:
    """Repaired turns: behind each audit (its row has no role) come the turns that it reads."""
    conv, steps, position = None, iter(()), 0

    def inserts(out: list[tuple], state: int) -> tuple[str, int]:
        """Emit the inserts that come next; the letter that follows them and the role before it."""
        nonlocal position
        for letter in steps:
            if letter != "I":
                return letter, state
            (_, state), = replay(b"I", [], state)
            out.append((conv, position, "I", None, _NAMES[state], ""))
            position += 1
        return "", state

    state = 0
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            if row["role"] is None:
                if conv is not None:
                    inserts(out, state)
                conv, steps, position, state = row["conv"], iter(row["text"]), 0, 0
                continue
            letter, state = inserts(out, state)
            if letter == "D":
                continue
            (_, state), = replay(letter.encode(), [_CODES.get(row["role"][:1], 0)], state)
            out.append((conv, position, letter, row["turn"], row["role"] if letter == "K" else _NAMES[state], row["text"]))
            position += 1
        yield pa.RecordBatch.from_pylist([dict(zip(_TURN.names, r, strict=True)) for r in out], schema=_TURN)
    out = []
    if conv is not None:
        inserts(out, state)
    yield pa.RecordBatch.from_pylist([dict(zip(_TURN.names, r, strict=True)) for r in out], schema=_TURN)


def apply_repairs(turns: DataFrame, plans: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The repaired turns: `conv_col`, position, edit (K, R or I), turn (null if inserted), role, text.

    `plans` comes from `plan_repairs` on the same turns. Rows of a conversation lie in one partition, in order. Lazy.
    """
    rows = _prepared(turns, conv_col).select("conv", F.lit(1).alias("kind"), "turn", "role", "key", "text")
    audit = plans.select(F.coalesce(F.col(conv_col), F.lit(_NO_ID)).alias("conv"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("key"), F.col("audit").alias("text"))
    ordered = _sorted(audit.unionAll(rows), "kind", "turn", "role", "key").select("conv", "turn", "role", "text")
    done = ordered.mapInArrow(_applied, "conv long, position long, edit string, turn long, role string, text string")
    return done.withColumn("conv", F.when(F.col("conv") != _NO_ID, F.col("conv"))).withColumnRenamed("conv", conv_col)


def _digests(batches: Batches) -> Batches:
    conv, digest, none = None, None, True
    schema = pa.schema([("conv", pa.int64()), ("sha256", pa.string())])
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if none or row["conv"] != conv:
                if not none:
                    out.append({"conv": conv, "sha256": digest.hexdigest()})
                conv, digest, none = row["conv"], hashlib.sha256(), False
            else:
                digest.update(b"\n")
            digest.update(f"{row['role']}:{row['text']}".encode())
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if not none:
        yield pa.RecordBatch.from_pylist([{"conv": conv, "sha256": digest.hexdigest()}], schema=schema)


def digest_turns(repaired: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """`conv_col` and repaired_sha256 of `role:text` lines, joined by \\n, of turns as `apply_repairs` returns them."""
    found = repaired.select(F.col(conv_col).alias("conv"), "role", "text").mapInArrow(_digests, "conv long, sha256 string")
    return found.select(F.col("conv").alias(conv_col), F.col("sha256").alias("repaired_sha256"))
