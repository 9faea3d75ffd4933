"""Repair of conversations: the cheapest edits that make the roles of a conversation follow ``(s?(ua)+)?``.

Turns are aligned by Wagner and Fischer's table to each feasible length of the alternating target: kept (cost 0), given the target's role
(1), deleted (2; blank and repeated turns must be) or preceded by an inserted empty turn (5). A truncated turn that stays costs 5 more. The
target of a length is fixed, and counted from its end the targets of all lengths are one string, so a table has the costs of every length in its first row. A
first table in a narrow band gives an incumbent cost; Ukkonen's bound then says how far a path of that cost can leave the diagonal, and the
table is made again in this band where the first was too narrow. The cheapest lengths, with and without a system turn, are traced back and the least audit wins.

A conversation of any length is spread over tasks: turns are range-partitioned in their order and cut into blocks of ``BLOCK`` turns. A block is aligned between
each pair of states of the grammar (nothing yet, after the system turn, after a user, after an assistant turn), insertions being counted with
the turn behind them, and the blocks of a conversation are then put together in their order. Of equal costs between the same states neither audit is the beginning of the other, so the
least audit of all is made of least audits. Putting together holds the audit letters of one conversation's blocks, not its texts; texts take part in the last join alone.

Turns come in the order of their turn number, null first; ties by role, then by the MD5 of the text, then as read. Null roles and texts are one space. A null
conv_id is a conversation of its own. A role counts by its first letter; an empty one has none. Repeated rows are duplicates.
An empty table gives no rows. Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import materialize
from .text import record_batch

BLOCK = 512
RELABEL, DELETE, INSERT, TRUNCATED_STAYS = 1, 2, 5, 5
FAR = 1 << 29
#: Band of the first table, in turns to each side of the diagonal.
NARROW = 8
WHITE = " \t\n\x0b\x0c\r"
#: Faults of a turn.
FINE, BLANK, DUPLICATE, CUT = range(4)
#: States of the grammar: nothing yet, after the system turn, after a user, after an assistant turn, whole.
START, SYSTEM, USER, ASSISTANT, WHOLE = range(5)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}


def damaged(conversations: DataFrame) -> DataFrame:
    """Faults for trials, by the checksum of ``conv_id:turn``: dropped, emptied, unpunctuated, repeated or given the role user, one row of 20 each."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("_kind")).where("_kind != 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("col")


class Block:
    """Turns of a block against the alternating target."""

    def __init__(self, initials: list[str], faults: list[int]):
        self.n = len(initials)
        self.initials = initials
        self.must_go = [f in (BLANK, DUPLICATE) for f in faults]
        self.stay = [TRUNCATED_STAYS * (f == CUT) for f in faults]

    def table(self, last: str, open_end: bool, below: int, above: int) -> np.ndarray:
        """``t[i, r]``: cost of turns i and later against the last r letters of the target, within a band around r = n - i.

        Insertions behind the last turn are for the end of a conversation only.
        """
        n, other = self.n, "a" if last == "u" else "u"
        t = np.full((n + 1, n + above + 1), FAR, np.int64)
        letters = np.arange(n + above + 1)
        steps = INSERT * letters
        t[n, 0] = 0
        if open_end:
            t[n, : above + 1] = steps[: above + 1]
        odd = letters % 2 == 1
        for i in range(n - 1, -1, -1):
            lo, hi = max(0, n - i - below), n - i + above + 1
            best = t[i + 1, lo:hi] + DELETE
            if not self.must_go[i]:
                relabel = np.where(odd[lo:hi], RELABEL * (self.initials[i] != last), RELABEL * (self.initials[i] != other)) + self.stay[i]
                first = max(lo, 1)
                np.minimum(best[first - lo :], t[i + 1, first - 1 : hi - 1] + relabel[first - lo :], out=best[first - lo :])
            t[i, lo:hi] = steps[lo:hi] + np.minimum.accumulate(best - steps[lo:hi])
        return t

    def trace(self, t: np.ndarray, last: str, i: int, r: int, open_end: bool) -> str:
        """The least audit of cost ``t[i, r]``."""
        ops = []
        while i < self.n or r:
            now = t[i, r]
            if i < self.n and t[i + 1, r] + DELETE == now:
                ops.append("D")
                i += 1
            elif r and (i < self.n or open_end) and t[i, r - 1] + INSERT == now:
                ops.append("I")
                r -= 1
            else:
                letter = last if r % 2 else "a" if last == "u" else "u"
                ops.append("K" if self.initials[i] == letter else "R")
                i, r = i + 1, r - 1
        return "".join(ops)

    def _starts(self, t: np.ndarray, enter: int, last: str, open_end: bool) -> Iterator[tuple[int, int, int]]:
        """(cost, turns deleted before a kept system turn or -1, letters of the alternating part) for each feasible target."""
        # the alternating part begins with u, after a user turn with a; of the lengths every other one does
        odd = (enter == USER) == (last == "a")
        idle = enter == (USER if last == "u" else ASSISTANT) or open_end and enter == START
        for r in range(1 if odd else 0 if idle else 2, t.shape[1], 2):
            if t[0, r] < FAR:
                yield int(t[0, r]), -1, r
        if enter == START:
            for k in range(self.n):
                if self.initials[k] == "s" and not self.must_go[k]:
                    for r in range(1 if odd else 2, t.shape[1], 2):
                        if t[k + 1, r] < FAR:
                            yield DELETE * k + self.stay[k] + int(t[k + 1, r]), k, r

    def _cheapest(self, enters: list[int], last: str, open_end: bool) -> Iterator[tuple[int, int, str]]:
        below = above = NARROW
        while True:
            t = self.table(last, open_end, below, above)
            found = {e: list(self._starts(t, e, last, open_end)) for e in enters}
            # an incumbent for each state; deleting all turns but those that the state asks for is one as well
            cost = max(min((c for c, _, _ in s), default=DELETE * self.n + 2 * INSERT) for s in found.values())
            if below >= min(self.n, cost // DELETE) and above >= cost // INSERT:
                break
            below, above = max(below, cost // DELETE), max(above, cost // INSERT)
        for enter, starts in found.items():
            if starts:
                cost = min(c for c, _, _ in starts)
                audits = [(self.trace(t, last, 0, r, open_end) if k < 0 else "D" * k + "K" + self.trace(t, last, k + 1, r, open_end)) for c, k, r in starts if c == cost]
                yield enter, cost, min(audits)

    def transfers(self, enters: list[int], end: bool) -> list[tuple[int, int, int, str]]:
        """(state before, state after, cost, audit) of the cheapest edits; with ``end`` the state after is WHOLE."""
        if end:
            return [(e, WHOLE, cost, audit) for e, cost, audit in self._cheapest(enters, "a", True)]
        found = [(e, after, cost, audit) for last, after in (("u", USER), ("a", ASSISTANT)) for e, cost, audit in self._cheapest(enters, last, False)]
        nothing = DELETE * self.n, "D" * self.n
        found += [(e, e, *nothing) for e in enters if e in (START, SYSTEM)]
        if START in enters:  # the system turn alone
            alone = [(DELETE * (self.n - 1) + self.stay[k], "D" * k + "K" + "D" * (self.n - 1 - k)) for k in range(self.n) if self.initials[k] == "s" and not self.must_go[k]]
            found += [(START, SYSTEM, *min(alone))] if alone else []
        return found


def put_together(blocks: list[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """Cost and audit of a conversation from the transfers of its blocks."""
    paths = {START: (0, "")}
    for block in blocks:
        found: dict[int, tuple[int, str]] = {}
        for before, after, cost, audit in block:
            if before in paths:
                path = paths[before][0] + cost, paths[before][1] + audit
                found[after] = min(found.get(after, path), path)
        paths = found
    closing = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, ""), WHOLE: (0, "")}
    return min((cost + closing[s][0], audit + closing[s][1]) for s, (cost, audit) in paths.items())


_BLOCKS_SQL = (
    "conv string, part int, block int, blank long, duplicate long, truncated long, illegal long, first string, last string, "
    "low long, high long, turns long, ids array<long>, transfers array<struct<before:int,after:int,cost:long,audit:string>>"
)
_TRANSFERS = pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
BLOCKS = pa.schema(
    [("conv", pa.string()), ("part", pa.int32()), ("block", pa.int32()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")), ("first", pa.string()), ("last", pa.string())]
    + [(c, pa.int64()) for c in ("low", "high", "turns")] + [("ids", pa.list_(pa.int64())), ("transfers", _TRANSFERS)]
)
#: The sum of a conversation (place null) and its edits.
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
EDITS = pa.schema([("conv", pa.string()), ("place", pa.int64()), ("row", pa.int64()), ("edit", pa.string()), ("new_role", pa.string()), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string())])
_EDITS_SQL = "conv string, place long, row long, edit string, new_role string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batched(schema: pa.Schema, rows: Iterator[tuple], size: int) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield record_batch(schema, *map(list, zip(*held, strict=True)))
            held = []
    if held:
        yield record_batch(schema, *map(list, zip(*held, strict=True)))


def _block(conv: str, part: int, number: int, turns: list[tuple], enters: list[int], end: bool) -> tuple:
    initials, faults = [x[2] for x in turns], [x[3] for x in turns]
    numbers = [x[1] for x in turns if x[1] is not None]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    transfers = [dict(zip(("before", "after", "cost", "audit"), x, strict=True)) for x in Block(initials, faults).transfers(enters, end)]
    counts = (faults.count(f) for f in (BLANK, DUPLICATE, CUT))
    return conv, part, number, *counts, illegal, initials[0], initials[-1], min(numbers, default=None), max(numbers, default=None), len(set(numbers)), [x[4] for x in turns], transfers


def _blocks(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's ordered turns. A conversation may have begun before the task's first turn and may go on behind its last."""
    part = TaskContext.get().partitionId()

    def cut() -> Iterator[tuple]:
        held, number, begun = [], 0, False  # begun: the conversation's first turn is known to be in this task
        every = [START, SYSTEM, USER, ASSISTANT]
        fresh = True  # no block of the conversation yet
        for row in _rows(batches):
            if held and (row[0] != held[0][0] or len(held) == size):
                other = row[0] != held[0][0]
                yield _block(held[0][0], part, number, held, [START] if begun and fresh else every, other)
                number, held, begun, fresh = number + 1, [], begun or other, other
            held.append(row)
        if held:
            yield _block(held[0][0], part, number, held, [START] if begun and fresh else every, False)

    return _batched(BLOCKS, cut(), 256)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and sums of conversations from their ordered blocks."""

    def conversation(blocks: list[tuple]) -> Iterator[tuple]:
        conv = blocks[0][0]
        cost, audit = put_together([[tuple(x.values()) for x in b[13]] for b in blocks])
        sums = [sum(b[k] for b in blocks) for k in (3, 4, 5, 6)]
        sums[3] += sum(a[8] + b[7] not in LEGAL for a, b in zip(blocks, blocks[1:]))
        known = [b for b in blocks if b[9] is not None]
        turns = sum(b[11] for b in known) - sum(a[10] == b[9] for a, b in zip(known, known[1:]))
        gaps = known[-1][10] - known[0][9] + 1 - turns if known else 0
        yield conv, None, None, None, None, gaps, *sums, cost, audit
        ids = (x for b in blocks for x in b[12])
        # each turn that stays has the role of its place: what was put there last is counted from the end
        length = sum(op != "D" for op in audit)
        place = 0
        for at, op in enumerate(audit):
            row = None if op == "I" else next(ids)
            role = ("user" if (length - place) % 2 == 0 else "assistant") if op in "IR" else None
            yield conv, at, row, op, role, *[None] * 6, None
            place += op != "D"

    def whole() -> Iterator[tuple]:
        held = []
        for row in _rows(batches):
            if held and row[0] != held[0][0]:
                yield from conversation(held)
                held = []
            held.append(row)
        if held:
            yield from conversation(held)

    return _batched(EDITS, whole(), 10_000)


def _key(c: str = "conv_id") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias("conv")


class Repair:
    """Repaired conversations: ``sums`` (one row each), ``edits`` (in their order) and ``turns()`` (what results)."""

    def __init__(self, turns: DataFrame, block: int = BLOCK):
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
        rows = turns.select(_key(), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
        solid = F.rtrim("text", F.lit(WHITE))
        fault = F.when(solid == "", BLANK).when(~F.substring(solid, -1, 1).isin(".", "!", "?"), CUT).otherwise(FINE)
        rows = rows.withColumns({"digest": F.unhex(F.md5(F.col("text").cast("binary"))), "fault": fault, "row": F.monotonically_increasing_id()})
        self.rows = materialize(rows, "turns")
        narrow = self.rows.drop("text")
        same = ["conv", "role", "digest"]
        seen = narrow.groupBy(*same).agg(F.min(F.struct("turn", "row")).alias("seen"), F.count("*").alias("n")).where("n > 1").drop("n")
        later = F.coalesce(F.struct("turn", "row") > F.col("seen"), F.lit(False)) & (F.col("fault") != BLANK)
        judged = narrow.join(seen, same, "left").withColumn("fault", F.when(later, DUPLICATE).otherwise(F.col("fault")))
        order = ["conv", "turn", "role", "digest", "row"]
        judged = materialize(judged.drop("seen"), "turn-faults")  # ranges are found by a sample: the join runs once
        judged = judged.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", F.substring("role", 1, 1), "fault", "row")
        blocks = materialize(judged.mapInArrow(lambda batches: _blocks(block, batches), _BLOCKS_SQL), "turn-blocks")
        place = ["conv", "part", "block"]
        found = blocks.repartition("conv").sortWithinPartitions(*place).mapInArrow(_whole, _EDITS_SQL)
        found = materialize(found, "turn-edits")
        self.sums = found.where("place is null").select("conv", *_COUNTS, "audit")
        self.edits = found.where("place is not null").select("conv", "place", "row", "edit", "new_role")

    def turns(self) -> DataFrame:
        """conv, place, edit, role, text of every turn that stays or is new."""
        new = self.edits.where("edit = 'I'").select("conv", "place", "edit", F.col("new_role").alias("role"), F.lit("").alias("text"))
        old = self.edits.where("edit in ('K', 'R')").drop("conv").join(self.rows, "row")
        return old.select("conv", "place", "edit", F.coalesce("new_role", "role").alias("role"), "text").unionByName(new)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv", pa.string()), ("sha256", pa.string())])

    def each() -> Iterator[tuple]:
        conv, running = None, None
        for now, _, role, text in _rows(batches):
            if now != conv:
                if running:
                    yield conv, running.hexdigest()
                conv, running = now, hashlib.sha256()
            else:
                running.update(b"\n")
            running.update(f"{role}:{text}".encode())
        if running:
            yield conv, running.hexdigest()

    return _batched(schema, each(), 10_000)


def digests(conversations: DataFrame, repair: Repair) -> DataFrame:
    """A row for every conv_id of ``conversations``: its sums, its audit and the SHA-256 of its repaired turns, which are streamed through a task in their order."""
    ordered = repair.turns().select("conv", "place", "role", "text").repartition("conv").sortWithinPartitions("conv", "place")
    hashes = ordered.mapInArrow(_digests, "conv string, sha256 string")
    every = conversations.select(_key(), "conv_id").distinct()
    found = every.join(repair.sums, "conv", "left").join(hashes, "conv", "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in _COUNTS]
    return found.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
