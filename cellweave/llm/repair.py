"""Operator 12: repair of the structure of conversations.

A conversation's role initials must be ``(s?(ua)+)?``.  The automaton has four states: nothing yet,
after s, after u, after a; the first and the last accept.  Edits of a turn: Keep (0), Rerole to user
or assistant (1), Delete (2; the only one for blank and duplicate turns), Insert an empty user or
assistant turn anywhere (5); a truncated turn that stays costs 5 more.

Cost layers after Wu and Manber: for each turn one integer holds, layer by layer of cost, the bitset
of states that the turns so far can reach at that cost; an edit is a shift by its cost and a move of
state bits.  The first layer in which the last turn's set accepts gives the cost.  A pass back
keeps the bits that lead there, a pass forward takes at each turn the least edit (D, I, K, R) whose bit
is kept: the ASCII-least of the cheapest audits.  An edit decides the next state, as roles alternate,
so the audit decides the repair.  Layers more than ``LAYERS`` above a turn's cheapest are dropped: a
state that costs over 7 more than another can't be on a cheapest way (the other one can insert a
turn for 5, and delete a system turn for 2, to follow it).

Plan: turns are written once with their ids; the first of equal turns is found by an aggregation
(partial in each task); numbers of the turns, not texts, meet by conversation, sorted, in a stream
that keeps some sixty bytes a turn; edits find their texts by id.  One conversation is one sequence,
so its edits are found in one task, however long it is; its texts stay distributed but for
``digests``, where a hash over all of them must read them in order (a stream, no list).

Defined cases: nulls of role and text are one space, as in a turn's number; turns are ordered by
turn (nulls first), then role, then the SHA-256 of the text; a null conversation id is a conversation;
repeated turns are faults, whatever their turn's number; empty and very long texts are turns as others;
roles that begin otherwise than with s, u, a can't be kept; further columns of the input, whatever
their names, aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, input_rows, materialize

SPACES = " \t\n\x0b\x0c\r"
TURN = "conv_id long, turn long, role string, text string"
EDIT = "conv_id long, pos long, op string, id long, role string, cost long, illegal long"
#: Layers of cost kept above a turn's cheapest, four state bits each.
LAYERS = 12
ALL = (1 << 4 * LAYERS) - 1
NOTHING, AFTER_S, AFTER_U, AFTER_A = (sum(1 << 4 * d + state for d in range(3 * LAYERS)) for state in range(4))
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"


def forth(w: int) -> int:
    """States after one more turn whose role follows: to u, but from u to a."""
    return (w & NOTHING) << 2 | (w & AFTER_S) << 1 | (w & AFTER_A) >> 1 | (w & AFTER_U) << 1


def back(w: int) -> int:
    """States from which ``forth`` leads into w."""
    u = w & AFTER_U
    return u >> 2 | u >> 1 | u << 1 | (w & AFTER_A) >> 1


def kept(w: int, initial: str) -> int:
    """States after a turn that stays as it is."""
    if initial == "s":
        return (w & NOTHING) << 1
    if initial == "u":
        return forth(w & ~AFTER_U)
    return (w & AFTER_U) << 1 if initial == "a" else 0


def kept_back(w: int, initial: str) -> int:
    if initial == "s":
        return (w & AFTER_S) >> 1
    if initial == "u":
        return back(w & AFTER_U)
    return (w & AFTER_A) >> 1 if initial == "a" else 0


def inserted(w: int) -> int:
    """With up to two turns inserted; more are never cheapest."""
    w |= forth(w) << 20
    return w | forth(w) << 20


def trace(initials: str, faults: str) -> tuple[int, str]:
    """Cost and least audit.  ``faults``: a letter a turn, x must go, t is truncated, - is neither."""
    sets, base = array("Q", [inserted(1) & ALL]), array("q", [0])
    for initial, fault in zip(initials, faults, strict=True):
        w = sets[-1]
        to = w << 8
        if fault != "x":
            to |= (kept(w, initial) | forth(w) << 4) << (20 if fault == "t" else 0)
        to = inserted(to)
        low = ((to & -to).bit_length() - 1) // 4  # empty layers at the bottom
        sets.append(to >> 4 * low & ALL)
        base.append(base[-1] + low)
    ends = sets[-1] & (NOTHING | AFTER_A)
    cost = ((ends & -ends).bit_length() - 1) // 4
    # the bits on cheapest ways, from the last turn to the first
    w = ends & 15 << 4 * cost
    live = array("Q", [0]) * len(sets)
    for i in range(len(initials), -1, -1):
        if i < len(initials):
            above = w << 4 * (base[i + 1] - base[i])
            w = above >> 8
            if faults[i] != "x":
                stays = above >> (20 if faults[i] == "t" else 0)
                w |= kept_back(stays, initials[i]) | back(stays >> 4)
            w &= sets[i]
        w |= back(w >> 20) & sets[i]
        w |= back(w >> 20) & sets[i]
        live[i] = w
    audit, at, i = [], 1, 0  # at: the one bit of the present state and cost, above base[i]
    goal = ends & 15 << 4 * cost
    while i < len(initials) or not at & goal:
        if i < len(initials):
            down = 4 * (base[i + 1] - base[i])
            extra = 20 if faults[i] == "t" else 0
            if (at << 8 >> down) & live[i + 1]:
                audit.append("D")
                at, i = at << 8 >> down, i + 1
                continue
        if forth(at) << 20 & live[i]:
            audit.append("I")
            at = forth(at) << 20
        elif (kept(at, initials[i]) << extra >> down) & live[i + 1]:
            audit.append("K")
            at, i = kept(at, initials[i]) << extra >> down, i + 1
        else:
            audit.append("R")
            at, i = forth(at) << 4 + extra >> down, i + 1
    return base[-1] + cost, "".join(audit)


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns as a fixed rule spoils them, by crc32(conv_id:turn) mod 20: 0 drops the turn, 1 empties its
    text, 2 takes the marks that end sentences out of it, 3 repeats it, 4 gives it to the user."""
    own = input_rows(conversations, "conv_id", "turn", "role", "text")
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(h == 4, "user").otherwise(space("role"))
    times = F.when(h == 0, 0).when(h == 3, 2).otherwise(1)
    rows = own.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times.cast("int"))).alias("again"))
    return rows.drop("again")


def judged(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with id, key (the text's SHA-256) and fault, written once."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = input_rows(turns, "conv_id", "turn", "role", "text").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), space("role"), space("text"))
    rows = materialize(rows.withColumn("key", F.sha2("text", 256)).withColumn("id", F.monotonically_increasing_id()), "turns")
    first = rows.groupBy("conv_id", "role", "key").agg(F.min(F.struct("turn", "id")).alias("first")).select(F.col("first.id").alias("id"), F.lit(True).alias("is_first"))
    rows = rows.join(first, "id", "left")
    said = F.rtrim("text", F.lit(SPACES))
    last = F.substring(said, -1, 1)
    fault = F.when(said == "", BLANK).when(F.col("is_first").isNull(), DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED)
    return rows.select("id", "conv_id", "turn", "role", "text", "key", fault.alias("fault"))


def edits(turns: DataFrame) -> DataFrame:
    """The cheapest edits of judged turns, written: a row per edit (pos from 0, op, the turn's id but
    for insertions, the role of what stays) and one per conversation (op null) with cost and illegal."""

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(conv: int | None, ids: array, initials: list[str], faults: list[str]) -> Iterator[pa.RecordBatch]:
            cost, audit = trace("".join(initials), "".join(faults))
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
            at, pos, said, rows = 0, 0, "", []
            for op in audit:
                if len(rows) == 10_000:
                    yield batch_of(*zip(*rows, strict=True))
                    rows = []
                own = None if op == "I" else ids[at]
                role = None
                if op == "K" and initials[at] == "s":
                    said = "s"
                elif op != "D":
                    said = "a" if said == "u" else "u"
                    role = None if op == "K" else "user" if said == "u" else "assistant"
                rows.append((conv, pos, op, own, role, None, None))
                pos, at = pos + 1, at + (op != "I")
            yield batch_of(*zip(*rows, (conv, -1, None, None, None, cost, illegal), strict=True))

        held, ids, initials, faults = None, array("q"), [], []
        for batch in batches:
            for conv, turn_id, initial, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and conv != held:
                    yield from out(held, ids, initials, faults)
                    ids, initials, faults = array("q"), [], []
                held = conv
                ids.append(turn_id)
                initials.append(initial if initial and initial in "sua" else "-")
                faults.append(fault)
        if ids:
            yield from out(held, ids, initials, faults)

    bound_batches(turns.sparkSession)
    letter = F.when(F.col("fault").isin(BLANK, DUPLICATE), "x").when(F.col("fault") == TRUNCATED, "t").otherwise("-")
    lean = turns.select("conv_id", "id", F.substring("role", 1, 1).alias("initial"), letter.alias("fault"), "turn", "role", "key")
    dealt = lean.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "key", "id")
    return materialize(dealt.select("conv_id", "id", "initial", "fault").mapInArrow(follow, EDIT), "edits")


def batch_of(*columns) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in EDIT.split(", ")])


def repaired(turns: DataFrame, done: DataFrame) -> DataFrame:
    """conv_id, pos, op, role, text of every edit; deleted turns have neither role nor text."""
    texts = turns.select("id", F.col("role").alias("own"), "text")
    rows = done.where("op IS NOT NULL").join(texts, "id", "left")
    stays = F.col("op") != "D"
    return rows.select("conv_id", "pos", "op", F.when(stays, F.coalesce("role", "own")).alias("role"), F.when(stays, F.coalesce("text", F.lit(""))).alias("text"))


def digests(repairs: DataFrame) -> DataFrame:
    """conv_id, audit, repaired_sha256 of each conversation, hashed line by line in order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(conv: int | None, audit: list[str], sha) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], names=["conv_id", "audit", "repaired_sha256"])

        held, audit, lines, sha = None, [], 0, hashlib.sha256()
        for batch in batches:
            for conv, op, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if audit and conv != held:
                    yield row(held, audit, sha)
                    audit, lines, sha = [], 0, hashlib.sha256()
                held = conv
                audit.append(op)
                if op != "D":
                    sha.update(f"{chr(10) if lines else ''}{role}:{text}".encode("utf-8", "replace"))
                    lines += 1
        if audit:
            yield row(held, audit, sha)

    dealt = repairs.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return dealt.select("conv_id", "op", "role", "text").mapInArrow(read, "conv_id long, audit string, repaired_sha256 string")


def report(conversations: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """One row per conversation id of ``conversations``: gaps, faults and the cheapest repair of ``turns``
    (by default its own)."""
    rows = judged(conversations if turns is None else turns)
    done = edits(rows)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0))
    counts = rows.groupBy("conv_id").agg(gaps.alias("gaps"), *[F.count_if(F.col("fault") == f).alias(f) for f in (BLANK, DUPLICATE, TRUNCATED)])
    parts = {
        "c": (counts, ["gaps", BLANK, DUPLICATE, TRUNCATED]),
        "e": (done.where("op IS NULL").select("conv_id", "illegal", "cost"), ["illegal", "cost"]),
        "d": (digests(repaired(rows, done)), ["audit", "repaired_sha256"]),
    }
    out = input_rows(conversations, "conv_id").select(F.col("conv_id").cast("long")).distinct()
    for alias, (part, names) in parts.items():
        part = part.select(F.col("conv_id").alias(f"{alias}_id"), *names)
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col(f"{alias}_id")), "left").drop(f"{alias}_id")
    zero: list[Column] = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
