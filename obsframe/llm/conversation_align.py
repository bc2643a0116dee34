"""Repair of conversation structure by Wagner-Fischer alignment to a grammar of roles.

A well-formed conversation is empty, or an optional system turn and then pairs of a user's and an assistant's turn. The
turns of a conversation are aligned with the alternating string of every feasible length at the least cost of edits:
keep (0), rerole to user or assistant (3), delete (4, the only edit of a blank or repeated turn), insert an empty turn (3);
a truncated turn that stays costs 3 more. The table of an alignment covers all lengths of one alternating string, within
Ukkonen's band: a cell whose distance from the diagonal alone costs more than the incumbent is left out. Among cheapest
alignments the one whose audit, the initials of its edits in order, is least in ASCII order is taken.

However long a conversation is, it is cut into segments of ``SEGMENT`` turns. A segment is aligned from each state of the
grammar (nothing, after system, after user, after assistant) to each; segments are then combined, ``SEGMENT`` at a time, by
adding costs and joining audits over the state between them. Audits of one segment, cost and pair of states are never prefixes
of each other, so the least joined audit is made of least audits, and the result is that of one table over all turns.

Cases: a null conversation is a conversation; null turns come first; of equal turns the smaller role and then the smaller text
comes first (UTF-8 bytes), so repeated rows are neighbours; null roles and texts count as one space and very long texts are only hashed and
passed on; an empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import row_number
from ..session import cut_lineage, cut_observed

SEGMENT = 256
KEEP, REROLE, DELETE, INSERT, OPEN_END = 0, 3, 4, 3, 3
#: Faults of a turn, the first that holds counts.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)
_NEVER = 1 << 40
_BLANKS = r"\x20\x09-\x0D"


# -- alignment of one segment ----------------------------------------------------------------

def _targets(state: int) -> list[tuple[str, list[int]]]:
    """The alternating strings that may follow ``state``, as the roles of two periods, with the state after each place."""
    if state == USER:
        return [("au", [ASSISTANT, USER])]
    plain = ("ua", [USER, ASSISTANT])
    return [plain, ("sua", [SYSTEM, USER, ASSISTANT])] if state == START else [plain]


def _greedy_cost(codes: str, target: str) -> int:
    """What it costs to take the turns one by one: an incumbent for the band."""
    cost, at = 0, 0
    for initial, fault in zip(codes[::2], codes[1::2]):
        if fault in "12":
            cost += DELETE
            continue
        want = _role(target, at)
        cost += (KEEP if initial == want else REROLE) + (OPEN_END if fault == "3" else 0) if want != "s" or initial == "s" else DELETE
        at += want != "s" or initial == "s"
    return cost


def _role(target: str, j: int) -> str:
    """The role at place ``j`` of an alternating string; an optional first role is not repeated."""
    return target[j] if j < len(target) else target[-2:][(j - len(target)) % 2]


def _align(codes: str, target: str, after: list[int], state: int) -> dict[int, tuple[int, str]]:
    """Least ``(cost, audit)`` of the turns ``codes`` by the state they end in, over all lengths of one alternating string."""
    n = len(codes) // 2
    initials, faults = codes[::2], codes[1::2]
    # five insertions more than the incumbent: two reach any state from its end, and no later turn is worth more than a deletion to start from another
    most = min(_greedy_cost(codes, target), DELETE * n) + 5 * INSERT
    above, below = most // INSERT + 1, most // DELETE + 1
    width = n + above + 1
    role = "".join(_role(target, j) for j in range(width - 1))
    places = np.frombuffer(role.encode(), np.uint8)
    steps = INSERT * np.arange(width, dtype=np.int64)
    cost = np.full((n + 1, width), _NEVER, dtype=np.int64)
    cost[0] = steps
    if target[0] == "s":  # nobody inserts a system turn
        cost[0, 1:] = _NEVER
    cost[0, above + 1:] = _NEVER
    for i in range(n):
        row = np.full(width, _NEVER, dtype=np.int64)
        lo, hi = max(0, i + 1 - below), min(width, i + 2 + above)
        row[lo:hi] = cost[i, lo:hi] + DELETE
        if faults[i] not in "12":
            stay = np.where(places == (ord(initials[i]) if initials[i] < "\x80" else 0), KEEP, np.where(places == ord("s"), _NEVER, REROLE))
            stay = stay + (OPEN_END if faults[i] == "3" else 0)
            row[max(lo, 1):hi] = np.minimum(row[max(lo, 1):hi], cost[i, max(lo, 1) - 1:hi - 1] + stay[max(lo, 1) - 1:hi - 1])
        first = 1 if target[0] == "s" else 0  # an insertion cannot reach the place of the system turn
        row[first:] = np.minimum.accumulate(row[first:] - steps[first:]) + steps[first:]
        row[:lo], row[hi:] = _NEVER, _NEVER
        cost[i + 1] = row
    out: dict[int, tuple[int, str]] = {}
    ends = [state] + [after[j] if j < len(after) else after[-2:][(j - len(after)) % 2] for j in range(width - 1)]
    for end in set(ends):
        lengths = [j for j in range(width) if ends[j] == end and cost[n, j] < _NEVER // 2]
        least = min((int(cost[n, j]) for j in lengths), default=_NEVER)
        audits = [_audit(cost, initials, faults, role, target, j) for j in lengths if cost[n, j] == least]
        if audits:
            out[end] = (least, min(audits))
    return out


def _audit(cost: np.ndarray, initials: str, faults: str, role: str, target: str, length: int) -> str:
    """The least audit of the alignments of least cost that end at ``length``.

    Cells of such alignments are found from the end backwards; then the walk from the start takes the least letter.
    """
    n = len(initials)
    ahead: dict[tuple[int, int], list[tuple[str, tuple[int, int]]]] = {}
    todo, seen = [(n, length)], {(n, length)}
    while todo:
        i, j = todo.pop()
        came = []
        if i and cost[i - 1, j] + DELETE == cost[i, j]:
            came.append(("D", (i - 1, j)))
        if j and cost[i, j - 1] + INSERT == cost[i, j] and not (j == 1 and target[0] == "s"):
            came.append(("I", (i, j - 1)))
        if i and j and faults[i - 1] not in "12":
            same = initials[i - 1] == role[j - 1]
            step = (KEEP if same else REROLE) + (OPEN_END if faults[i - 1] == "3" else 0)
            if (same or role[j - 1] != "s") and cost[i - 1, j - 1] + step == cost[i, j]:
                came.append(("K" if same else "R", (i - 1, j - 1)))
        for letter, cell in came:
            ahead.setdefault(cell, []).append((letter, (i, j)))
            if cell not in seen:
                seen.add(cell)
                todo.append(cell)
    at, letters = (0, 0), []
    while at != (n, length):
        letter, at = min(ahead[at])
        letters.append(letter)
    return "".join(letters)


@lru_cache(1 << 14)
def align_segment(codes: str, first: bool) -> tuple[tuple[int, int, int, str], ...]:
    """``(state before, state after, cost, audit)`` of a segment; ``codes`` has an initial and a fault digit per turn.

    The first segment begins in the start state alone.
    """
    found: dict[tuple[int, int], tuple[int, str]] = {}
    for state in (START,) if first else range(4):
        for target, after in _targets(state):
            for end, best in _align(codes, target, after, state).items():
                if (state, end) not in found or best < found[state, end]:
                    found[state, end] = best
    return tuple((a, b, c, s) for (a, b), (c, s) in sorted(found.items()))


def join_segments(left: list[tuple[int, int, int, str]], right: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    found: dict[tuple[int, int], tuple[int, str]] = {}
    for a, b, c, s in left:
        for b2, d, c2, s2 in right:
            if b == b2 and ((a, d) not in found or (c + c2, s + s2) < found[a, d]):
                found[a, d] = (c + c2, s + s2)
    return [(a, b, c, s) for (a, b), (c, s) in found.items()]


def best_whole(paths: list[tuple[int, int, int, str]]) -> tuple[int, str]:
    """The least cost and audit of whole conversations: from the start, ending with nothing or with an assistant's turn."""
    return min((c, s) for a, b, c, s in paths if a == START and b in (START, ASSISTANT))


# -- on tables -------------------------------------------------------------------------------

def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, turn, role, text)`` with faults put in by the CRC-32 of ``conv:turn``: of twenty remainders 0 drops the row, 1 empties its
    text, 2 takes its sentence marks out, 3 repeats it and 4 sets its role to user. Nulls count as one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(conv), F.lit(":"), said(turn)).cast("binary")) % 20
    new_text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said(text), "[.!?]", "")).otherwise(said(text))
    times = F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1).cast("int")))
    return turns.where(kind != 0).select(F.col(conv), F.col(turn), F.when(kind == 4, "user").otherwise(said(role)).alias(role), new_text.alias(text),
                                         times.alias("__i")).drop("__i")


def _name(conv: str) -> Column:
    """A conversation's id as text that is never null."""
    return F.when(F.col(conv).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(conv).cast("string")))


def numbered_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(__c, conv, turn, role, text, at, fault)``: the turns of each conversation in order from 0, with their faults; written once."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(_name(conv).alias("__c"), F.col(conv).alias("conv"), F.col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = cut_lineage(row_number(rows, order, "__row", ["__c"]).withColumn("at", F.col("__row") - 1).drop("__row"))
    # the earliest place of every role and text of a conversation, by two independent hashes of the text
    same = [F.xxhash64("text").alias("__t"), F.xxhash64("text", F.lit(1)).alias("__u")]
    first = placed.groupBy("__c", "role", *same).agg(F.min("at").alias("__first"))
    blank = ~F.col("text").rlike(f"[^{_BLANKS}]")
    cut_off = ~F.col("text").rlike(f"[.!?][{_BLANKS}]*\\z")
    fault = F.when(blank, BLANK).when(F.col("at") > F.col("__first"), DUPLICATE).when(cut_off, TRUNCATED).otherwise(FINE)
    return placed.select("*", *same).join(first, ["__c", "role", "__t", "__u"]).select(
        "__c", "conv", "turn", "role", "text", "at", fault.alias("fault"))


_PATH = "array<struct<before:int,after:int,cost:long,audit:string>>"
_PART = f"__c string, part long, first string, last string, illegal long, paths {_PATH}"


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for c, part, codes in zip(*(col.to_pylist() for col in b.columns)):
            initials = [x["initial"] for x in codes]
            text = "".join((i or "\0") + str(x["fault"]) for i, x in zip(initials, codes))
            illegal = sum(not _legal(x, y) for x, y in zip(initials, initials[1:]))
            out.append((c, part, initials[0], initials[-1], illegal, [dict(zip(("before", "after", "cost", "audit"), p)) for p in align_segment(text, part == 0)]))
        yield _part_batch(out)


def _part_batch(rows: list[tuple]) -> pa.RecordBatch:
    path = pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), path]
    cols = list(zip(*rows)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["__c", "part", "first", "last", "illegal", "paths"])


def _joined_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for c, part, parts in zip(*(col.to_pylist() for col in b.columns)):
            paths, illegal, last = None, 0, None
            for p in parts:
                mine = [(x["before"], x["after"], x["cost"], x["audit"]) for x in p["paths"]]
                illegal += p["illegal"] + (last is not None and not _legal(last, p["first"]))
                paths, last = mine if paths is None else join_segments(paths, mine), p["last"]
            out.append((c, part, parts[0]["first"], last, illegal, [dict(zip(("before", "after", "cost", "audit"), x)) for x in paths]))
        yield _part_batch(out)


def _outcome(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        best = [best_whole([(x["before"], x["after"], x["cost"], x["audit"]) for x in paths]) for paths in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c for c, _ in best], pa.int64()), pa.array([s for _, s in best], pa.string())],
                                         names=["__c", "illegal", "cost", "audit"])


def audits(numbered: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``(__c, gaps, blank, duplicate, truncated, illegal, cost, audit)`` per conversation of ``numbered_turns``."""
    code = F.struct("at", F.substring("role", 1, 1).alias("initial"), "fault")
    parts = (numbered.groupBy("__c", F.floor(F.col("at") / segment).cast("long").alias("part")).agg(F.sort_array(F.collect_list(code)).alias("codes"))
             .mapInArrow(_parts_of, _PART))
    parts, seen = cut_observed(parts, F.max("part").alias("top"))
    while (seen["top"] or 0) > 0:  # as many rounds as the logarithm of the longest conversation
        whole = F.struct("part", "first", "last", "illegal", "paths")
        more = parts.groupBy("__c", F.floor(F.col("part") / segment).cast("long").alias("part")).agg(F.sort_array(F.collect_list(whole)).alias("parts"))
        parts, seen = cut_observed(more.mapInArrow(_joined_parts, _PART), F.max("part").alias("top"))
    best = parts.select("__c", "illegal", "paths").mapInArrow(_outcome, "__c string, illegal long, cost long, audit string")
    of = lambda k: F.count_if(F.col("fault") == k)
    stats = numbered.groupBy("__c").agg(of(BLANK).alias("blank"), of(DUPLICATE).alias("duplicate"), of(TRUNCATED).alias("truncated"),
                                        F.min("turn").alias("__lo"), F.max("turn").alias("__hi"))
    places = numbered.where(F.col("turn").isNotNull()).select("__c", "turn").distinct().groupBy("__c").agg(F.count(F.lit(1)).alias("__d"))
    gaps = F.coalesce(F.col("__hi") - F.col("__lo") + 1 - F.col("__d"), F.lit(0)).cast("long").alias("gaps")
    return stats.join(places, "__c", "left").join(best, "__c").select("__c", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def repaired_turns(numbered: DataFrame, found: DataFrame) -> DataFrame:
    """``(__c, place, edit, turn, role, text)``: the turns of each repaired conversation in order; an inserted one has no turn and no text.

    A conversation's audit runs ahead of its turns as a row of its own. The rows of one conversation pass through one task as a
    stream, of which a batch is held at a time.
    """
    rows = numbered.select("__c", "at", "turn", "role", "text", F.lit(None).cast("string").alias("audit"))
    heads = found.select("__c", F.lit(-1).cast("long").alias("at"), F.lit(None).cast(numbered.schema["turn"].dataType).alias("turn"),
                         F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    stream = heads.unionByName(rows).repartition("__c").sortWithinPartitions("__c", "at")
    schema = f"__c string, place long, edit string, turn {numbered.schema['turn'].dataType.simpleString()}, role string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, audit, at, kept, last = None, "", 0, 0, ""
        for b in batches:
            out: list[tuple] = []

            def put(edit: str, turn, role: str, text: str) -> None:
                nonlocal kept, last
                kept, last = kept + 1, role[:1]
                out.append((name, kept - 1, edit, turn, role, text))

            def following() -> str:
                return "assistant" if last == "u" else "user"

            for c, place, turn, role, text, edits in zip(*(col.to_pylist() for col in b.columns)):
                if place < 0:
                    name, audit, at, kept, last = c, edits, 0, 0, ""
                else:
                    edit, at = audit[at], at + 1
                    if edit != "D":
                        put(edit, turn, role if edit == "K" else following(), text)
                while at < len(audit) and audit[at] == "I":
                    put("I", None, following(), "")
                    at += 1
            cols = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.string(), b.schema.field("turn").type, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], names=["__c", "place", "edit", "turn", "role", "text"])

    return stream.mapInArrow(run, schema)


def repaired_digests(repaired: DataFrame) -> DataFrame:
    """``(__c, repaired_sha256)`` of ``role:text`` lines, joined by newlines, fed to the hash as the stream of turns goes by."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest = None, None
        for b in batches:
            done = []
            for c, role, text in zip(*(b.column(x).to_pylist() for x in ("__c", "role", "text"))):
                if digest is None or c != name:
                    if digest is not None:
                        done.append((name, digest.hexdigest()))
                    name, digest = c, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done)], names=["__c", "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([digest.hexdigest()], pa.string())], names=["__c", "repaired_sha256"])

    return repaired.mapInArrow(run, "__c string, repaired_sha256 string")


def repair_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(audits, repaired turns)`` of a table of turns; both carry ``__c``, the id as text, beside their columns."""
    numbered = cut_lineage(numbered_turns(turns, conv, turn, role, text))
    found = cut_lineage(audits(numbered))
    return found, repaired_turns(numbered, found)


def damaged_and_repaired(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation of ``turns``: the faults that ``damage`` put in, and digests of the repair."""
    found, repaired = repair_conversations(damage(turns, conv, turn, role, text), conv, turn, role, text)
    every = turns.select(F.col(conv), _name(conv).alias("__c")).distinct()
    rows = every.join(found, "__c", "left").join(repaired_digests(repaired), "__c", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select(conv, *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
