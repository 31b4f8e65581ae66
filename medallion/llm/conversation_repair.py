"""Cheapest repair of a conversation's turns, by bidirectional search in the edit lattice.

A node of the lattice is a number of rows passed and what the roles so far end with. Keeping,
re-roling or deleting a row and inserting one are its edges. A forward and a reverse heap settle
nodes from both ends; when no cheaper meeting is possible, all crossings of the least cost are
compared and the edits with the least initials win.

Rows are ordered by ranges of their conversation and turn, so no task sorts a whole conversation
that is too long; its rows are searched in blocks of ``BLOCK`` rows, from every entry state to
every exit state, and blocks are joined in a tree of 64-way groups. Only one byte a row goes into
the search.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs
WHITE = " \t\n\x0b\x0c\r"
BLOCK_BITS = 10  # rows of a block, as a power of two
WIDTH_BITS = 6  # blocks that are joined at a time

# States: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
ENDS = (START, ASSISTANT)
# A row's code: 0 system, 1 user, 2 assistant, 3 any other role; then two flags.
MUST_GO, CUT = 4, 8


def _expected(state: int) -> int:
    """The state that an edit with a free choice of role leads to."""
    return ASSISTANT if state == USER else USER


def _kept(state: int, role: int) -> int | None:
    """The state after a row keeps its role, if it may."""
    if role == 0:
        return SYSTEM if state == START else None
    return role + 1 if role < 3 and _expected(state) == role + 1 else None


def _forward(codes: bytes, i: int, state: int) -> Iterator[tuple[int, str, int, int]]:
    """Edges out of a node: cost, initial, rows passed, state."""
    yield INSERT, "I", i, _expected(state)
    if i == len(codes):
        return
    code = codes[i]
    yield DELETE, "D", i + 1, state
    if not code & MUST_GO:
        more = TRUNCATED if code & CUT else 0
        yield REROLE + more, "R", i + 1, _expected(state)
        kept = _kept(state, code & 3)
        if kept is not None:
            yield KEEP + more, "K", i + 1, kept


def _backward(codes: bytes, i: int, state: int) -> Iterator[tuple[int, str, int, int]]:
    """Edges into a node, each with the node it comes from."""
    for before in STATES:
        if _expected(before) == state:
            yield INSERT, "I", i, before
        if i:
            code = codes[i - 1]
            if before == state:
                yield DELETE, "D", i - 1, before
            if not code & MUST_GO:
                more = TRUNCATED if code & CUT else 0
                if _expected(before) == state:
                    yield REROLE + more, "R", i - 1, before
                if _kept(before, code & 3) == state:
                    yield KEEP + more, "K", i - 1, before


def cheapest(codes: bytes, entry: int = START, exits: Iterable[int] = ENDS
             ) -> tuple[int, str] | None:
    """Cost and initials of the cheapest edits that lead from ``entry`` to one of ``exits``; among
    equal costs the least initials. None if there are none.

    Heaps are ordered by cost, then along the rows, then by initials: edits that cost nothing pass
    a row, so a node's first label is its least. Two cheapest ways to a node never differ by an
    insertion at their end, so least beginnings and least ends make the least whole.
    """
    ahead = [(0, 0, "", entry)]  # cost, rows passed, initials, state
    behind = [(0, -len(codes), "", state) for state in exits]
    heapq.heapify(behind)
    fore: dict[tuple[int, int], tuple[int, str]] = {}
    back: dict[tuple[int, int], tuple[int, str]] = {}
    best: tuple[int, str] | None = None

    def offer(cost: int, audit: str) -> None:
        nonlocal best
        if best is None or (cost, audit) < best:
            best = cost, audit

    while ahead or behind:
        first = ahead[0][0] if ahead else float("inf")
        last = behind[0][0] if behind else float("inf")
        # The sources of both sides are settled before anything else.
        if best is not None and fore and back and first + last > best[0] and last > 0:
            break
        if first < last or not behind:
            cost, i, audit, state = heapq.heappop(ahead)
            if (i, state) in fore:
                continue
            fore[i, state] = cost, audit
            if (i, state) in back:
                offer(cost + back[i, state][0], audit + back[i, state][1])
            for price, edit, j, to in _forward(codes, i, state):
                if (j, to) in back:
                    offer(cost + price + back[j, to][0], audit + edit + back[j, to][1])
                if (j, to) not in fore:
                    heapq.heappush(ahead, (cost + price, j, audit + edit, to))
        else:
            cost, i, audit, state = heapq.heappop(behind)
            i = -i
            if (i, state) in back:
                continue
            back[i, state] = cost, audit
            if (i, state) in fore:
                offer(cost + fore[i, state][0], fore[i, state][1] + audit)
            for price, edit, j, of in _backward(codes, i, state):
                if (j, of) in fore:
                    offer(cost + price + fore[j, of][0], fore[j, of][1] + edit + audit)
                if (j, of) not in back:
                    heapq.heappush(behind, (cost + price, -j, edit + audit, of))
    return best


def _illegal(first: int, second: int) -> int:
    return int((first & 3, second & 3) not in ((0, 1), (1, 2), (2, 1)))


CELL = "struct<entry: int, exit: int, cost: long, audit: string>"
PART = f"key string, block long, head int, tail int, illegal long, cells array<{CELL}>"


def _searched(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every block's cheapest edits: of a whole conversation from the start to an end, of a part
    of one from every state to every state."""
    for frame in frames:
        rows = []
        for key, block, codes, part in zip(frame["key"], frame["block"], frame["codes"],
                                           frame["part"]):
            codes = bytes(codes.tolist())
            cells = []
            for entry in STATES if part else (START,):
                for exits in ((s,) for s in STATES) if part else (ENDS,):
                    found = cheapest(codes, entry, exits)
                    if found:
                        cells.append({"entry": entry, "exit": exits[0], "cost": found[0],
                                      "audit": found[1]})
            rows.append((key, block, codes[0], codes[-1],
                         sum(map(_illegal, codes, codes[1:])), cells))
        yield pd.DataFrame(rows, columns=["key", "block", "head", "tail", "illegal", "cells"])


def _joined(frame: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring blocks as one: the cheapest edits through all of them."""
    frame = frame.sort_values("block")
    whole, head, tail, illegal = None, None, None, 0
    for first, last, inner, cells in zip(frame["head"], frame["tail"], frame["illegal"],
                                         frame["cells"]):
        own = {(c["entry"], c["exit"]): (c["cost"], c["audit"]) for c in cells}
        illegal += inner + (0 if tail is None else _illegal(tail, first))
        head, tail = first if head is None else head, last
        if whole is None:
            whole = own
            continue
        through = {}
        for (entry, middle), (cost, audit) in whole.items():
            for leave in STATES:
                if (middle, leave) in own:
                    more = own[middle, leave]
                    way = cost + more[0], audit + more[1]
                    through[entry, leave] = min(way, through.get((entry, leave), way))
        whole = through
    cells = [{"entry": a, "exit": b, "cost": cost, "audit": audit}
             for (a, b), (cost, audit) in whole.items()]
    return pd.DataFrame([(frame["key"].iloc[0], frame["parent"].iloc[0], head, tail, illegal,
                          cells)], columns=["key", "block", "head", "tail", "illegal", "cells"])


def _several(parts: DataFrame) -> DataFrame:
    return parts.groupBy("key").count().filter("count > 1").select("key")


def _key(conversation: Column) -> Column:
    """A conversation as text, never null, so that the rows without one are found by equality."""
    return F.coalesce(F.concat(F.lit("="), conversation.cast("string")), F.lit(""))


@dataclass(frozen=True)
class Repair:
    """``report`` has a row per conversation: blank, duplicate, truncated, gaps, illegal, cost and
    audit. ``rows`` has the repaired conversations: number (from 0), role and text."""

    report: DataFrame
    rows: DataFrame


def repair(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn",
           role: str = "role", text: str = "text", block_bits: int = BLOCK_BITS) -> Repair:
    """Make every conversation's roles an optional system row and pairs of user and assistant.

    Rows go by turn, null first, then by role, text and the order of equal rows. Null roles and
    texts count as one space. A row is at fault if it is blank; else if role and text occurred
    before in the conversation; else if its last character that isn't white space is not one of
    ``.!?``. Blank and repeated rows must be deleted, a truncated row that stays costs extra. Rows
    without a conversation form one. ``gaps`` counts turns missing between the least and the
    largest. An empty table gives empty ones; other columns are ignored.

    A repaired conversation is written in order by one task, row by row, whatever its length.
    """
    kind = rows.schema[conversation].dataType
    said = F.coalesce(F.col(text), F.lit(" "))
    end = F.rtrim(said, F.lit(WHITE))
    who = F.coalesce(F.col(role), F.lit(" "))
    initial = F.substring(who, 1, 1)
    whole = rows.select(
        _key(F.col(conversation)).alias("key"), F.col(turn).alias("turn"), who.alias("role"),
        said.alias("text"), F.sha2(said, 256).alias("digest"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
        .alias("initial"),
        (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        F.monotonically_increasing_id().alias("salt"))
    order = ["key", F.col("turn").asc_nulls_first(), "role", "digest", "salt"]
    ordered = checkpointed(
        whole.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id()).drop("salt"))
    repeats = (
        ordered.filter("not blank").groupBy("key", "role", "digest")
        .agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").drop("n")
    )
    again = F.coalesce(F.col("place") > F.col("first"), F.lit(False))
    marked = (
        ordered.drop("text").join(repeats, ["key", "role", "digest"], "left")
        .withColumn("again", again & ~F.col("blank"))
        .withColumn("cut", F.col("cut") & ~F.col("blank") & ~F.col("again"))
    )
    counts = marked.groupBy("key").agg(
        F.count_if("blank").alias("blank"), F.count_if("again").alias("duplicate"),
        F.count_if("cut").alias("truncated"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
        .cast("long").alias("gaps"))
    code = (F.col("initial") + F.when(F.col("blank") | F.col("again"), MUST_GO).otherwise(0)
            + F.when(F.col("cut"), CUT).otherwise(0))
    # Ranges of places have numbers of 33 bits each: the blocks of all ranges are numbered densely.
    inside = F.col("place").bitwiseAND((1 << 33) - 1)
    last = ordered.agg(F.max(inside)).first()[0]
    local_bits = ((last or 0) >> block_bits).bit_length()
    block = F.shiftleft(F.shiftright("place", 33), local_bits).bitwiseOR(
        F.shiftright(inside, block_bits))
    blocks = checkpointed(
        marked.groupBy("key", block.alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("place", code.alias("code")))).alias("rows"))
        .select("key", "block", F.col("rows.code").alias("codes")))
    parted = _several(blocks).withColumn("part", F.lit(True))
    searched = checkpointed(
        blocks.join(parted, "key", "left")
        .withColumn("part", F.coalesce("part", F.lit(False)))
        .mapInPandas(_searched, PART))
    done, parts = searched.join(parted, "key", "left_anti"), searched.join(parted, "key", "left_semi")
    while not _several(parts).isEmpty():
        parts = checkpointed(
            parts.withColumn("parent", F.shiftright("block", WIDTH_BITS))
            .groupBy("key", "parent").applyInPandas(_joined, PART))
    ends = F.filter("cells", lambda c: (c["entry"] == START) & c["exit"].isin(*ENDS))
    least = F.array_min(F.transform(ends, lambda c: F.struct(c["cost"], c["audit"])))
    found = checkpointed(done.unionByName(parts).select("key", "illegal", least.alias("least"))
                         .select("key", "illegal", "least.cost", "least.audit"))

    def restored(key: Column) -> Column:
        return F.when(key != "", F.substring(key, 2, 1 << 30)).cast(kind).alias(conversation)

    report = counts.join(found, "key").select(
        restored(F.col("key")), "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
        "audit")
    script = found.select("key", F.lit(-1).cast("long").alias("place"),
                          F.lit("").alias("role"), F.col("audit").alias("text"))
    played = (
        ordered.select("key", "place", "role", "text").unionByName(script)
        .repartition("key").sortWithinPartitions("key", "place")
        .mapInArrow(_played, "key string, number long, role string, text string")
    )
    return Repair(report, played.select(restored(F.col("key")), "number", "role", "text"))


def _played(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Apply each conversation's edits, which come before its rows, to the rows in order."""
    key, audit, at, number, state, out = None, "", 0, 0, START, []

    def emit(role: str, text: str, to: int) -> None:
        nonlocal number, state
        out.append((key, number, role, text))
        number, state = number + 1, to

    def insert() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            to = _expected(state)
            emit("user" if to == USER else "assistant", "", to)
            at += 1

    def flush():
        columns = list(zip(*out)) if out else [(), (), (), ()]
        types = (pa.string(), pa.int64(), pa.string(), pa.string())
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], ["key", "number", "role", "text"])

    for batch in batches:
        for own, place, role, text in zip(*[c.to_pylist() for c in batch.columns]):
            if place < 0:
                insert()
                key, audit, at, number, state = own, text, 0, 0, START
                continue
            insert()
            edit, at = audit[at], at + 1
            if edit == "K":
                emit(role, text, SYSTEM if role[0] == "s" else _expected(state))
            elif edit == "R":
                to = _expected(state)
                emit("user" if to == USER else "assistant", text, to)
        yield flush()
    insert()
    yield flush()


def digests(rows: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """(conversation, sha256 of its rows as ``role:text`` lines), read row by row in order."""
    kind = rows.schema[conversation].dataType

    def run(batches):
        key, state, out = None, None, []
        for batch in batches:
            for own, role, text in zip(*[batch.column(n).to_pylist()
                                         for n in ("key", "role", "text")]):
                if own != key:
                    if key is not None:
                        out.append((key, state.hexdigest()))
                    key, state = own, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], pa.string()) for i in (0, 1)], ["key", "sha256"])
            out.clear()
        if key is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([key]), pa.array([state.hexdigest()])], ["key", "sha256"])

    hashed = (
        rows.select(_key(F.col(conversation)).alias("key"), "number", "role", "text")
        .repartition("key").sortWithinPartitions("key", "number")
        .mapInArrow(run, "key string, sha256 string")
    )
    return hashed.select(
        F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).cast(kind).alias(conversation),
        "sha256")


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with rows dropped, emptied, cut, repeated or re-roled by a checksum of
    their conversation and turn: faults of known kinds for the repair to find."""
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat_ws(":", filled("conv_id"), filled("turn")).cast("binary")) % 20
    text, role = filled("text"), filled("role")
    return rows.filter(fate != 0).select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, r"[.!?]", ""))
        .otherwise(text).alias("text"),
        F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        .alias("copy")).drop("copy")
