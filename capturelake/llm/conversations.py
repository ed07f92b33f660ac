"""Repair of damaged conversations by the cheapest edits, over rows sorted by conversation and turn.

Rows are dealt by conversation and sorted by turn within each task (secondary sort), and two streams over Arrow batches do
the rest. The first runs from the last turn to the first and carries the costs of finishing from each of four grammar
states; for every row it leaves one byte, the best edit in each state. These bytes leave the stream in bounded pieces as
rows of a table (so nothing is kept in a task, nor in a local file, however long a conversation is). The second stream
meets rows and pieces in turn order, follows the edits from the start, counts faults and digests the repaired text.

Grammar states: nothing yet, after a system turn, after a user turn, after an assistant turn; the first and the last may
end. Edits: K keeps, R changes the role to the one that the state asks for, D deletes, I inserts that role. In each state
only one of user and assistant can follow, so the letters say the edits, and the least letter among the cheapest
continuations, taken from the front, gives the ASCII-least of the cheapest repairs.

Defined results: a null conversation id is one conversation; null turns come first; nulls in any column read as one space
where text is asked for. Rows of one turn are ordered by role and SHA-256 of the text. A role counts by its first
character; one that is not s, u or a can't be kept, nor can an empty role. A conversation whose rows are all dropped has
zeros, an empty audit and the hash of no text. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capturelake.llm.common import base_columns, written

#: Rows whose edits make one piece; results don't depend on it.
PIECE = 50_000
#: White space of the contract, and edit letters in ASCII order.
SPACE = " \t\n\x0b\x0c\r"
LETTERS = "DIKR"
#: By state: the role that can follow (as place in ROLES), and the state that it leads to.
ROLES, FOLLOWS, NEXT = ("user", "assistant"), (0, 0, 1, 0), (2, 2, 3, 2)
#: Costs of ending: from nothing, after system, after user, after assistant.
ENDING = (0, 4, 2, 0)


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32 of `conv_id:turn` modulo 20; dropped rows stay with `here` false."""
    rows = base_columns(df, {"conv_id": "long", "turn": "long", "role": "string", "text": "string"})
    written_as = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(written_as("conv_id"), F.lit(":"), written_as("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", kind.alias("kind"), written_as("role").alias("role"), written_as("text").alias("text"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(True), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", (F.col("kind") != 0).alias("here"), role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


def judged(rows: DataFrame) -> DataFrame:
    """Rows with a place among equal ones and their fault: 0 none, 1 blank, 2 duplicate, 3 truncated.

    Equal rows of a conversation are numbered by turn in a window keyed by all they share, so a long conversation is
    spread over tasks. `digest` and `nth` make the order of rows within a turn total.
    """
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    equal = Window.partitionBy("conv_id", "here", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.withColumn("nth", F.row_number().over(equal))
    fault = F.when(trimmed == "", 1).when(F.col("nth") > 1, 2).when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    return rows.select("conv_id", "turn", "here", "role", "text", "nth", fault.alias("fault"), F.unhex(F.sha2("text", 256)).alias("digest"))


def _initial(role: str | None) -> str:
    return role[:1] if role and role[0] in "sua" else "?"


@lru_cache(maxsize=None)
def step(costs: tuple[int, ...], initial: str, fault: int) -> tuple[tuple[int, ...], int, int]:
    """Costs before a row from those after it: the new costs over their minimum, that minimum, and the edits, two bits a state.

    Costs over their minimum are few tuples, so the table of calls is small and a row costs one look-up.
    """
    worst = 10**6  # no edit of this kind
    extra, kept = int(fault == 3), fault not in (1, 2)
    best: list[int] = [0] * 4
    choice = [0] * 4

    def options(q: int) -> list[int]:
        keep = rerole = worst
        if kept:
            if initial == "s" and q == 0:
                keep = extra + costs[1]
            elif initial in "ua" and FOLLOWS[q] == "ua".index(initial):
                keep = extra + costs[NEXT[q]]
            rerole = 2 + extra + costs[NEXT[q]]
        return [3 + costs[q], worst, keep, rerole]

    without = [options(q) for q in range(4)]
    # Insertions lead to the states after user and after assistant, and those to each other: the cheaper one settles first.
    for q in range(4):
        best[q] = min(without[q])
    for q in (2, 3, 2):
        best[q] = min(best[q], 2 + best[NEXT[q]])
    for q in (0, 1):
        best[q] = min(best[q], 2 + best[NEXT[q]])
    for q in range(4):
        ways = without[q][:1] + [2 + best[NEXT[q]]] + without[q][2:]
        choice[q] = ways.index(best[q])
    low = min(best)
    return tuple(b - low for b in best), low, sum(c << 2 * q for q, c in enumerate(choice))


def edit_pieces(rows: DataFrame) -> DataFrame:
    """Runs from the last row of each conversation to the first; per piece of at most PIECE rows: the sort columns of the
    piece's first row in turn order, its edits in turn order, and the cost from that row on in the state `nothing yet`."""

    def run(batches):
        last = None
        costs, base, edits, first = ENDING, 0, bytearray(), None

        def piece():
            out = (*first, bytes(reversed(edits)), base + costs[0])
            edits.clear()
            return out

        for pdf in batches:
            out = []
            for row in zip(pdf["conv"], pdf["known"], pdf["turn"], pdf["role"], pdf["digest"], pdf["nth"], pdf["fault"], strict=True):
                if row[0] != last or len(edits) == PIECE:
                    if edits:
                        out.append(piece())
                    if row[0] != last:
                        last, costs, base = row[0], ENDING, 0
                costs, low, byte = step(costs, _initial(row[3]), row[6])
                base += low
                edits.append(byte)
                first = row[:6]
            if out:
                yield pd.DataFrame(out, columns=columns)
        if edits:
            yield pd.DataFrame([piece()], columns=columns)

    columns = ["conv", "known", "turn", "role", "digest", "nth", "edits", "cost"]
    compact = rows.where("here").select(*_sort_columns(), "fault").repartition("conv")
    down = compact.sortWithinPartitions(*[F.col(c).desc() for c in columns[:6]])
    return down.mapInPandas(run, "conv string, known boolean, turn long, role string, digest binary, nth int, edits binary, cost long")


def _sort_columns() -> list[Column]:
    """Columns without nulls that order rows; a null conversation is the empty string, a null turn is not `known`."""
    return [
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", "digest", "nth",
    ]


class _Repair:
    """One conversation under way in turn order."""

    def __init__(self, conv: str) -> None:
        self.conv, self.sha, self.audit = conv, hashlib.sha256(), bytearray()
        self.counts, self.illegal, self.cost = [0, 0, 0, 0], 0, 0
        self.low = self.high = self.before = None
        self.turns, self.state, self.lines = 0, 0, 0
        self.edits, self.at = b"", 0

    def piece(self, edits: bytes, cost: int) -> None:
        """The next rows' edits; the first piece also has the cost of the whole conversation."""
        if not self.edits:
            self.cost = cost
        self.edits, self.at = edits, 0

    def line(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) * bool(self.lines)}{role}:{text}".encode())
        self.lines += 1

    def insert(self) -> None:
        self.audit += b"I"
        self.line(ROLES[FOLLOWS[self.state]], "")
        self.state = NEXT[self.state]

    def meet(self, known: bool, turn: int, role: str, fault: int, text: str) -> None:
        if known and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.counts[fault] += 1
        byte, self.at = self.edits[self.at], self.at + 1
        while (letter := LETTERS[byte >> 2 * self.state & 3]) == "I":
            self.insert()
        self.audit += letter.encode()
        if letter == "K":
            self.line(role, text)
            self.state = 1 if initial == "s" else NEXT[self.state]
        elif letter == "R":
            self.line(ROLES[FOLLOWS[self.state]], text)
            self.state = NEXT[self.state]

    def result(self) -> tuple:
        while self.state in (1, 2):
            self.insert()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.counts[1:], self.illegal, self.cost, self.audit.decode(), self.sha.hexdigest())


def repaired(df: DataFrame) -> DataFrame:
    """One row per conversation of the table: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = written(judged(damaged(df)))
    pieces = edit_pieces(rows)
    sort = ["conv", "known", "turn", "role", "digest", "nth"]
    none = lambda kind: F.lit(None).cast(kind)
    lines = rows.select(*_sort_columns(), F.lit(1).alias("part"), "here", "fault", "text", none("binary").alias("edits"), F.lit(0).cast("long").alias("cost"))
    heads = pieces.select(*sort, F.lit(0).alias("part"), F.lit(True).alias("here"), F.lit(0).alias("fault"), F.lit("").alias("text"), "edits", "cost")
    up = lines.unionByName(heads).repartition("conv").sortWithinPartitions(*sort, "part")
    columns = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches):
        now = None
        for pdf in batches:
            out = []
            for conv, known, turn, role, part, here, fault, text, edits, cost in zip(*(pdf[c] for c in ("conv", "known", "turn", "role", "part", "here", "fault", "text", "edits", "cost")), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        out.append(now.result())
                    now = _Repair(conv)
                if part == 0:
                    now.piece(edits, cost)
                elif here:
                    now.meet(known, turn, role, fault, text)
            if out:
                yield pd.DataFrame(out, columns=columns)
        if now is not None:
            yield pd.DataFrame([now.result()], columns=columns)

    done = up.mapInPandas(run, "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    return done.select(F.when(F.col("conv") != "", F.col("conv")).cast("long").alias("conv_id"), *columns[1:])
