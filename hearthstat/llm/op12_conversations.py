"""Conversation structure repair: cheapest edits to turns of system, user and assistant, as integer minima over a small graph."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
OK, BLANK, DUPLICATE, TRUNCATED = range(4)

#: Digits of the audit letters, in ASCII order; 0 pads the end, so that a shorter audit comes before its continuations.
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
_LETTER = " DIKR"
_BITS = 3
_COST = {DELETE: 4, INSERT: 3, KEEP: 0, REROLE: 3}
_TRUNCATED_COST = 3

#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. What a new user or assistant row leads to, and what a kept one does.
_NEXT = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
_KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_ENDS = (0, 3)
_LEGAL = {"su", "ua", "au"}
#: Two insertions and one deletion let any state follow the edits of any other: a way that costs more than this above the least is never the best.
_APART = 10
_COMMIT = 32
_WIDTH = 128


class Repair:
    """The cheapest edits of one conversation, row by row, ties to the ASCII-least audit.

    Each state holds one integer: the cost in the high digits, below it ``width`` octal digits with the audit's letters from the left, zeros after the
    last. An edit adds its cost and its letter at the next place, so the least integer is the cheapest, ASCII-least way to a state. Of
    two ways of one cost to a state neither audit begins the other (what follows could only be insertions, which cost), so what comes later cannot turn
    their order. Letters that all states share are settled: they are applied to the waiting rows and leave the integers, which stay short.

    More than two insertions in a row lead nowhere that two fewer do not.
    """

    def __init__(self) -> None:
        self.width, self.ways, self.waiting = _WIDTH, {0: (0, 0)}, deque()
        self.settled_state, self.audit, self.rows = 0, bytearray(), 0

    def _edit(self, way: tuple[int, int], letter: int, more: int = 0) -> tuple[int, int]:
        number, length = way
        return number + (_COST[letter] + more << _BITS * self.width) + (letter << _BITS * (self.width - 1 - length)), length + 1

    def _with_insertions(self) -> dict[int, tuple[int, int]]:
        best, step = dict(self.ways), self.ways
        for _ in range(2):
            new: dict[int, tuple[int, int]] = {}
            for state, way in step.items():
                to = _NEXT[state][0]
                new[to] = min(new.get(to, found := self._edit(way, INSERT)), found)
            for state, way in new.items():
                best[state] = min(best.get(state, way), way)
            step = new
        return best

    def feed(self, role: str, text: str, fault: int) -> Iterator[tuple[str, str]]:
        """Takes the next row; gives the repaired rows that are settled by now."""
        if max(length for _, length in self.ways.values()) + 3 > self.width:
            self._widen()
        new: dict[int, tuple[int, int]] = {}
        more = _TRUNCATED_COST if fault == TRUNCATED else 0
        for state, way in self._with_insertions().items():
            found = [(state, self._edit(way, DELETE))]
            if fault not in (BLANK, DUPLICATE):
                found.append((_NEXT[state][0], self._edit(way, REROLE, more)))
                if (to := _KEPT[state].get(role[:1])) is not None:
                    found.append((to, self._edit(way, KEEP, more)))
            for to, edited in found:
                new[to] = min(new.get(to, edited), edited)
        most = (min(new.values())[0] >> _BITS * self.width) + _APART
        self.ways = {state: way for state, way in new.items() if way[0] >> _BITS * self.width <= most}
        self.waiting.append((role, text))
        self.rows += 1
        if self.rows % _COMMIT == 0:
            yield from self._settle()

    def _widen(self) -> None:
        low = (1 << _BITS * self.width) - 1
        self.ways = {s: ((n >> _BITS * self.width << 2 * _BITS * self.width) | (n & low) << _BITS * self.width, length) for s, (n, length) in self.ways.items()}
        self.width *= 2

    def _settle(self) -> Iterator[tuple[str, str]]:
        low = (1 << _BITS * self.width) - 1
        first = next(iter(self.ways.values()))[0]
        differ = 0
        for number, _ in self.ways.values():
            differ |= (number ^ first) & low
        same = min(self.width - -(-differ.bit_length() // _BITS), *(length for _, length in self.ways.values()), self.width)
        letters = self._letters(first, same)
        rest = (1 << _BITS * (self.width - same)) - 1
        self.ways = {s: ((n >> _BITS * self.width << _BITS * self.width) | (n & rest) << _BITS * same, length - same) for s, (n, length) in self.ways.items()}
        yield from self._apply(letters)

    def _letters(self, number: int, count: int) -> list[int]:
        digits = number >> _BITS * (self.width - count) & (1 << _BITS * count) - 1
        return [digits >> _BITS * (count - 1 - i) & 7 for i in range(count)]

    def _apply(self, letters: list[int]) -> Iterator[tuple[str, str]]:
        for letter in letters:
            self.audit.append(ord(_LETTER[letter]))
            role, text = ("", "") if letter == INSERT else self.waiting.popleft()
            if letter == KEEP:
                self.settled_state = _KEPT[self.settled_state][role[:1]]
            elif letter != DELETE:
                self.settled_state, role = _NEXT[self.settled_state]
            if letter != DELETE:
                yield role, text

    def finish(self) -> Iterator[tuple[str, str]]:
        """The rest of the repaired rows; ``cost`` and ``audit`` are whole after it."""
        number, length = min(way for state, way in self._with_insertions().items() if state in _ENDS)
        self.cost = number >> _BITS * self.width
        yield from self._apply(self._letters(number, length))


class _Report:
    """Counts over the rows of one conversation as they come by."""

    def __init__(self) -> None:
        self.repair, self.counts = Repair(), [0] * 4
        self.least = self.turn = None
        self.turns = self.illegal = self.place = 0
        self.initial = self.last = None

    def feed(self, turn: int | None, role: str, text: str, fault: int) -> Iterator[tuple[str, str]]:
        if turn is not None and (self.turns == 0 or turn != self.turn):
            self.least, self.turn, self.turns = turn if self.turns == 0 else self.least, turn, self.turns + 1
        row = (turn, role, text)
        if fault in (OK, TRUNCATED) and row == self.last:
            fault = DUPLICATE
        if self.initial is not None and self.initial + role[:1] not in _LEGAL:
            self.illegal += 1
        self.initial, self.last = role[:1], row
        self.counts[fault] += 1
        yield from self.repair.feed(role, text, fault)

    def summary(self) -> dict:
        gaps = min(self.turn - self.least + 1 - self.turns, 2**63 - 1) if self.turns else 0
        return {"gaps": gaps, "blank": self.counts[BLANK], "duplicate": self.counts[DUPLICATE], "truncated": self.counts[TRUNCATED], "illegal": self.illegal, "cost": self.repair.cost, "audit": self.repair.audit.decode()}


_REPORT = "struct<gaps: bigint, blank: bigint, duplicate: bigint, truncated: bigint, illegal: bigint, cost: bigint, audit: string>"
_REPORT_TYPE = pa.struct([(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())])
_OUT_ROWS, _OUT_CHARS = 4096, 4 << 20


def _repaired(batches) -> Iterator[pa.RecordBatch]:
    """Repaired rows, and a report after the last of each conversation, of rows sorted by conversation and turn."""
    out: list[tuple] = []
    held = 0
    conv, report = None, None

    def batch() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), _REPORT_TYPE)
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["conv", "place", "role", "text", "report"])

    def shown(rows) -> None:
        nonlocal held
        for role, text in rows:
            report.place += 1
            out.append((conv, report.place, role, text, None))
            held += len(text)

    def close() -> None:
        shown(report.repair.finish())
        out.append((conv, None, None, None, report.summary()))

    for got in batches:
        for key, turn, role, text, fault in zip(*(got.column(c).to_pylist() for c in range(5))):
            if report is None or key != conv:
                if report is not None:
                    close()
                conv, report = key, _Report()
            if fault is not None:
                shown(report.feed(turn, role, text, fault))
            if len(out) >= _OUT_ROWS or held >= _OUT_CHARS:
                yield batch()
                out, held = [], 0
    if report is not None:
        close()
    if out:
        yield batch()


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None) -> DataFrame:
    """The cheapest edits that give every conversation the order (system)? (user assistant)+, or leave nothing of it.

    Rows are taken by turn (nulls first; equal turns by role and text). A row's first fault counts: blank (only white space), duplicate (role and
    text stand in an earlier row), truncated (does not end in ``.``, ``!`` or ``?``). Keeping a row costs 0, another role 3, deletion 4, an inserted row
    with empty text 3, a truncated row that stays 3 more; blank and duplicate rows must be deleted. A row's role counts by its first letter.

    Returns the repaired rows, ``conv``, ``place`` (from 1), ``role``, ``text``, and as the last row of each conversation one with ``report``: gaps in the
    turns, faults, adjacent rows out of order, cost, and audit, the first letters of the edits in order. Rows of a conversation lie together and in order
    in one partition. Rows where ``present`` is false only name their conversation.

    One shuffle by conversation, sorted there and streamed; duplicates are found before it by partial aggregates over (conversation, digest). Of a
    conversation a task holds the rows that are not settled yet, and the audit. That one conversation is one stream is in the nature of the order.

    A null role or text is one space; a null conversation is one. Rows that repeat are duplicates. Empty in, empty out. Other columns are not read.
    """
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    here = F.coalesce(present, F.lit(False)) if present is not None else F.lit(True)
    named = rows.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), value(role_col).alias("role"), value(text_col).alias("text"), here.alias("here"))
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    shown = named.withColumn("digest", F.when(F.col("here"), digest)).withColumn("order", order)
    firsts = shown.where("here").groupBy("conv", "digest").agg(F.min("order").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = firsts.select(F.col("conv").alias("first_conv"), F.col("digest").alias("first_digest"), "first")
    seen = shown.join(firsts, shown["conv"].eqNullSafe(firsts["first_conv"]) & (shown["digest"] == firsts["first_digest"]), "left")
    solid = F.rtrim("text", F.lit(SPACE))
    fault = (
        F.when(~F.col("here"), F.lit(None)).when(solid == "", BLANK).when(F.col("first").isNotNull() & (F.col("order") != F.col("first")), DUPLICATE)
        .when(~F.substring(solid, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(OK)
    )
    ready = seen.select("conv", "turn", "role", F.when(F.col("here"), F.col("text")).alias("text"), fault.cast("int").alias("fault"))
    laid = ready.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return laid.mapInArrow(_repaired, f"conv long, place long, role string, text string, report {_REPORT}")


def damage(rows: DataFrame) -> DataFrame:
    """The query's damage by a hash of conversation and turn; ``here`` is false for rows that it drops. Nulls are one space in it."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    named = rows.select("conv_id", "turn", value("role").alias("role"), value("text").alias("text"), (F.crc32(F.concat(value("conv_id"), F.lit(":"), value("turn")).cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.col("kind") != 0))
    return named.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("here"))


def _hashed(batches) -> Iterator[pa.RecordBatch]:
    """Reports with the SHA-256 of the repaired rows before them, as ``role:text`` joined by newlines."""
    state, some = hashlib.sha256(), False
    for batch in batches:
        out = []
        for conv, role, text, report in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text", "report"))):
            if report is None:
                state.update((f"\n{role}:{text}" if some else f"{role}:{text}").encode())
                some = True
            else:
                out.append((conv, *report.values(), state.hexdigest()))
                state, some = hashlib.sha256(), False
        kinds = (pa.int64(),) * 7 + (pa.string(),) * 2
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    found = repair_conversations(rows, present=F.col("here"))
    return found.mapInArrow(_hashed, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
