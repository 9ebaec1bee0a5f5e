"""Cheapest repair of a conversation's turn structure, by Four-Russians block tables.

A conversation should read ``(system? (user assistant)+)?``. Every row is a symbol: must go (blank
or a repetition), or its role's initial with or without a truncated text. Costs after a prefix
form a vector over four states (nothing yet; after system, user, assistant). Less its minimum, and
with entries too large to matter replaced by ``NEVER``, that vector is one of about 220. For each
of them and each block of four symbols a table holds the next vector and what the minimum grew by;
a conversation is processed by one lookup a block. For the trace, blocks are expanded from the last
to the first: the vectors inside a block follow from the one at its border, and every state on some
cheapest path is marked. Walking forward over marked states with the least letter first gives the
ASCII-least of all cheapest edit strings, ties between blocks included.

Edits: Keep 0, Rerole to user or assistant 1, Delete 2 (the only one for rows that must go), Insert
an empty user or assistant row 5; a truncated row that is not deleted costs 5 more.

Rows are sorted by conversation and turn and read as a stream: one conversation is held at a time.
One of more than ``KEEP_ROWS`` rows or ``KEEP_CHARS`` characters only gets a mark; then equal rows
are added up before the shuffle, repetitions are found by an aggregate and a join, a stream holds
three bytes a row (its edit string is as long), and a second stream spells the repaired rows.

Defined results: null role or text is one space; turns that are null come first; rows of one turn
are ordered by role, then text; a null conversation id is a conversation; an empty table gives an
empty result; a conversation without rows (``copies`` 0 only) has zeros and an empty edit string.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.llm.common import landed

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLOCK = 4
#: Symbols: system, user, assistant, other role; the same truncated; must go; nothing.
SYMBOLS, GONE, PAD = 10, 8, 9
NEVER = 99
#: A state that is this much dearer than another lies on no cheapest path: the cheaper one can
#: follow the dearer one's path by two insertions and one deletion at most.
USELESS = 2 * INSERT + DELETE
#: State after a user or assistant row that was inserted or given its role.
NEXT = (2, 2, 3, 2)
ENDS = (0, 3)
BLANKS = " \t\n\v\f\r"
KEEP_ROWS = 100_000
KEEP_CHARS = 16 << 20

REPORT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, "
          "cost long, audit string, repaired_sha256 string, large boolean")


def kept_state(state: int, symbol: int) -> int | None:
    """Where keeping a row leads, None where its role may not come next."""
    initial = symbol % 4
    if initial == 0:
        return 1 if state == 0 else None
    if initial == 1:
        return 2 if state != 2 else None
    return 3 if initial == 2 and state == 2 else None


def edges(state: int, symbol: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of every edit of a row, letters ascending."""
    yield "D", DELETE, state
    if symbol != GONE:
        more = TRUNCATED if symbol >= 4 else 0
        kept = kept_state(state, symbol)
        if kept is not None:
            yield "K", more, kept
        yield "R", REROLE + more, NEXT[state]


class Tables:
    """Vectors in use, single steps, block steps and marks."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.step: list[list[tuple[int, int]]] = []
        self.start = self._find(self._inserted([0, NEVER, NEVER, NEVER]))[0]
        while len(self.step) < len(self.vectors):
            v = self.vectors[len(self.step)]
            self.step.append([self._find(self._after(v, s)) for s in range(SYMBOLS)])
        nxt = np.array([[n for n, _ in row] for row in self.step])
        grow = np.array([[g for _, g in row] for row in self.step])
        to = np.arange(len(self.vectors))[:, None]
        total = np.zeros((len(self.vectors), 1), dtype=np.int64)
        for _ in range(BLOCK):       # one more symbol at the end of every block
            total = (total[:, :, None] + grow[to]).reshape(len(self.vectors), -1)
            to = nxt[to].reshape(len(self.vectors), -1)
        self.blocks = SYMBOLS ** BLOCK
        self.block_next = to.astype(np.uint8).tobytes()
        self.block_grow = total.astype(np.uint8).tobytes()

    @staticmethod
    def _inserted(v: list[int]) -> list[int]:
        for _ in range(2):
            for state, to in enumerate(NEXT):
                v[to] = min(v[to], v[state] + INSERT)
        return v

    def _after(self, v: tuple[int, ...], symbol: int) -> list[int]:
        if symbol == PAD:
            return list(v)
        out = [NEVER] * 4
        for state, cost in enumerate(v):
            for _, more, to in edges(state, symbol):
                out[to] = min(out[to], cost + more)
        return self._inserted(out)

    def _find(self, v: list[int]) -> tuple[int, int]:
        least = min(v)
        key = tuple(c - least if c - least <= USELESS else NEVER for c in v)
        if key not in self.number:
            self.number[key] = len(self.vectors)
            self.vectors.append(key)
        return self.number[key], least

    @functools.cache  # noqa: B019  one instance a process
    def marked(self, vector: int, symbol: int, after: int) -> int:
        """States before a row that are on a cheapest path, given those after it (bit sets)."""
        v = self.vectors[vector]
        if symbol == PAD:
            return after
        to, grown = self.step[vector][symbol]
        w, mask = self.vectors[to], 0
        for state in range(4):
            if v[state] < NEVER and any(after >> s & 1 and v[state] + c == w[s] + grown
                                        for _, c, s in edges(state, symbol)):
                mask |= 1 << state
        return self.before_inserts(vector, mask)

    def before_inserts(self, vector: int, mask: int) -> int:
        v = self.vectors[vector]
        for _ in range(2):
            for state, to in enumerate(NEXT):
                if mask >> to & 1 and v[state] < NEVER and v[state] + INSERT == v[to]:
                    mask |= 1 << state
        return mask

    def repair(self, symbols: bytes | bytearray) -> tuple[int, str]:
        """(cost, ASCII-least cheapest edit string) of a conversation."""
        n = len(symbols)
        full = bytes(symbols) + bytes([PAD]) * (-n % BLOCK)
        borders, v, cost = bytearray(), self.start, 0
        for at in range(0, len(full), BLOCK):
            code = 0
            for s in full[at:at + BLOCK]:
                code = code * SYMBOLS + s
            borders.append(v)
            cost += self.block_grow[v * self.blocks + code]
            v = self.block_next[v * self.blocks + code]
        last = self.vectors[v]
        least = min(last[s] for s in ENDS)
        # states at every row's place and marks there, from the last block to the first
        inside, marks = bytearray(len(full) + 1), bytearray(len(full) + 1)
        inside[len(full)] = v
        marks[len(full)] = self.before_inserts(v, sum(1 << s for s in ENDS if last[s] == least))
        for b in range(len(borders) - 1, -1, -1):
            at, v = b * BLOCK, borders[b]
            for i in range(at, at + BLOCK):
                inside[i] = v
                v = self.step[v][full[i]][0]
            for i in range(at + BLOCK - 1, at - 1, -1):
                marks[i] = self.marked(inside[i], full[i], marks[i + 1])
        return cost + least, self._walk(full, n, inside, marks)

    def _walk(self, full: bytes, n: int, inside: bytearray, marks: bytearray) -> str:
        out, i, state = [], 0, 0
        while True:
            v = self.vectors[inside[i]]
            inserted = marks[i] >> NEXT[state] & 1 and v[state] + INSERT == v[NEXT[state]]
            if i == n:
                least = min(v[s] for s in ENDS)
                if state in ENDS and v[state] == least:
                    return "".join(out)
                letter, state = "I", NEXT[state]
                out.append(letter)
                continue
            to, grown = self.step[inside[i]][full[i]]
            w = self.vectors[to]
            good = [(x, s) for x, c, s in edges(state, full[i])
                    if marks[i + 1] >> s & 1 and v[state] + c == w[s] + grown]
            if inserted and not (good and good[0][0] < "I"):
                out.append("I")
                state = NEXT[state]
                continue
            letter, state = good[0]
            out.append(letter)
            i += 1


@functools.cache
def tables() -> Tables:
    return Tables()


class Speller:
    """The repaired rows, from the edit string and the rows in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._role(), ""

    def _role(self) -> str:
        role = "assistant" if self.state == 2 else "user"
        self.state = NEXT[self.state]
        return role

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self._inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = {"s": 1, "u": 2, "a": 3}[role[0]]
            yield role, text
        elif letter == "R":
            yield self._role(), text

    def rest(self) -> Iterator[tuple[str, str]]:
        yield from self._inserted()


class Digest:
    """sha256 of the lines ``role:text`` joined by newlines."""

    def __init__(self):
        self.sha, self.lines = hashlib.sha256(), 0

    def add(self, lines) -> None:
        for role, text in lines:
            self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
            self.lines += 1


class Conversation:
    """One conversation while its rows pass by in order."""

    def __init__(self, conv_id: int | None, keep: tuple[int, int] | None):
        self.conv_id, self.keep, self.large = conv_id, keep, False
        self.symbols = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = None
        self.turns = 0
        self.before: str | None = None
        self.rows: list[tuple[str, str]] = []
        self.seen: set[tuple[str, str]] = set()
        self.held = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, first: bool | None) -> None:
        if not copies or self.large:
            return
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        initial = role[:1]
        legal = self.before is None or self.before + initial in ("su", "ua", "au")
        self.illegal += copies - 1 + (not legal)
        self.before = initial
        body = text.rstrip(BLANKS)
        if self.keep:
            first = (role, text) not in self.seen
            self.seen.add((role, text))
            self.rows += [(role, text)] * copies
            self.held += len(role) + len(text) if first else 0
            if len(self.rows) > self.keep[0] or self.held > self.keep[1]:
                self.large, self.rows, self.seen = True, [], set()
                return
        if not body:
            self.blank += copies
            self.symbols += bytes([GONE]) * copies
            return
        repeated = copies - 1 if first else copies
        if first:
            cut = body[-1] not in ".!?"
            self.truncated += cut
            self.symbols.append({"s": 0, "u": 1, "a": 2}.get(initial, 3) + 4 * cut)
        self.duplicate += repeated
        self.symbols += bytes([GONE]) * repeated

    def report(self) -> tuple:
        if self.large:
            return (self.conv_id, *[None] * 8, True)
        cost, audit = tables().repair(self.symbols)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        sha = None
        if self.keep:
            speller, digest = Speller(audit), Digest()
            for role, text in self.rows:
                digest.add(speller.row(role, text))
            digest.add(speller.rest())
            sha = digest.sha.hexdigest()
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal,
                cost, audit, sha, False)


def as_batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in types]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types.values())],
                           names=list(types))


REPORT_TYPES = {"conv_id": pa.int64(), **{c: pa.int64() for c in (
    "gaps", "blank", "duplicate", "truncated", "illegal", "cost")},
    "audit": pa.string(), "repaired_sha256": pa.string(), "large": pa.bool_()}


def reports(keep: tuple[int, int] | None):
    """Sorted rows to one report a conversation; ``keep``: rows and characters held of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for batch in batches:
            out = []
            first = batch["first"].to_pylist() if not keep else [None] * batch.num_rows
            for conv, turn, role, text, copies, f in zip(
                    *(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "copies")),
                    first):
                if current is None or conv != current.conv_id:
                    if current is not None:
                        out.append(current.report())
                    current = Conversation(conv, keep)
                current.add(turn, role, text, copies, f)
            yield as_batch(out, REPORT_TYPES)
        if current is not None:
            yield as_batch([current.report()], REPORT_TYPES)

    return run


ROW = ["conv_id", "turn", "role", "text"]


def turn_rows(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str,
              copies_col: str | None) -> DataFrame:
    space = F.lit(" ")
    copies = F.lit(1) if copies_col is None else F.col(copies_col)
    return df.select(F.col(id_col).cast("long").alias("conv_id"),
                     F.col(turn_col).cast("long").alias("turn"),
                     F.coalesce(F.col(role_col), space).alias("role"),
                     F.coalesce(F.col(text_col), space).alias("text"),
                     copies.cast("long").alias("copies"))


def repair(spark: SparkSession, df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
           role_col: str = "role", text_col: str = "text",
           copies_col: str | None = None, keep_rows: int = KEEP_ROWS,
           keep_chars: int = KEEP_CHARS) -> DataFrame:
    """One row per conversation: faults, gaps in its turns, cost, edit string, digest.

    ``copies_col`` says how often each row occurs; with 0 only its conversation is known.
    """
    rows = turn_rows(df, id_col, turn_col, role_col, text_col, copies_col)
    found = landed(spark, rows.repartition("conv_id").sortWithinPartitions(*ROW).mapInArrow(
        reports((keep_rows, keep_chars)), REPORT), "turn-repair")
    small = found.where(~F.col("large"))
    large = found.where("large").select(F.col("conv_id").alias("large_id"))
    if large.isEmpty():
        return small.drop("large")
    return small.unionByName(repair_large(spark, rows.join(
        large, F.col("conv_id").eqNullSafe(F.col("large_id")), "left_semi"))).drop("large")


def repair_large(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The same report for conversations that are not held in memory."""
    alike = landed(spark, rows.groupBy(*ROW).agg(F.sum("copies").alias("copies")), "turn-rows")
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = alike.where("copies > 0").groupBy("conv_id", "role", "text").agg(
        F.min(place).alias("place"))
    a, b = alike.alias("a"), firsts.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("conv_id", "role", "text")]
    marked = a.join(b, same[0] & same[1] & same[2], "left").select(
        *[f"a.{c}" for c in [*ROW, "copies"]],
        F.col("b.place.turn").eqNullSafe(F.col("a.turn")).alias("first"))
    found = landed(spark, marked.repartition("conv_id").sortWithinPartitions(*ROW).mapInArrow(
        reports(None), REPORT), "turn-repair-large")
    digests = spelled(alike, found, digest=True)
    return found.alias("f").join(
        digests.alias("d"), F.col("f.conv_id").eqNullSafe(F.col("d.conv_id"))).select(
        *[f"f.{c}" for c in REPORT_TYPES if c not in ("repaired_sha256", "large")],
        "d.repaired_sha256", "f.large")


def repaired_turns(df: DataFrame, report: DataFrame, id_col: str = "conv_id",
                   turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                   copies_col: str | None = None) -> DataFrame:
    """The repaired conversations: conv_id, position, role, text."""
    return spelled(turn_rows(df, id_col, turn_col, role_col, text_col, copies_col), report, False)


def spelled(rows: DataFrame, report: DataFrame, digest: bool) -> DataFrame:
    """Rows and edit strings of a conversation in one stream, the edit string first."""
    first = report.select("conv_id", F.lit(0).alias("kind"), "audit",
                          *[F.lit(None).cast(t).alias(c) for c, t in (
                              ("turn", "long"), ("role", "string"), ("text", "string"),
                              ("copies", "long"))])
    then = rows.withColumn("kind", F.lit(1)).withColumn("audit", F.lit(None).cast("string"))
    both = first.unionByName(then).repartition("conv_id").sortWithinPartitions(
        "conv_id", "kind", "turn", "role", "text")
    types = {"conv_id": pa.int64(), **({"repaired_sha256": pa.string()} if digest else
                                       {"position": pa.int64(), "role": pa.string(),
                                        "text": pa.string()})}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller, conv, sha, position = None, None, Digest(), 0
        out: list[tuple] = []

        def put(lines) -> None:
            nonlocal position
            if digest:
                sha.add(lines)
                return
            for role, text in lines:
                out.append((conv, position, role, text))
                position += 1

        def close() -> None:
            if speller is not None:
                put(speller.rest())
                if digest:
                    out.append((conv, sha.sha.hexdigest()))

        for batch in batches:
            for c, kind, audit, role, text, copies in zip(*(batch[x].to_pylist() for x in (
                    "conv_id", "kind", "audit", "role", "text", "copies"))):
                if kind == 0:
                    close()
                    speller, conv, sha, position = Speller(audit), c, Digest(), 0
                    continue
                for _ in range(copies):
                    put(speller.row(role, text))
            yield as_batch(out, types)
            out.clear()
        close()
        yield as_batch(out, types)

    schema = "conv_id long, " + ("repaired_sha256 string" if digest else
                                 "position long, role string, text string")
    return both.mapInArrow(run, schema)
