"""First-fit decreasing packing of token ids, with a tournament tree over each group's bins.

Documents are encoded where they are read; only lengths and checksums move on. A document's whole
runs of ``capacity`` ids are sequences of their own. What is left of it, shorter than ``capacity``,
goes to a group chosen at random (a hash of the task and the row's number in it, so equal rows
spread too), and every group of about ``group_items`` such items is packed on its own: longest
first, each into the first bin with room. The bins are the leaves of a tree whose inner nodes hold
the largest room below them; a descent to the left child whenever its room suffices finds that bin
in log2(bins) steps.

First fit leaves few bins with much room, but on unlucky lengths (all just over half a bin) it
leaves many. Bins emptier than ``1 - slack`` are therefore opened: their items are cut into powers
of two, largest first, which fill bins exactly, and the last bin becomes sequences of powers of
two, which are not padded. So padding is at most ``slack`` of the output whatever the lengths are,
and only the items of those bins are cut.

Defined results: null text has no ids but the end id; a null id stays null; repeated rows are
documents of their own; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.llm.common import id_and_text, landed
from postpulse.llm.tokens import encoder

CAPACITY = 4096
GROUP_ITEMS = 8192
SLACK = 1 / 64
AT_ONCE = 256            # documents per library call

ITEM = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, whole boolean, "
        "task long, spot long, cuts array<long>")
PIECE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
         "sequence_id long, offset long")


class Tournament:
    """Bins of equal capacity, numbered from 0; ``place`` returns the first one with room."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> int:
        room, i = self.room, 1
        if room[1] < length:
            raise ValueError("no bin has room")
        while i < self.leaves:
            i *= 2
            if room[i] < length:
                i += 1
        number = i - self.leaves
        room[i] -= length
        while i > 1:
            i //= 2
            most = max(room[2 * i], room[2 * i + 1])
            if room[i] == most:
                break
            room[i] = most
        return number


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """Bin of every item; items of equal length in the order given."""
    tree, bins = Tournament(len(lengths), capacity), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        bins[i] = tree.place(lengths[i])
    return bins


def powers(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def layout(lengths: list[int], capacity: int, slack: float) -> list[tuple[int, int, int, int, int]]:
    """(item, start in it, length, sequence, offset) of every piece of one group.

    ``capacity`` is a power of two.
    """
    bins = first_fit_decreasing(lengths, capacity)
    load: dict[int, int] = {}
    for n, b in zip(lengths, bins):
        load[b] = load.get(b, 0) + n
    closed = {b for b, n in load.items() if n >= (1 - slack) * capacity or n & (n - 1) == 0}
    numbers = {b: i for i, b in enumerate(sorted(closed))}
    at = [0] * len(numbers)
    out, parts = [], []
    for i, (n, b) in enumerate(zip(lengths, bins)):
        if b in closed:
            s = numbers[b]
            out.append((i, 0, n, s, at[s]))
            at[s] += n
        else:
            start = 0
            for p in powers(n):
                parts.append((i, start, p))
                start += p
    # descending powers of two: every sequence but those of the last bin is full
    parts.sort(key=lambda x: -x[2])
    s, room = len(numbers) - 1, 0
    left = sum(p for *_, p in parts)
    for i, start, p in parts:
        if not room:
            s += 1
            size = room = min(capacity, 1 << left.bit_length() - 1)
        out.append((i, start, p, s, size - room))
        room -= p
        left -= p
    return out


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.tobytes())


def items(df: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole runs of ``capacity`` ids and the rest of every document, with checksums.

    ``cuts`` holds the checksums of the rest's parts of ``powers(length)`` ids.
    """
    end = np.array([end_id], "<u4")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, spot = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, AT_ONCE):
                cut = batch.slice(lo, AT_ONCE)
                row, start, length, crc, total, cuts = [], [], [], [], [], []
                for r, ids in enumerate(enc.encode(cut["text"].to_pylist())):
                    ids = np.concatenate([ids, end])
                    for at in range(0, len(ids), capacity):
                        piece = ids[at:at + capacity]
                        row.append(r)
                        start.append(at)
                        length.append(len(piece))
                        crc.append(checksum(piece))
                        total.append(len(ids))
                        ends = np.cumsum([0, *powers(len(piece))]).tolist()
                        cuts.append([checksum(piece[a:b]) for a, b in zip(ends, ends[1:])]
                                    if len(piece) < capacity else None)
                yield pa.record_batch({
                    "doc_id": cut["doc_id"].take(pa.array(row, pa.int64())),
                    "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                    "doc_tokens": pa.array(total, pa.int64()),
                    "whole": pa.array([n == capacity for n in length], pa.bool_()),
                    "task": pa.array([task] * len(row), pa.int64()),
                    "spot": pa.array(range(spot, spot + len(row)), pa.int64()),
                    "cuts": pa.array(cuts, pa.list_(pa.int64()))})
                spot += len(row)

    return id_and_text(df, id_col, text_col).mapInArrow(encode, ITEM)


def pack(spark: SparkSession, df: DataFrame, tokenizer: str, end_id: int,
         capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, slack: float = SLACK,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document, ``end_id`` included, lies in exactly one piece; the pieces of a
    sequence follow each other from offset 0 and hold at most ``capacity`` ids (a power of two).
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity is not a power of two")
    held = landed(spark, items(df, tokenizer, end_id, capacity, id_col, text_col), "ffd-items")
    rest = held.where(~F.col("whole"))
    groups = max(1, -(-rest.count() // group_items))
    # a group's sequences are even numbers, whole runs odd ones
    alone = held.where("whole").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (2 * (F.shiftleft("task", 40) + F.col("spot")) + 1).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("task", "ascending"), ("spot", "ascending")])
        pieces = layout(table["length"].to_pylist(), capacity, slack)
        item, begin, length, sequence, offset = map(list, zip(*pieces))
        whole, cuts = table["ids_crc32"].to_pylist(), table["cuts"].to_pylist()
        lengths = table["length"].to_pylist()
        part: dict[int, int] = {}      # the next cut of an item that was cut
        crc: list[int] = [0] * len(pieces)
        for k in sorted(range(len(pieces)), key=lambda k: (item[k], begin[k])):
            i = item[k]
            if length[k] == lengths[i]:
                crc[k] = whole[i]
            else:
                crc[k] = cuts[i][part.get(i, 0)]
                part[i] = part.get(i, 0) + 1
        rows = pa.array(item, pa.int64())
        base = table["grp"][0].as_py() << 25
        start = np.array(begin, np.int64) + table["start"].take(rows).to_numpy()
        return pa.table({
            "doc_id": table["doc_id"].take(rows), "start": pa.array(start, pa.int64()),
            "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
            "doc_tokens": table["doc_tokens"].take(rows),
            "sequence_id": pa.array([base + 2 * s for s in sequence], pa.int64()),
            "offset": pa.array(offset, pa.int64())})

    dealt = rest.withColumn("grp", F.pmod(F.xxhash64("task", "spot"), F.lit(groups)))
    return alone.unionByName(dealt.groupBy("grp").applyInArrow(fill, PIECE))
