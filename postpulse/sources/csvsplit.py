"""Quoted CSV with newlines inside quotes, read by many tasks per file (survey S6).

Spark's ``multiLine`` parser takes a whole file as one task. Here the file is read as lines, which
Spark splits at any byte range, and lines become records by quote parity: a line ends a record if
the number of quotes up to there is even.

1. One scan counts quotes per block (a byte range of a file) and keeps the lines at its start that
   would finish a record begun before it (longer ones are read once more, where they are needed).
2. The parity at a block's start is the XOR over the blocks before it in its file, one small row
   per block; what a block's last record misses are the first lines of the blocks after it.
3. A second scan glues lines to records, batch by batch, from the block's parity; nothing is
   shuffled but the rows of step 2.
4. ``from_csv`` parses the records, so types, modes and widths are the parser's own.

Quotes must be RFC 4180's: around whole fields, doubled inside them. Records end at ``\\n`` or
``\\r\\n``. For other files ``read_delimited(multiline=True)`` stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from postpulse.session import stored

BROADCAST_BLOCKS = 50_000      # rows of the block table that are sent to every task at most
TAIL_CHARS = 1 << 20           # of a block's first lines that the first scan keeps
CORRUPT = "_corrupt"


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, value): lines in file order within their block."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), "value")


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The runs of rows of one block in a batch."""
    file, block = batch["file"].dictionary_encode(), batch["block"].to_numpy()
    codes = file.indices.to_numpy()
    cuts = np.flatnonzero((codes[1:] != codes[:-1]) | (block[1:] != block[:-1])) + 1
    for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
        if hi > lo:
            yield file.dictionary[codes[lo]].as_py(), int(block[lo]), batch.slice(lo, hi - lo)


def _quotes(lines: pa.Array) -> np.ndarray:
    return pc.count_substring(lines, '"').to_numpy(zero_copy_only=False).astype(np.int64)


def count_quotes(limit: int | None):
    """(file, block, odd, closed, tail): whether a block has an odd number of quotes, and the
    lines that finish a record if the block starts inside quotes (``closed``: they do finish it).

    ``tail`` is null where it has more than ``limit`` characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, quotes, closed, tail, size = None, 0, False, [], 0

        def done() -> pa.RecordBatch:
            fits = limit is None or size <= limit
            return pa.record_batch({
                "file": pa.array([at[0]]), "block": pa.array([at[1]], pa.int64()),
                "odd": pa.array([quotes % 2 == 1]), "closed": pa.array([closed]),
                "tail": pa.array(["\n".join(tail) if fits else None], pa.string())})

        for batch in batches:
            for file, block, part in _segments(batch):
                if at != (file, block):
                    if at is not None:
                        yield done()
                    at, quotes, closed, tail, size = (file, block), 0, False, [], 0
                n = _quotes(part["value"])
                if not closed:
                    ends = np.flatnonzero((quotes + np.cumsum(n)) % 2 == 1)
                    closed = len(ends) > 0
                    if limit is None or size <= limit:
                        lines = part["value"].slice(0, int(ends[0]) + 1 if closed else None)
                        size += pc.sum(pc.utf8_length(lines)).as_py()
                        tail = tail + lines.to_pylist() if limit is None or size <= limit else []
                quotes += int(n.sum())
        if at is not None:
            yield done()

    return run


def glue_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first, record): whole records; ``first`` marks the first one of a file.

    Rows have file, block, value and, the same on every row of a block, inside (the block starts
    inside quotes), closed and rest (lines that finish its last record).
    """
    at, odd, skip, first, rest, pending = None, 0, False, False, None, []

    def batch_of(flags: list[bool], records) -> pa.RecordBatch:
        return pa.record_batch({"first": pa.array(flags, pa.bool_()),
                                "record": records if isinstance(records, pa.Array)
                                else pa.array(records, pa.string())})

    def last() -> Iterator[pa.RecordBatch]:
        if pending and not skip:
            yield batch_of([first], ["\n".join(pending + ([] if rest is None else [rest]))])

    for batch in batches:
        for file, block, part in _segments(batch):
            if at != (file, block):
                yield from last()
                at, pending, first = (file, block), [], block == 0
                odd = int(part["inside"][0].as_py())
                skip = bool(odd)               # the lines up to the first border are not ours
                rest = part["rest"][0].as_py()
            lines = part["value"]
            after = (odd + np.cumsum(_quotes(lines))) % 2
            odd = int(after[-1])
            ends = np.flatnonzero(after == 0)
            if not len(ends):
                pending += lines.to_pylist()
                continue
            head = pending + lines.slice(0, int(ends[0]) + 1).to_pylist()
            if not skip:
                yield batch_of([first], ["\n".join(head)])
                first = False
            skip = False
            if len(ends) > 1:
                whole = pa.ListArray.from_arrays(pa.array(ends + 1, pa.int32()), lines)
                yield batch_of([False] * (len(ends) - 1), pc.binary_join(whole, "\n"))
            pending = lines.slice(int(ends[-1]) + 1).to_pylist()
    yield from last()


TAILS = "file string, block long, odd boolean, closed boolean, tail string"


def with_blocks(lines: DataFrame, blocks: DataFrame, broadcast_blocks: int) -> DataFrame:
    """Lines joined with rows of their block, still in order within the block."""
    if blocks.count() <= broadcast_blocks:
        return lines.join(F.broadcast(blocks), ["file", "block"])
    # lines are shuffled by block and put in order again
    return (lines.withColumn("place", F.monotonically_increasing_id())
            .join(blocks.hint("merge"), ["file", "block"])
            .repartition("file", "block").sortWithinPartitions("file", "block", "place"))


def block_table(spark: SparkSession, lines: DataFrame, tail_chars: int,
                broadcast_blocks: int) -> DataFrame:
    """(file, block, inside, rest), one row per block."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = stored(spark, lines.mapInArrow(count_quotes(tail_chars), TAILS), "csv-quotes").select(
        "file", "block", "closed", "tail",
        F.coalesce(F.sum(F.col("odd").cast("int")).over(before) % 2 == 1, F.lit(False)).alias("inside"),
        F.coalesce(F.sum(F.col("closed").cast("int")).over(before), F.lit(0)).alias("run"))
    blocks = stored(spark, blocks, "csv-blocks")
    long = blocks.where("inside and tail is null").select("file", "block")
    if not long.isEmpty():      # long records over block borders: their lines are read once more
        tails = stored(spark, with_blocks(lines, long, broadcast_blocks).select(
            "file", "block", "value").mapInArrow(count_quotes(None), TAILS), "csv-tails")
        blocks = blocks.join(tails.select("file", "block", F.col("tail").alias("whole")),
                             ["file", "block"], "left").withColumn("tail", F.coalesce("tail", "whole"))
    # a record is open at the end of a closed block only; its rest is the next run of blocks, up
    # to and including the next closed one
    runs = blocks.where("inside").groupBy("file", (F.col("run") - 1).alias("run")).agg(F.concat_ws(
        "\n", F.transform(F.sort_array(F.collect_list(F.struct("block", "tail"))),
                          lambda x: x["tail"])).alias("rest"))
    return stored(spark, blocks.join(runs, ["file", "run"], "left").select(
        "file", "block", "inside", "rest"), "csv-starts")


def split_records(spark: SparkSession, path: str | list[str], header: bool = True,
                  tail_chars: int = TAIL_CHARS,
                  broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """(record): the text of every record below ``path``, blank ones left out."""
    lines = text_lines(spark, path)
    blocks = block_table(spark, lines, tail_chars, broadcast_blocks)
    glued = with_blocks(lines, blocks, broadcast_blocks).select(
        "file", "block", "value", "inside", "rest").mapInArrow(
        glue_lines, "first boolean, record string")
    if header:
        glued = glued.where("not first")
    record = F.when(F.col("record").endswith("\r"), F.expr("substring(record, 1, length(record) - 1)")
                    ).otherwise(F.col("record"))
    return glued.select(record.alias("record")).where("record <> ''")


def read_split(spark: SparkSession, path: str | list[str], schema: StructType | str, sep: str = ",",
               header: bool = True, mode: str = "FAILFAST", tail_chars: int = TAIL_CHARS,
               broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """Rows of quoted CSV with newlines in quotes; as ``read_delimited(multiline=True)`` gives."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    mode = mode.upper()
    parsed = schema if mode == "FAILFAST" else StructType(
        [*schema.fields, StructField(CORRUPT, StringType(), True)])
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1",
               "mode": "FAILFAST" if mode == "FAILFAST" else "PERMISSIVE",
               "columnNameOfCorruptRecord": CORRUPT}
    names = schema.fieldNames()
    rows = split_records(spark, path, header, tail_chars, broadcast_blocks).select(
        F.from_csv("record", _ddl(parsed), options).alias("r"))
    if mode == "DROPMALFORMED":
        # a test that always holds keeps every field parsed, whatever is selected later
        every = F.pmod(F.xxhash64(*[F.col(f"r.`{n}`") for n in names]), F.lit(2)) < 2
        rows = rows.where(every & F.col(f"r.{CORRUPT}").isNull())
    return rows.select(*[F.col(f"r.`{n}`").alias(n) for n in names])


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
