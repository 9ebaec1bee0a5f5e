"""Token-id files with fixed-width bit packing.

File layout (little endian)::

    "PPTOKBIN"  u32 version  u32 bits  u32 block_ids  u32 zero
    blocks      each ``block_ids`` ids (the last one fewer), ``bits`` bits an id, first id in
                the highest bits of the first byte, each block padded to a whole byte
    footer      u64 block offsets[n_blocks + 1], i64 doc ids[n_docs], u8 has_id[n_docs],
                u64 starts[n_docs + 1] (ids before a document in this file)
    tail        u64 footer offset  u64 n_ids  u64 n_docs  u64 n_blocks  "PPTOKEND"

An id's block and place in it follow from its number, so any document is read with one
footer and the blocks it touches; a block is unpacked by numpy without a loop.

Documents are range-partitioned by id (ties by a hash of the text) and encoded after the
shuffle; each task streams its documents into files of bounded size, written under an
attempt's own name and renamed, so a repeated or lost task leaves the same files.

Defined results: null text has no ids but the end id; null doc ids come first; repeated
rows are stored each; an empty table gives no file and an empty result.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postpulse.llm.common import id_and_text, landed
from postpulse.llm.tokens import encoder

HEAD, TAIL = b"PPTOKBIN", b"PPTOKEND"
BLOCK = 65_536
FILE_IDS = 4_000_000     # a file is closed after the document that reaches this many ids


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """Ids as ``bits``-wide big-endian fields, padded to a whole byte."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} needs more than {bits} bits")
    spread = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(spread[:, 32 - bits:]).tobytes()


def unpack_ids(data: bytes, bits: int, n: int) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), dtype=np.uint8)
    wide[:, 32 - bits:] = flat
    return np.packbits(wide, axis=1).reshape(-1).view(">u4").astype("<u4")


class Writer:
    """Streams documents into one file object."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.offsets, self.ids, self.has_id, self.starts = [24], [], [], [0]
        self.pending: list[np.ndarray] = []
        self.n_pending = 0
        out.write(HEAD + struct.pack("<IIII", 1, bits, block, 0))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id or 0)
        self.has_id.append(doc_id is not None)
        self.starts.append(self.starts[-1] + len(ids))
        self.pending.append(ids)
        self.n_pending += len(ids)
        if self.n_pending >= self.block:
            joined = np.concatenate(self.pending)
            whole = len(joined) // self.block * self.block
            for i in range(0, whole, self.block):
                self._put(joined[i:i + self.block])
            self.pending, self.n_pending = [joined[whole:]], len(joined) - whole

    def _put(self, ids: np.ndarray) -> None:
        data = pack_ids(ids, self.bits)
        self.out.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> tuple[int, int]:
        if self.n_pending:
            self._put(np.concatenate(self.pending))
        self.out.write(np.array(self.offsets, "<u8").tobytes() + np.array(self.ids, "<i8").tobytes()
                       + np.array(self.has_id, "u1").tobytes()
                       + np.array(self.starts, "<u8").tobytes())
        self.out.write(struct.pack("<QQQQ", self.offsets[-1], self.starts[-1], len(self.ids),
                                   len(self.offsets) - 1) + TAIL)
        self.out.close()
        return len(self.ids), self.starts[-1]


class Reader:
    """Random access to a file held as bytes or a memory map."""

    def __init__(self, data):
        self.data = data
        if bytes(data[:8]) != HEAD or bytes(data[-8:]) != TAIL:
            raise ValueError("not a token file")
        _, self.bits, self.block, _ = struct.unpack("<IIII", data[8:24])
        at, self.n_ids, self.n_docs, n_blocks = struct.unpack("<QQQQ", data[-40:-8])
        take = lambda kind, n: np.frombuffer(data, kind, n, at)
        self.offsets = take("<u8", n_blocks + 1)
        at += 8 * (n_blocks + 1)
        self.ids = take("<i8", self.n_docs)
        at += 8 * self.n_docs
        self.has_id = take("u1", self.n_docs).astype(bool)
        at += self.n_docs
        self.starts = take("<u8", self.n_docs + 1)

    def span(self, start: int, end: int) -> np.ndarray:
        """Ids [start, end) of the file."""
        if start >= end:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (end - 1) // self.block
        parts = []
        for b in range(first, last + 1):
            n = min(self.block, self.n_ids - b * self.block)
            parts.append(unpack_ids(self.data[int(self.offsets[b]):int(self.offsets[b + 1])],
                                    self.bits, n))
        got = np.concatenate(parts)
        return got[start - first * self.block:end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.span(int(self.starts[i]), int(self.starts[i + 1]))


def filesystem(path: str):
    """(file system, path in it) for a URI or a plain path of shared storage."""
    from pyarrow.fs import FileSystem
    return FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else
                               "file://" + os.path.abspath(path))


def write_store(spark: SparkSession, df: DataFrame, path: str, tokenizer: str, end_id: int,
                id_col: str = "doc_id", text_col: str = "text",
                file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every document, append ``end_id`` and write the files below ``path``.

    Returns the manifest: one row per file with file, part, seq, n_docs, n_ids.
    """
    docs = id_and_text(df, id_col, text_col)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    dealt = docs.repartitionByRange(parts, F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        bits = max(enc.vocabulary_bits(), end_id.bit_length())
        fs, root = filesystem(path)
        fs.create_dir(root, recursive=True)
        part, rows, writer, temp, end = TaskContext.get().partitionId(), [], None, "", [end_id]

        def close() -> None:
            name = f"part-{part:06d}-{len(rows):06d}.bin"
            n_docs, n_ids = writer.close()
            fs.move(temp, f"{root}/{name}")
            rows.append((name, part, len(rows), n_docs, n_ids))

        for pdf in frames:
            for lo in range(0, len(pdf), 500):
                cut = pdf.iloc[lo:lo + 500]
                for doc_id, ids in zip(cut["doc_id"], enc.encode(list(cut["text"]))):
                    if writer is None:
                        temp = f"{root}/_{uuid.uuid4().hex}"
                        writer = Writer(fs.open_output_stream(temp), bits)
                    writer.add(None if doc_id is None else int(doc_id),
                               np.concatenate([ids, np.array(end, "<u4")]))
                    if writer.starts[-1] >= file_ids:
                        close()
                        writer = None
        if writer is not None:
            close()
        yield pd.DataFrame(rows, columns=["file", "part", "seq", "n_docs", "n_ids"])

    # ids as text: pandas holds a long beside a null as a float
    dealt = dealt.withColumn("doc_id", F.col("doc_id").cast("string"))
    return landed(spark, dealt.mapInPandas(
        write, "file string, part long, seq long, n_docs long, n_ids long"), "token-manifest")


def read_store(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    columns = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if manifest.isEmpty():       # no file, and so no folder either
        return spark.createDataFrame([], columns)
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file of about FILE_IDS ids
    before = manifest.select("file", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*.bin").load(path)
             .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content"))

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for data, base in zip(pdf["content"], pdf["base"]):
                r = Reader(data)
                ids = r.span(0, r.n_ids)
                starts = r.starts.astype(np.int64)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:])]
                doc = pd.Series(r.ids, dtype="Int64").mask(~r.has_id)
                yield pd.DataFrame({"doc_id": doc, "start": starts[:-1] + int(base),
                                    "n_tokens": np.diff(starts), "ids_crc32": crc})

    return files.join(F.broadcast(before), "file").mapInPandas(
        unpack, columns)
