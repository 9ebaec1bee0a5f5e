"""Removal of every byte covered by a ``LENGTH``-byte string that starts twice in a corpus.

1. *Anchors.* Every ``LENGTH``-byte window picks the smallest hash among the ``GRAM``-byte
   strings in it. Equal windows pick the same string at the same offset, so windows can
   only repeat within one anchor hash. Neighbouring windows share their anchor: a document
   becomes runs of windows, about one in 140 bytes, each with its anchor's hash and a
   digest of the run's bytes (its *context*).
2. *Pre-aggregation.* Runs are counted by anchor and context. An anchor with one run is
   dropped; windows of a context met twice all repeat. What is left to sort is one copy of
   each context of an anchor that has several, some of them met once.
3. *Two-stage suffix sorting* (``suffix_array``) orders the windows of whole anchors,
   block by block, and adjacent common prefixes of ``LENGTH`` bytes give the repeats.
4. *Removal.* Repeated windows go back to all runs of their context and, merged per
   document, become spans.

An anchor with more than ``HOT`` windows left to sort (a passage in a large part of the
corpus has such anchors at its two ends) is cut into narrower runs first: the bytes that
the windows of a narrow run share are its new anchor, and the same counting applies. At
width one a context is the window itself and counting alone decides, so no group that
reaches a task grows with the corpus and no window is left out.

Defined results: null text is empty; texts shorter than ``LENGTH`` have no window; rows
that repeat id and text remove each other (their windows occur twice); documents are told
apart by id and text hash, so repeated or null ids do no harm; an empty table gives an
empty result; extra columns are ignored here and kept by ``remove_repeats``. Cutting bytes can
split a character; ``remove_repeats`` then drops what is left of it from the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.llm.common import landed, map_frames
from postpulse.llm.suffix_array import Block

LENGTH = 400
GRAM = 128
PIECE = 1 << 18          # bytes hashed at a time
BLOCK = 100_000          # windows sorted at a time, but for an anchor with more
HOT = 200_000            # windows of one anchor that are sorted together at most
WIDTHS = (32, 1)         # runs of a hotter anchor are cut to these many windows
PLACE = np.uint64((1 << 24) - 1)
RUNS = "key long, ctx long, rid long, doc_id long, start int, n int"


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


def gram_hashes(raw: bytes, gram: int) -> np.ndarray:
    """64-bit hash of the ``gram`` bytes at each place (``gram`` is 8 times a power of two)."""
    n = len(raw)
    h = _mix(np.ndarray((n,), "<u8", raw + b"\0" * 7, 0, (1,)).copy())
    size = 8
    while size < gram:
        wide = h * np.uint64(0xD6E8FEB86659FD93)
        wide[:-size] += h[size:]
        h = _mix(wide)
        size *= 2
    return h


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[:len(v) - (width - size)], v[width - size:]) if size < width else v


def digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def run_arrays(raw: bytes, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(documents, starts, ns, keys, ctxs) of the runs of windows in documents laid end to end.

    Starts count from the start of ``raw``. ``raw`` holds fewer than 2**24 bytes.
    """
    if len(raw) < length:
        return (np.zeros(0, np.int64),) * 5
    h = gram_hashes(raw, gram)
    least = sliding_min((h & ~PLACE) | np.arange(len(raw), dtype=np.uint64), length - gram + 1)
    anchor = (least[:len(raw) - length + 1] & PLACE).astype(np.int64)
    doc = np.searchsorted(ends, np.arange(len(anchor)), side="right")
    whole = np.arange(len(anchor)) + length <= ends[doc]
    turn = np.ones(len(anchor), bool)
    turn[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1])
    start = np.flatnonzero(turn)
    n = np.diff(np.append(start, len(anchor)))
    good = whole[start]
    start, n = start[good], n[good]
    ctx = [digest(raw[s:s + k + length - 1]) for s, k in zip(start.tolist(), n.tolist())]
    return doc[start], start, n, h[anchor[start]].view(np.int64), np.array(ctx, np.int64)


def runs_of(raw: bytes, ends: np.ndarray, length: int, gram: int) -> Iterator[tuple]:
    """(document, start, n, key, ctx) of each run of ``run_arrays``."""
    return zip(*(x.tolist() for x in run_arrays(raw, ends, length, gram)))


def anchor_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Runs of (doc_id, rid, text) rows; ``start`` in bytes of the document."""

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part: list[bytes] = []
        owner: list[tuple] = []

        # a frame for every PIECE bytes: what a task holds does not grow with its batch of texts
        def flush() -> pd.DataFrame:
            begin = np.cumsum([0] + [len(p) for p in part])
            d, s, n, key, ctx = run_arrays(b"".join(part), begin[1:], length, gram)
            doc_id, rid, offset = zip(*owner)
            out = pd.DataFrame({
                "key": key, "ctx": ctx, "rid": np.array(rid, np.int64)[d],
                "doc_id": np.array(doc_id, object)[d],
                "start": (s - begin[d] + np.array(offset, np.int64)[d]).astype(np.int32),
                "n": n.astype(np.int32)})
            part.clear()
            owner.clear()
            return out

        for pdf in frames:
            size = 0
            for doc_id, rid, text in zip(pdf["doc_id"], pdf["rid"], pdf["text"]):
                raw = text.encode("utf-8", "surrogatepass")
                # a long text goes in overlapping pieces: each window is in exactly one
                for lo in range(0, max(1, len(raw) - length + 1), PIECE):
                    part.append(raw[lo:lo + PIECE + length - 1])
                    owner.append((doc_id, rid, lo))
                    size += len(part[-1])
                    if size >= PIECE:
                        yield flush()
                        size = 0
            if part:
                yield flush()

    return map_frames(docs, find, RUNS)


def counted(runs: DataFrame) -> DataFrame:
    """(key, ctx, n, m, open_windows): contexts of the keys that more than one run has.

    ``runs`` has key, ctx, n, m, each row standing for m runs. Of the result, contexts with
    m > 1 repeat as a whole; open_windows is the number of windows to sort for the key, 0
    where nothing is open.
    """
    contexts = runs.groupBy("key", "ctx").agg(F.sum("m").alias("m"), F.max("n").alias("n"))
    keys = contexts.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_ctx"), F.sum("m").alias("n_runs"), F.min("m").alias("least"),
        F.sum(F.col("n").cast("long")).alias("windows")).where("n_runs > 1")
    is_open = (F.col("n_ctx") > 1) & (F.col("least") == 1)
    return contexts.join(keys, "key").select(
        "key", "ctx", "n", "m", F.when(is_open, F.col("windows")).otherwise(0).alias("open_windows"))


def with_bytes(docs: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """Adds ``data``, the bytes of a run, to (key, ctx, rid, start, n, ...) rows.

    Rows of one text hash are one text: one of them a task is shuffled, and one is joined.
    """
    per_text = chosen.groupBy("rid").agg(F.collect_list(
        F.struct("key", "ctx", "start", "n", "m", "open_windows")).alias("runs"))
    joined = docs.select("rid", "text").dropDuplicates(["rid"]).join(per_text, "rid")

    columns = ["key", "ctx", "n", "m", "open_windows", "data"]

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out, size = [], 0
            for row in pdf.itertuples(index=False):
                raw = row.text.encode("utf-8", "surrogatepass")
                for key, ctx, start, n, m, open_windows in zip(
                        row.key, row.ctx, row.start, row.n, row.m, row.open_windows):
                    out.append((key, ctx, n, m, open_windows, raw[start:start + n + length - 1]))
                    size += n + length
                    if size >= PIECE:
                        yield pd.DataFrame(out, columns=columns)
                        out, size = [], 0
            yield pd.DataFrame(out, columns=columns)

    return joined.select("text", *[F.col(f"runs.{c}").alias(c) for c in (
        "key", "ctx", "start", "n", "m", "open_windows")]).mapInPandas(
        cut, "key long, ctx long, n int, m long, open_windows long, data binary")


def sort_blocks(contexts: DataFrame, length: int) -> DataFrame:
    """(key, ctx, lo, hi): runs of repeated windows in contexts met once.

    ``contexts`` has key, ctx, n, m, data, all contexts of a key among them.
    """
    dealt = contexts.repartition("key").sortWithinPartitions("key")

    def solve(rows: list[tuple]) -> pd.DataFrame:
        marks = Block([r[4] for r in rows], [r[2] for r in rows], length).repeated()
        out = []
        for (key, ctx, n, m, _), again in zip(rows, marks):
            if m == 1 and again.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], again.astype(np.int8), [0]])))
                out += [(key, ctx, lo, hi) for lo, hi in zip(edge[::2].tolist(),
                                                              edge[1::2].tolist())]
        return pd.DataFrame(out, columns=["key", "ctx", "lo", "hi"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block: list[tuple] = []      # whole keys
        same: list[tuple] = []       # the key being read
        size = 0
        for pdf in frames:
            for row in zip(pdf["key"], pdf["ctx"], pdf["n"], pdf["m"], pdf["data"]):
                if same and same[-1][0] != row[0]:
                    block += same
                    same = []
                    if size >= BLOCK:
                        yield solve(block)
                        block, size = [], 0
                same.append(row)
                size += row[2]
        if block or same:
            yield solve(block + same)

    return dealt.select("key", "ctx", "n", "m", "data").mapInPandas(
        run, "key long, ctx long, lo int, hi int")


def narrowed(contexts: DataFrame, width: int, length: int, gram: int) -> DataFrame:
    """Cut (key, ctx, m, anchor, data) contexts into runs of at most ``width`` windows.

    Windows belong together when their distances to the anchor lie in one cell of a grid,
    the same in every context; the bytes that all windows of a cell share are the new key.
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for key, ctx, m, at, data in zip(pdf["key"], pdf["ctx"], pdf["m"], pdf["anchor"],
                                             pdf["data"]):
                if at < 0:      # not cut yet: the anchor is the first place with the key's hash
                    at = int(np.argmax(gram_hashes(data, gram) == np.int64(key).view(np.uint64)))
                lo, n = 0, len(data) - length + 1
                name = int(key).to_bytes(8, "little", signed=True)
                while lo < n:
                    cell, rest = divmod(at - lo, width)
                    hi = min(n, lo + rest + 1)
                    first = at - cell * width
                    core = data[first:first - width + 1 + length]
                    piece = data[lo:hi + length - 1]
                    out.append((digest(name + cell.to_bytes(4, "little") + core), digest(piece),
                                m, hi - lo, key, ctx, lo, at - lo, piece))
                    lo = hi
            yield pd.DataFrame(out, columns=["key", "ctx", "m", "n", "root_key", "root_ctx", "at",
                                             "anchor", "data"])

    return contexts.select("key", "ctx", "m", "anchor", "data").mapInPandas(
        cut, "key long, ctx long, m long, n int, root_key long, root_ctx long, at int, "
             "anchor int, data binary")


def repeats(spark: SparkSession, contexts: DataFrame, length: int, gram: int, hot: int,
            widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(key, ctx, lo, hi): the repeated windows of open contexts."""
    out = sort_blocks(contexts.where(F.col("open_windows") <= hot), length)
    if not widths:        # at width one a context is a window: nothing stays open
        return out
    hotter = contexts.where(F.col("open_windows") > hot)
    if hotter.isEmpty():
        return out
    pieces = landed(spark, narrowed(hotter, widths[0], length, gram), "repeats-pieces")
    verdict = landed(spark, counted(pieces), "repeats-pieces-counted")
    roots = pieces.select("key", "ctx", "n", "root_key", "root_ctx", "at")
    whole = roots.join(verdict.where("m > 1").select("key", "ctx"), ["key", "ctx"]).select(
        F.col("root_key").alias("key"), F.col("root_ctx").alias("ctx"), F.col("at").alias("lo"),
        (F.col("at") + F.col("n")).alias("hi"))
    still = verdict.where("open_windows > 0").select("key", "ctx", "m", "open_windows")
    still = (pieces.select("key", "ctx", "n", "anchor", "data").join(still, ["key", "ctx"])
             .dropDuplicates(["key", "ctx"]))
    deeper = repeats(spark, landed(spark, still, "repeats-open"), length, gram, hot, widths[1:])
    deeper = deeper.join(roots, ["key", "ctx"]).select(
        F.col("root_key").alias("key"), F.col("root_ctx").alias("ctx"),
        (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi"))
    return out.unionByName(whole).unionByName(deeper)


def identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rid, text): whole texts, null as empty, with a hash of the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("rid"),
                     text.alias("text"))


def repeated_spans(spark: SparkSession, docs: DataFrame, length: int = LENGTH, gram: int = GRAM,
                   hot: int = HOT) -> DataFrame:
    """(doc_id, rid, starts): per document of ``identified`` rows with repeats, the [lo, hi)
    ranges of places where a repeated string starts."""
    runs = landed(spark, anchor_runs(docs, length, gram), "repeats-runs")
    verdict = landed(spark, counted(runs.withColumn("m", F.lit(1).cast("long"))),
                     "repeats-counted")
    # one run of each context that takes part in a sort, chosen before the shuffle: rows of the
    # smallest text hash are the same text
    open_ = verdict.where("open_windows > 0").select("key", "ctx", "n", "m", "open_windows")
    first = runs.groupBy("key", "ctx").agg(
        F.min("rid").alias("rid"), F.min_by("start", "rid").alias("start"))
    contexts = landed(spark, with_bytes(docs, first.join(open_, ["key", "ctx"]), length),
                      "repeats-contexts")
    parts = repeats(spark, contexts.withColumn("anchor", F.lit(-1)), length, gram, hot)
    whole = verdict.where("m > 1").select("key", "ctx", F.lit(0).alias("lo"), F.col("n").alias("hi"))
    found = landed(spark, parts.unionByName(whole), "repeats-found")
    return runs.join(found, ["key", "ctx"]).groupBy("doc_id", "rid").agg(F.collect_set(
        F.struct((F.col("start") + F.col("lo")).alias("lo"),
                 (F.col("start") + F.col("hi")).alias("hi"))).alias("starts"))


def covered(starts, length: int) -> list[tuple[int, int]]:
    """Byte spans covered by the strings, overlapping and touching ones merged."""
    out: list[list[int]] = []
    for lo, hi in sorted((r["lo"], r["hi"]) for r in starts):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + length - 1)
        else:
            out.append([lo, hi + length - 1])
    return [(a, b) for a, b in out]


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for lo, hi in spans:
        kept.append(raw[at:lo])
        at = hi
    return b"".join([*kept, raw[at:]])


def join_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` (with doc_id and rid) and their ``starts``, null where nothing repeats."""
    spans = spans.select(F.col("doc_id").alias("span_doc"), F.col("rid").alias("span_rid"), "starts")
    return docs.join(spans, (docs["rid"] == spans["span_rid"])
                     & docs["doc_id"].eqNullSafe(spans["span_doc"]), "left").drop(
        "span_doc", "span_rid")


def removal_report(spark: SparkSession, df: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
                   hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges)."""
    docs = identified(df, id_col, text_col)
    joined = join_spans(docs, repeated_spans(spark, docs, length, gram, hot))

    def report(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for text, starts in zip(pdf["text"], pdf["starts"]):
                raw = text.encode("utf-8", "surrogatepass")
                spans = covered(starts, length) if starts is not None else []
                kept = without(raw, spans)
                out.append((len(raw), len(raw) - len(kept), len(spans),
                            hashlib.sha256(kept).hexdigest(),
                            [{"lo": a, "hi": b} for a, b in spans]))
            got = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256",
                                             "spans"], index=pdf.index)
            got.insert(0, "doc_id", pdf["doc_id"])
            yield got

    return map_frames(
        joined.select("doc_id", "text", "starts"), report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                "spans array<struct<lo:bigint,hi:bigint>>")


def remove_repeats(spark: SparkSession, df: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
                   hot: int = HOT) -> DataFrame:
    """``df`` with the repeated bytes cut out of its text, all rows and columns kept."""
    spans = repeated_spans(spark, identified(df, id_col, text_col), length, gram, hot)

    def text_of(col):
        return F.coalesce(col.cast("string"), F.lit(""))

    keyed = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"),
                      F.col(id_col).cast("long").alias("doc_id"),
                      F.xxhash64(text_of(F.col(text_col))).alias("rid"))
    joined = join_spans(keyed, spans)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([
            without(t.encode("utf-8", "surrogatepass"), covered(s, length)).decode("utf-8", "ignore")
            for t, s in zip(texts, starts)])

    new = F.when(F.col("starts").isNotNull(), cut(text_of(F.col(f"row.{text_col}")), F.coalesce(
        "starts", F.array().cast("array<struct<lo:int,hi:int>>")))).otherwise(F.col(f"row.{text_col}"))
    return joined.select(*[new.alias(c) if c == text_col else F.col(f"row.{c}").alias(c)
                           for c in df.columns])
