"""Conflict-constrained best-fit packing of documents into fixed-size training rows.

A bin holds at most ``capacity`` tokens, and never two pieces of the same source or of
the same duplicate cluster. Items are placed longest first. Open bins are ordered by
what is left in them; the search starts at the smallest remainder that fits the item
and goes on to the next larger one until a compatible bin is found, else a bin opens.

Bins of one shard are numbered, and each source, each cluster and each remainder keeps
one bitmap over those numbers, so "the bins with this remainder that hold neither" is
two bit operations however many copies or rows of a hot source there are.

Items are dealt to shards by a hash of their row number, with about ``shard_items`` items
each whatever the size of the corpus; a hot source, cluster or row therefore spreads
over all shards. Documents longer than ``capacity`` are cut: full pieces fill bins of their own
and need no search, the rest is packed as an item.

Defined results: a null source conflicts with no other; a null text has no tokens; an
item without tokens is placed too (it takes no room); repeated rows are items of their
own, in the same cluster; an empty table gives no bins.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.llm.common import BLANKS, landed, normal_text


class Shard:
    """Best-fit bins of one shard."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.left: list[int] = []                      # by bin number
        self.by_left: dict[int, int] = {}              # remainder -> bitmap of bins
        self.order: list[int] = []                     # remainders in use, ascending
        self.of_source: dict = defaultdict(int)        # source -> bitmap of bins
        self.of_cluster: dict = defaultdict(int)       # cluster -> bitmap of bins

    def place(self, length: int, source, cluster) -> int:
        taken = (self.of_source[source] if source is not None else 0) | self.of_cluster[cluster]
        for i in range(bisect_left(self.order, length), len(self.order)):
            free = self.by_left[self.order[i]] & ~taken
            if free:
                number = (free & -free).bit_length() - 1
                self._move(number, length)
                break
        else:
            number = len(self.left)
            self.left.append(self.capacity)
            self._add(self.capacity, number)
            self._move(number, length)
        bit = 1 << number
        if source is not None:
            self.of_source[source] |= bit
        self.of_cluster[cluster] |= bit
        return number

    def _move(self, number: int, length: int) -> None:
        if length:
            old = self.left[number]
            self.by_left[old] &= ~(1 << number)
            if not self.by_left[old]:
                del self.by_left[old]
                del self.order[bisect_left(self.order, old)]
            self.left[number] = old - length
            self._add(old - length, number)

    def _add(self, left: int, number: int) -> None:
        if left not in self.by_left:
            self.by_left[left] = 0
            insort(self.order, left)
        self.by_left[left] |= 1 << number


def items(df: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """(doc_id, source, cluster, n_tokens) per row: words as tokens, equal texts as clusters."""
    text = normal_text(F.col(text_col))
    words = F.trim(text)
    n = F.when(words == "", F.lit(0)).otherwise(
        F.length(words) - F.length(F.translate(words, " ", "")) + 1)
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.col(source_col).cast("string").alias("source"),
                     F.xxhash64(words).alias("cluster"), n.cast("long").alias("n_tokens"))


def pack(rows: DataFrame, capacity: int = 2048, shard_items: int = 8192) -> DataFrame:
    """Pack (doc_id, source, cluster, n_tokens) rows.

    Returns one row per piece: bin_id (unique over the result), doc_id, piece, start (token
    offset in the document), n_tokens, source, cluster. Every token is in exactly one piece.
    """
    # narrow rows, written once, so that a row's number is the same in every attempt
    rows = landed(rows.sparkSession, rows, "packing-items").withColumn(
        "salt", F.monotonically_increasing_id())
    shards = rows.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(shard_items)))
                      .cast("long").alias("shards"))
    shards = shards.first()["shards"]
    # by row, so that equal rows spread over the shards; ids as text, since pandas holds a long
    # beside a null as a float
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("salt"), F.lit(shards))).withColumn(
        "doc_id", F.col("doc_id").cast("string"))
    schema = ("bin_id string, doc_id string, piece long, start long, n_tokens long, "
              "source string, cluster long")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, out, full = Shard(capacity), [], 0
        number = int(pdf["shard"].iat[0])
        pdf = pdf.assign(rest=pdf["n_tokens"] % capacity,
                         id=pd.array([None if d is None else int(d) for d in pdf["doc_id"]],
                                     "Int64"))
        # longest first, then by id: the same bins whatever order the rows arrive in
        pdf = pdf.sort_values(["rest", "id", "cluster", "n_tokens", "source"],
                              ascending=[False, True, True, True, True], na_position="last")
        for d, s, c, n, rest in zip(pdf["doc_id"], pdf["source"], pdf["cluster"],
                                    pdf["n_tokens"], pdf["rest"]):
            s = None if pd.isna(s) else s
            whole = n // capacity
            for k in range(whole):
                out.append((f"{number}-f{full}", d, k, k * capacity, capacity, s, c))
                full += 1
            if rest or not n:
                b = shard.place(int(rest), s, c)
                out.append((f"{number}-b{b}", d, whole, whole * capacity, int(rest), s, c))
        return pd.DataFrame(out, columns=["bin_id", "doc_id", "piece", "start", "n_tokens",
                                          "source", "cluster"])

    bins = dealt.groupBy("shard").applyInPandas(fill, schema)
    return bins.withColumn("doc_id", F.col("doc_id").cast("long"))
