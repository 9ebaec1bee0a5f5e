"""Pulls of landed rows (survey S1, S2, S4, D7, J4, J5, A6).

The original collected posts and comments per community and time range from a
web API. Here the rows are already landed; a pull is a filter that Catalyst
pushes into the parquet scan (community IN-list and timestamp range).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.functions.timeparts import ntz_literal


def time_slice(rows: DataFrame, groups: Sequence[str] | None, after: int, before: int,
               ts_col: str = "ts", group_col: str = "subreddit") -> DataFrame:
    """Rows of the listed communities with after <= time < before (epoch seconds, UTC).

    Bounds are applied to the stored zone-less timestamp, so they appear in the
    scan's PushedFilters and skip row groups by their min/max statistics.
    """
    ts = F.col(ts_col)
    cond = (ts >= ntz_literal(after)) & (ts < ntz_literal(before))
    if groups is not None:
        cond = F.col(group_col).isin(list(groups)) & cond
    return rows.filter(cond)


def distinct_groups(rows: DataFrame, group_col: str = "subreddit") -> DataFrame:
    """The communities present (J5): one aggregate, partial before the shuffle."""
    return rows.select(group_col).distinct()


def union_slices(frames: Iterable[DataFrame]) -> DataFrame:
    """Stack pulls whose columns differ; missing columns become null."""
    frames = list(frames)
    if not frames:
        raise ValueError("nothing to stack")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def profile_counts(pull: DataFrame, group_col: str = "subreddit") -> DataFrame:
    """Row count per community and column count of a pull."""
    return (pull.groupBy(group_col).agg(F.count(F.lit(1)).alias("n_rows"))
                .withColumn("n_cols", F.lit(len(pull.columns))))


def last_chunk(rows: DataFrame, chunk_rows: int, order_col: str) -> DataFrame:
    """The rows left by a chunked copy where each chunk overwrites the last.

    Only the final chunk of ``chunk_rows`` rows (in ``order_col`` order) remains.
    One count, then a distributed top-k of at most ``chunk_rows`` rows.
    """
    n = rows.count()
    if n == 0:
        return rows.limit(0)
    k = (n - 1) % chunk_rows + 1
    return rows.orderBy(F.desc(order_col)).limit(k)
