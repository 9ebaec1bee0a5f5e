"""Repeatable pseudo-random numbers from row ids.

``rand()`` and ``randomSplit`` depend on how rows are partitioned, so results
change between runs and cluster sizes. A hash of (seed, id) does not: it is the
same on any cluster and in any engine that has md5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_number(seed, *parts: Column) -> Column:
    """First 8 hex digits of md5('seed|part1|part2...') as a number in [0, 2^32)."""
    pieces = [F.lit(f"{seed}")]
    for p in parts:
        pieces += [F.lit("|"), p.cast("string")]
    return F.conv(F.substring(F.md5(F.concat(*pieces)), 1, 8), 16, 10).cast("long")


def sql_md5_number(seed, *exprs: str) -> str:
    """The same number written as DuckDB SQL (used by the oracles)."""
    inner = f"'{seed}'"
    for e in exprs:
        inner += f" || '|' || CAST({e} AS VARCHAR)"
    return f"CAST(('0x' || substr(md5({inner}), 1, 8)) AS BIGINT)"


def md5_words(seed, id_col: Column) -> tuple[Column, Column]:
    """Two 32-bit numbers from one md5('seed|id'): hex digits 1-8, and 9-16 made odd."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), id_col.cast("string")))
    h1 = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    h2 = F.conv(F.substring(digest, 9, 8), 16, 10).cast("long").bitwiseOR(F.lit(1))
    return h1, h2


def replicate_key(h1: Column, h2: Column, rep: Column) -> Column:
    """Sort key of a row in replicate ``rep``: (h1 + rep * h2) mod 2^32.

    Uniform on [0, 2^32) for every replicate, and one multiply-add per
    (row, replicate) instead of one md5 each.
    """
    return (h1 + rep.cast("long") * h2) % F.lit(1 << 32)


def sql_md5_words(seed, expr: str) -> tuple[str, str]:
    """DuckDB form of ``md5_words``."""
    m = f"md5('{seed}|' || CAST({expr} AS VARCHAR))"
    return (f"CAST(('0x' || substr({m}, 1, 8)) AS BIGINT)",
            f"(CAST(('0x' || substr({m}, 9, 8)) AS BIGINT) | 1)")
