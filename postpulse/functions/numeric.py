"""Rounding to significant digits, written the same way in Spark and in SQL.

Sums of squares reach 1e10 and more, so a fixed number of decimals is either
too coarse or finer than two engines agree on. Both forms below divide or
multiply by an exact power of ten, round to an integer, and scale back.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sig_round(c: Column, digits: int = 9) -> Column:
    k = F.floor(F.log10(F.abs(c))) - F.lit(digits - 1)
    scale_down = F.round(c / F.pow(F.lit(10.0), k)) * F.pow(F.lit(10.0), k)
    scale_up = F.round(c * F.pow(F.lit(10.0), -k)) / F.pow(F.lit(10.0), -k)
    return (F.when(c.isNull(), F.lit(None).cast("double"))
             .when(c == 0, F.lit(0.0))
             .when(k >= 0, scale_down).otherwise(scale_up))


def sql_sig_round(expr: str, digits: int = 9) -> str:
    k = f"(floor(log10(abs({expr}))) - {digits - 1})"
    return (f"(CASE WHEN ({expr}) IS NULL THEN NULL WHEN ({expr}) = 0 THEN 0.0 "
            f"WHEN {k} >= 0 THEN round(({expr}) / pow(10.0, {k})) * pow(10.0, {k}) "
            f"ELSE round(({expr}) * pow(10.0, -{k})) / pow(10.0, -{k}) END)")
