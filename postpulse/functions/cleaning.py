"""Projection, cleaning and casting helpers (survey P1-P6, P13)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType


def blank_to_zero(c: Column) -> Column:
    """Blank text -> '0'. Only the empty string and null count as blank (no trim)."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("0"))


def fill_blank_zero(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Replace blanks by zero in every (or the given) column.

    Text columns: '' and null become '0'; numeric columns: null becomes 0.
    One projection, no shuffle.
    """
    wanted = set(columns) if columns is not None else None
    out = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if wanted is not None and field.name not in wanted:
            out.append(c)
        elif isinstance(field.dataType, StringType):
            out.append(blank_to_zero(c).alias(field.name))
        elif isinstance(field.dataType, NumericType):
            out.append(F.coalesce(c, F.lit(0).cast(field.dataType)).alias(field.name))
        else:
            out.append(c)
    return df.select(*out)


def drop_strict(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Drop named columns, raising if any is absent (Spark's drop ignores them)."""
    columns = list(columns)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    return df.drop(*columns)


def rename_all(df: DataFrame, names: list[str]) -> DataFrame:
    """Rename every column by position; the count must match exactly."""
    if len(names) != len(df.columns):
        raise ValueError(f"expected {len(df.columns)} names, got {len(names)}")
    return df.toDF(*names)


def drop_null_rows(df: DataFrame) -> DataFrame:
    """Remove every row holding a null in any column."""
    return df.na.drop(how="any")


def to_int(c: Column, strict: bool = True) -> Column:
    """Parse to int: an error on a value that is no integer (whatever ANSI mode is set), or
    null when lenient. A null stays null."""
    parsed = c.try_cast("int")
    if not strict:
        return parsed
    bad = F.raise_error(F.concat(F.lit("not an integer: "), c.cast("string"))).cast("int")
    return F.when(c.isNotNull() & parsed.isNull(), bad).otherwise(parsed)
